"""Quality rules: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every document gets counts over its whole text and a vote (bad, none, good) of each rule. The
votes of all documents, those that fail the base included, form patterns; only the patterns' counts
reach the driver, 3**len(RULES) at most. There a two-class model with an outcome table for each
rule is fitted by expectation-maximisation (Dawid & Skene 1979; data programming, Ratner et al.
2016), and each pattern gets the posterior probability that its documents are good. The tables
start from a guess that weighs as much as PRIOR_DOCUMENTS documents; all else is learned: a rule
whose bad votes others seldom share loses its weight and is outvoted, one whose bad votes go
along with others' can decide alone. Base failures are never kept.

Null text counts as empty: no words, base_failed. Repeated rows each get their row; null
doc_id stays null; an empty table gives an empty result; other columns are not looked at,
whatever their names, and keep_good hands them on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, prepare, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
KEEP_FROM = 0.5
PRIOR_DOCUMENTS = 50
SPAN = 100  # words of a stretch in which variety is measured
#: (name, bad if, good if) over the measures of measures(); between the two a rule abstains.
RULES = (
    ("symbols", lambda m: m["symbols"] > 0.10, lambda m: m["symbols"] < 0.03),
    ("marked words", lambda m: m["marked"] > 0.15, lambda m: m["marked"] < 0.05),
    ("bare words", lambda m: m["bare"] > 0.10, lambda m: m["bare"] < 0.03),
    ("capitals", lambda m: m["upper"] > 0.60, lambda m: m["upper"] < 0.25),
    ("repetition", lambda m: m["repeat"] > 0.30, lambda m: m["repeat"] < 0.15),
    ("lines", lambda m: m["dup_lines"] > 0.30, lambda m: m["dup_lines"] < 0.15),
    ("word length", lambda m: not 2.0 <= m["word_len"] <= 14.0, lambda m: 3.0 <= m["word_len"] <= 9.0),
    ("variety", lambda m: m["variety"] < 0.30, lambda m: m["variety"] > 0.50),
    ("shouting", lambda m: m["shout"] > 0.20, lambda m: m["shout"] < 0.05),
    ("letters", lambda m: m["letters"] < 0.70, lambda m: m["letters"] > 0.80),
    ("sentences", lambda m: m["ends"] < 0.01 or m["ends"] > 0.5, lambda m: 0.03 < m["ends"] < 0.3),
)
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITALS = regex.compile(r"\p{Lu}+")
_MARKED = re.compile(r"[^\x20\x09-\x0d#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0d]*")
_BARE = re.compile(r"(?<![^\x20\x09-\x0d])[^\w\x20\x09-\x0d]+(?![^\x20\x09-\x0d])")
_ASCII_CAPITALS = bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text, first ones included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = np.zeros(n, bool)
    for i, g in enumerate(windows):
        j = first.setdefault(g, i)
        if j != i:
            hit[i] = hit[j] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def dup_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    seen, dup, n = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and line.strip(b" \t\n\x0b\x0c\r"):
            n += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return dup, n


def measures(text: str | None) -> tuple[tuple[int, ...], dict[str, float]]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0d alone
    n = len(words)
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    chars = len(text) - blanks
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, lines = dup_lines(raw)
    rep = repeat_words(words)
    some = max(n, 1)
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = len(raw) - len(raw.translate(None, _ASCII_CAPITALS)) if len(raw) == len(text) else sum(map(len, _CAPITALS.findall(text)))
    m = {
        "symbols": symbols / some,
        "upper": upper / max(letters, 1),
        "repeat": rep / some,
        "dup_lines": dup / max(lines, 1),
        "word_len": chars / some,
        "marked": (len(_MARKED.findall(text)) if symbols else 0) / some,
        "bare": len(_BARE.findall(text)) / some,
        "variety": sum(len(set(words[i : i + SPAN])) for i in range(0, n, SPAN)) / some,
        "shout": text.count("!!") / some,
        "letters": letters / max(chars, 1),
        "ends": sum(text.count(c) for c in ".?!") / some,
    }
    return (n, chars, symbols, dup, rep), m


def votes(m: dict[str, float]) -> str:
    return "".join("b" if bad(m) else "g" if good(m) else "-" for _, bad, good in RULES)


def base_failed(n: int, rep: int) -> bool:
    return n < MIN_WORDS or 100 * rep > 50 * n


def fit(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior probability of "good" for each pattern, from the patterns' counts."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    code = np.array([["b-g".index(c) for c in k] for k in keys])
    rules = code.shape[1]
    # rows: class bad, class good; columns: votes bad, none, good. A document may be bad in one way
    # alone, so on bad ones most rules still vote good.
    prior = np.array([[0.30, 0.10, 0.60], [0.02, 0.08, 0.90]])
    tables = np.repeat(prior[None], rules, 0)
    share = np.array([0.2, 0.8])
    post = np.zeros((len(keys), 2))
    for _ in range(rounds):
        log = np.log(share)[None] + sum(np.log(tables[r][:, code[:, r]]).T for r in range(rules))
        log -= log.max(1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(1, keepdims=True)
        mass = post * count[:, None]
        share = (mass.sum(0) + PRIOR_DOCUMENTS * np.array([0.2, 0.8])) / (count.sum() + PRIOR_DOCUMENTS)
        for r in range(rules):
            got = np.array([[mass[code[:, r] == v, k].sum() for v in range(3)] for k in range(2)])
            tables[r] = (got + PRIOR_DOCUMENTS * prior) / (got.sum(1, keepdims=True) + PRIOR_DOCUMENTS)
    return {k: float(p) for k, p in zip(keys, post[:, 1])}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows, kinds, failed = b.column(0), [], [], []
        for t in b.column(1).to_pylist():
            counts, m = measures(t)
            rows.append(counts)
            kinds.append(votes(m))
            failed.append(base_failed(counts[0], counts[4]))
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *cols, pa.array(failed, pa.bool_()), pa.array(kinds, pa.string())], ["doc_id", *NAMES, "base_failed", "votes"])


SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, votes string"


def measure_documents(docs: DataFrame) -> DataFrame:
    """Counts and votes of each document; the text is read once."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, SCHEMA)


def learn(measured: DataFrame) -> dict[str, float]:
    """Fits the label model on the counts of all documents' vote patterns (3**len(RULES) at most)."""
    return fit({r["votes"]: r["count"] for r in measured.groupBy("votes").count().collect()})


def judge(measured: DataFrame, model: dict[str, float]) -> DataFrame:
    spark = measured.sparkSession
    known = spark.createDataFrame(list(model.items()) or [("", 0.0)], "votes string, quality double")
    out = measured.join(F.broadcast(known), "votes", "left")  # as many rows as patterns
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= KEEP_FROM))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the fitted model keeps, with the columns of docs. Rows need no key."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    failed, voted = fresh(docs, "base_failed"), fresh(docs, "votes")
    schema = T.StructType([*docs.schema.fields, T.StructField(failed, T.BooleanType()), T.StructField(voted, T.StringType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measures(t) for t in b.column(at).to_pylist()]
            fails = pa.array([base_failed(c[0], c[4]) for c, _ in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, fails, pa.array([votes(m) for _, m in found], pa.string())], [*b.schema.names, failed, voted])

    # the texts are written with their votes, so that each is measured once
    read = cut(docs.mapInArrow(marked, schema), "quality")
    model = learn(read.select(F.col(f"`{voted}`").alias("votes")))
    good = read.sparkSession.createDataFrame([(v,) for v, p in model.items() if p >= KEEP_FROM], f"`{voted}` string")
    return read.filter(f"not `{failed}`").join(F.broadcast(good), voted, "left_semi").drop(failed, voted)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(measure_documents(table(prepare(spark), sf_dir, "documents")), "op8")
    out = judge(measured, learn(measured))
    return out.select("doc_id", *NAMES, "base_failed", "kept", "votes", "quality")
