r"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

The four base kinds are found exactly as their patterns say (leftmost, non-overlapping, a match
that fails its check is dropped and not tried again) and always stay. Proposals of further kinds
(IBANs, other account numbers, secrets, social numbers) get
score = prior of the kind + what its validator adds or takes + what words nearby, in the WINDOW
characters before and behind, add or take. The validators are mod-97, Luhn, a look for random
characters and the ranges of social numbers. From ACCEPT on a proposal stays: words can carry one
that its validator alone would leave out, or take back one that it confirmed. Further kinds never
displace a base span; among them, kinds listed first go first. Every span's score is reported.

Offsets are code points, ends exclusive. Null text counts as empty: no spans and the digest
of an empty list. Every scan is linear in the text and spans are sorted once a kind, so one very
long text is no harder than many short ones. Repeated rows each get a row; null doc_id stays
null; empty table, empty result. Columns of other names, whatever they are, are ignored by
find_pii and kept by mask_pii.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "account", "secret", "ssn")
KINDS = BASE + EXTRA
MASK = {k: f"<{k.upper()}>" for k in KINDS}
WINDOW = 40
ACCEPT = 0.6


def _words(said: str) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z])(?:{said})", re.I)


#: kind: prior, what a passed and a failed check add, words that speak for it and add, words that speak against it and take.
EVIDENCE = {
    "email": (0.7, 0.0, 0.0, 0.2, _words("mail|e-mail|contact|write|correo"), -0.1, _words("example|sample|test")),
    "ip": (0.6, 0.0, 0.0, 0.2, _words("ip|host|server|client|address|from"), -0.2, _words("version|release|section|v")),
    "card": (0.6, 0.2, 0.0, 0.2, _words("card|visa|master|amex|credit|karte|tarjeta|carte"), -0.2, _words("order|serial|isbn|tracking|invoice")),
    "phone": (0.6, 0.0, 0.0, 0.2, _words("tel|phone|call|mobile|fax"), -0.2, _words("score|range|minus")),
    "iban": (0.35, 0.40, -0.25, 0.30, _words("iban|account|konto|cuenta|compte|bank|bic|swift"), -0.30, _words("serial|licen[cs]e|part number|sku|product key")),
    "account": (0.10, 0.30, -0.30, 0.35, _words("card|visa|amex|credit|account|konto|karte|tarjeta|carte|iban"), -0.20, _words("order|serial|isbn|imei|tracking|invoice|sku")),
    "secret": (0.30, 0.20, -0.30, 0.30, _words("token|secret|passw|api.?key|credential|bearer|auth|private.?key"), -0.20, _words("sha-?1|sha-?256|md5|commit|checksum|digest|etag|uuid")),
    "ssn": (0.30, 0.15, -0.30, 0.30, _words("ssn|social|security|tax"), -0.20, _words("order|serial|part|ticket|case")),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}(?![A-Za-z0-9_+/-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from each @ outwards so that long runs cost linear time."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        # text before a failed @ can't begin a later match: @ is not in the local part
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _random_looking(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(set(s)) >= 10


def score(text: str, kind: str, a: int, b: int, checked: bool | None) -> float:
    """The evidence for the span a to b; checked is None where the kind has no validator."""
    start, passed, failed, more, for_, less, against = EVIDENCE[kind]
    near = (max(0, a - WINDOW), a), (b, min(len(text), b + WINDOW))
    total = start + (0.0 if checked is None else passed if checked else failed)
    total += more * any(for_.search(text, x, y) for x, y in near)
    total += less * any(against.search(text, x, y) for x, y in near)
    return min(1.0, max(0.0, round(total, 2)))


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for m in _IBAN.finditer(text):
        yield "iban", m.start(), m.end(), mod97(m.group())
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 24:
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 15:
                yield "account", m.start(), m.end(), luhn(d)
    for m in _SECRET.finditer(text):
        yield "secret", m.start(), m.end(), _random_looking(m.group())
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), m.group()[:3] not in ("000", "666") and m.group()[0] != "9"


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scored_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds, with scores, that reach ACCEPT and touch no base span nor one of a kind before."""
    found: dict[str, list[tuple[int, int, float]]] = {}
    for kind, a, b, checked in _proposed(text):
        s = score(text, kind, a, b, checked)
        if s >= ACCEPT:
            found.setdefault(kind, []).append((a, b, s))
    out, used = [], union([(a, b) for _, a, b in taken])
    for kind in EXTRA:
        kept = []
        for a, b, s in found.get(kind, ()):
            # the first used span that ends behind a; it overlaps if it begins before b
            i = bisect.bisect_right(used, a, key=lambda x: x[1])
            if i == len(used) or used[i][0] >= b:
                kept.append((a, b))
                out.append((kind, a, b, s))
        if kept:
            used = union(used + kept)
    return out


def extra_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return [x[:3] for x in scored_spans(text, taken)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and further spans, each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    return base, extra_spans(text, base)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the union is replaced once."""
    if not text:
        return text
    base, extra = spans_of(text)
    out, at = [], 0
    for a, neg, kind in sorted((a, -b, k) for k, a, b in base + extra):
        b = -neg
        if a >= at:
            out += [text[at:a], MASK[kind]]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, digest, listed, scores = [], [], [], []
        for t in b.column(1).to_pylist():
            base = base_spans(t or "")
            extra = scored_spans(t or "", base)
            counts.append(Counter(k for k, *_ in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            listed.append(joined(base + [x[:3] for x in extra]))
            of_base = [score(t, k, x, y, True if k == "card" else None) for k, x, y in base]
            scores.append(",".join(f"{x:.2f}" for x in of_base + [x[3] for x in extra]))
        n = [pa.array([c[k] for c in counts], pa.int64()) for k in BASE]
        yield pa.RecordBatch.from_arrays([b.column(0), *n, *(pa.array(x, pa.string()) for x in (digest, listed, scores))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest, spans and, in the order of spans, their scores."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find, schema)


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with masked texts and their new lengths; all other columns stay."""
    prepare(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def mask(batches):
        for b in batches:
            at = names.index("text")
            texts = [masked(t) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, cols[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array([None if t is None else len(t) for t in texts], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(mask, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(prepare(spark), sf_dir, "documents"))
