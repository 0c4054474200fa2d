"""Importance resampling, exact duplicates and vector codes against brute force, on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lightfold.llm import codes, exact, importance

COLS = "doc_id long, text string, row long, n_features int, suspect string, at string"
rng = np.random.default_rng(11)
WORDS = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 6))) for _ in range(200)]


def prose(n, seed):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


TEXTS = [prose(60, 1), prose(60, 1).replace(" ", "\n\t "), prose(60, 1), prose(19, 2), prose(20, 3), None, "", " \r\n\x0b\x0c", "É é ß 漢字 " * 9, "É é ß 漢字" * 9, prose(30000, 4), prose(30000, 4) + "!", "a-b_c.D " * 12, "x y", "xy", "x y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, 1, "s", "@") for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[0], 0, None, None, None), (None, prose(25, 9), 0, None, None, None), (2, TEXTS[2], 2, 1, "s", "@"), (2, TEXTS[2], 2, 1, "s", "@")]
    return spark.createDataFrame(rows, COLS).repartition(3).cache()


def none(spark):
    return spark.createDataFrame([], COLS)


# ---- importance


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, longest=1, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    have = [(d, *features(t, longest)) for d, t in rows]
    s = collections.Counter(bucket(f) for _, _, fs in have for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, able = [], []
    for d, n, fs in have:
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in fs)
        out.append([d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("percent,longest", [(10, 1), (60, 1), (100, 3)])
def test_importance(spark, docs, percent, longest):
    target = [prose(40, 3), None, "é É"]
    got = importance.importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, longest=longest).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], target, percent, longest)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_importance_without_rows_or_target(spark, docs):
    empty = spark.createDataFrame([], "text string")
    assert importance.importance(none(spark), empty).collect() == []
    got = importance.importance(docs, empty, 100).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, brute([(r["doc_id"], r["text"]) for r in docs.collect()], [], 100)), key=key)


def test_many_ties_are_ranked_once(spark):
    """Rows of one id and text tie in all things; their ranks are 1, 2, 3 ... nevertheless."""
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit(prose(25, 1)).alias("text")).repartition(7)
    got = importance.importance(docs, docs.select("text"), 50).toPandas()
    assert sorted(got["rank"].dropna()) == list(range(1, 1501))
    assert got[got["rank"] <= 1000].doc_id.nunique() == 1


def test_resample_keeps_columns(spark, docs):
    got = importance.resample(docs, docs.select("text"), 50)
    drawn = importance.importance(docs, docs.select("text"), 50).filter("rank is not null").collect()
    assert got.columns == docs.columns
    assert {(r["doc_id"]) for r in got.collect()} == {r["doc_id"] for r in drawn}


def test_scoring_makes_no_rows_of_features(spark, docs):
    plan = importance.weight(F.array(F.lit(3)), list(range(10000)))
    text = docs.select(plan.alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "split" not in text
    assert docs.select(plan.alias("w")).first()["w"] == 3


# ---- exact duplicates


def test_golomb_round_trip():
    for n, top in [(1, 1), (1, 10**12), (500, 3), (500, 10**6), (20000, 1 << 34), (7, 0)]:
        gaps = np.random.default_rng(n).integers(0, top + 1, n)
        code, width = exact.golomb(gaps)
        assert (exact.ungolomb(code, width, n) == gaps).all()
    gaps = np.diff(np.sort(np.random.default_rng(1).integers(0, 1 << 30, 20000)), prepend=0)
    assert len(exact.golomb(gaps)[0]) * 8 / 20000 < np.log2((1 << 30) / 20000) + 1.6  # near the bound of log2(mean gap) + 1.44


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for t, members in groups.items():
        keep = min(members)
        first = True
        for m in sorted(members):
            out.append((m[3], keep[3], len(members), first and m == keep, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return out


def test_exact(spark, docs):
    got = exact.exact_duplicates(docs)
    want = brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert exact.exact_duplicates(none(spark)).collect() == []


def test_exact_across_sources(spark, monkeypatch):
    """Sources of three rows, fingerprints of few bits: false suspects and copies in and across sources."""
    monkeypatch.setattr(exact, "SOURCE_ROWS", 3)
    monkeypatch.setattr(exact, "SPARE_BITS", -3)
    r = np.random.default_rng(5)
    rows = [(int(i), f"t{int(k)}" + " " * int(r.integers(0, 3))) for i, k in enumerate(r.integers(0, 150, 400))] + [(1000 + i, "hot") for i in range(200)]
    made = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, made.collect())) == sorted(brute_exact(rows))


def test_answers_are_by_owner_and_source():
    one, two = exact.golomb(np.array([5, 2, 10])), exact.golomb(np.array([7, 1]))
    t = pa.table({"src": [1, 2], "owner": [0, 0], "code": [one[0], two[0]], "width": [one[1], two[1]], "sent": [3, 2]})
    got = exact.answer(t).to_pylist()  # 5, 7, 17 and 7, 8 share 7
    assert [(g["src"], g["bitmap"]) for g in got] == [(1, bytes([0b01000000])), (2, bytes([0b10000000]))]


def test_drop_copies(spark, docs):
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    want = collections.Counter((d,) for d, _, _, kept, _ in brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()]) if kept)
    assert collections.Counter((r["doc_id"],) for r in got.collect()) == want


def test_texts_move_only_where_suspected(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    name, path = "lightfold_probe", exact.shared_dir(spark) + "/probe"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        found = exact.exchange(exact._rows(docs, F.monotonically_increasing_id()), 500, name, path)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert "Bucketed: true" in plan
    left = plan[plan.index("SortMergeJoin") : plan.index("Bucketed: true")]
    assert "Exchange" not in left and "text" in left  # entries meet the answers where they lie


# ---- vector codes


def full(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def test_partial_distance_search_is_exact():
    r = np.random.default_rng(0)
    for n, k, w, top in [(300, 64, 4, 60), (300, 64, 4, 3), (50, 1, 4, 9), (200, 7, 1, 2), (400, 33, 9, 1000), (64, 64, 4, 0)]:
        x, book = r.integers(-top, top + 1, (n, w)), r.integers(-top, top + 1, (k, w))
        got, want = codes.nearest(x, book), full(x, book)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    fine = sorted(((i, v, lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    if not fine:
        return []
    n = len(fine[0][1])
    q = np.array([[max(-codes.LIMIT, min(codes.LIMIT, math.floor(256 * c))) for c in v] + [0] * (-n % parts) for _, v, _ in fine], np.int64)
    x = q.reshape(len(q), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        found = [full(x[:, p], books[p]) for p in range(parts)]
        if step < rounds:
            for p in range(parts):
                for e in set(found[p][0].tolist()):
                    m = x[found[p][0] == e, p]
                    books[p, e] = [int(c) // len(m) for c in m.sum(0)]
    error = sum(f[1] for f in found)
    by = collections.Counter()
    for (_, _, lab), e in zip(fine, error):
        by[lab] += int(e)
    sha = hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()
    return [(i, "".join(f"{int(f[0][k]):02x}" for f in found), int(error[k]), by[lab], sha) for k, (i, _, lab) in enumerate(fine)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, _of int, _n int"


@pytest.mark.parametrize("width", [32, 64, 20])
def test_codes(spark, width):
    r = np.random.default_rng(width)
    rows = [(i, [float(np.float32(c)) for c in r.normal(0, 0.3, width)], int(r.integers(0, 4)) if i % 3 else None) for i in range(200)]
    rows += [(300, rows[0][1], 1), (300, rows[0][1], 1), (None, rows[1][1], 2), (301, None, 1), (302, [None] + rows[2][1][1:], 1), (303, [float("nan")] + rows[2][1][1:], 1), (304, [float("inf")] + rows[2][1][1:], 1), (305, [], 1), (306, [1.0], 1), (307, [0.0] * width, 1)]
    made = spark.createDataFrame([(*x, "c", 1, 2, 3) for x in rows], VECTORS).repartition(4)
    assert sorted(map(tuple, codes.compress(made).collect()), key=key) == sorted(brute_codes(rows), key=key)


def test_codes_of_few_or_no_vectors(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i, [float(i), 1e30, -1e30] + [0.5] * 13, None) for i in range(3)]
    made = spark.createDataFrame([(*x, "c", 1, 2, 3) for x in rows], VECTORS)
    assert sorted(map(tuple, codes.compress(made).collect())) == sorted(brute_codes(rows))


def test_label_sums_of_hot_and_rare_labels(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"l{i}"), i) for i in range(2000)]
    got = codes.with_label_sum(spark.createDataFrame(rows, "vec_id long, label string, error long"), "label", "error", "s").collect()
    by = collections.Counter()
    for _, lab, e in rows:
        by[lab] += e
    assert sorted((r["vec_id"], r["s"]) for r in got) == [(i, by[lab]) for i, lab, _ in rows]


def test_decode_gives_entries():
    r = np.random.default_rng(3)
    x, books = r.integers(-50, 50, (40, 16)), r.integers(-50, 50, (4, 8, 4))
    code, error = codes.encode(x, books)
    assert (((x - codes.decode(code, books)) ** 2).sum(1) == error.sum(1)).all()
