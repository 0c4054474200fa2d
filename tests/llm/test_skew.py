"""One hot key or cell is dealt out, with the same results."""

import hashlib

import numpy as np

from lightfold.llm import suffix


def slow(rows, n=50):
    seen, out = {}, []
    for i, t in rows:
        raw = t.encode()
        for a in range(len(raw) - n + 1):
            seen.setdefault(raw[a : a + n], i)
    for i, t in rows:
        raw = t.encode()
        gone = {b for a in range(len(raw) - n + 1) if seen[raw[a : a + n]] < i for b in range(a, a + n)}
        out.append((i, len(gone), hashlib.sha256(bytes(c for b, c in enumerate(raw) if b not in gone)).hexdigest()))
    return out


def test_segments_of_a_hot_key_are_dealt_out(spark, monkeypatch):
    r = np.random.default_rng(8)
    say = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    text = say(200_000)
    key = suffix.window_keys(np.frombuffer(text.encode(), np.uint8))
    at = int(np.flatnonzero(key == key.min())[-1])
    hot = text[at : at + 16]  # the least hash, so the key of all windows around it
    left, right = [say(60) for _ in range(40)], [say(60) for _ in range(7)]
    rows = [(i, say(80) + (left[i % 40][-(i % 61) :] if i % 3 else say(50)) + hot + (right[i % 7][: i % 50] if i % 4 else say(50)) + say(80)) for i in range(300)]
    rows += [(300 + i, "ab" * 90 + hot + "x" * (100 + i)) for i in range(5)]
    most, grouped = [], suffix.grouped

    def watched(df, keys):
        most.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return grouped(df, keys)

    monkeypatch.setattr(suffix, "grouped", watched)
    monkeypatch.setattr(suffix, "MANY", 50, raising=False)
    got = suffix.report_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = slow(rows)
    assert sorted((x["doc_id"], x["n_removed"], x["kept_sha256"]) for x in got) == want
    assert sum(n > 0 for _, n, _ in want) > 50
    assert max(most) <= 50
