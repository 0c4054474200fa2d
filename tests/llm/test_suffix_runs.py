"""What op10's steps hand on is packed: keys by part, owners by runs, byte ranges by text."""

import numpy as np
import pyarrow as pa

from lightfold.llm import suffix
from lightfold.llm.collection import Collection, least_owner, paired


def test_keys_are_packed_by_part():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 4000).astype(np.uint8)) for _ in range(400)]
    texts[7] = texts[300]
    k = np.arange(400)
    k[7] = k[300]
    given = pa.RecordBatch.from_arrays([pa.array(k), pa.array([t.decode() for t in texts])], ["k", "t"])
    packed = list(suffix._keys(iter([given, given.slice(0, 0)])))
    got = sorted((m, x) for b in packed for m, x in suffix._unpacked(b.column(1), 2).T.tolist())
    want = []
    for x, t in zip(k.tolist(), texts):
        if (x, t) != (300, texts[300]) or not any(y == 300 for _, y in want):
            want += [(m, x) for m in suffix.segments([t])[3].view(np.int64).tolist()]
    assert got == sorted(want)
    assert sum(b.num_rows for b in packed) <= suffix.DEALT < len(want) / 4
    assert all(m % suffix.DEALT == p for b in packed for p, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in np.frombuffer(held, np.int64)[::2].tolist())


def test_shared_keys_of_a_text_are_one_row(monkeypatch):
    monkeypatch.setattr(suffix, "TEXTS", 2)
    rows = [(1, [5, 9]), (2, [5]), (3, [9, 4]), (4, [8])]
    m, k = np.array([x for _, ms in rows for x in ms]), np.array([k for k, ms in rows for _ in ms])
    (got,) = suffix._shared_packed(iter([suffix._packed(4, m, m, k)]))
    assert got.column(0).to_pylist() == [0, 1]
    more = suffix._packed(2, np.array([2]), np.array([7]), np.array([2]))
    sorted_ = pa.Table.from_batches([got, more]).sort_by("part").combine_chunks().to_batches()
    one = pa.Table.from_batches(suffix._gathered(iter(sorted_)))
    assert sorted((k, sorted(np.frombuffer(ms, np.int64).tolist())) for k, ms in zip(*one.to_pydict().values())) == [(1, [5, 9]), (2, [5, 7]), (3, [9])]
    assert not list(suffix._gathered(iter([])))


def test_owners_are_runs_and_idle_segments_are_left_out():
    rng = np.random.default_rng(4)
    a, b, c = (bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (60, 80, 70))
    rows = [
        (1, 10, a, 5, 9),  # alone in its group, in several texts: one run
        (2, 20, b, 4, 4),  # its end is in a text of its own: nothing to take away
        (2, 21, b[:65], 6, 6),  # all its windows are in a smaller text
        (2, 22, c + b[:52], 7, 7),  # its last three windows are
        (3, 30, c, 8, 8),  # alone, in one text
    ]
    m, h, body, owner, last = zip(*rows)
    given = pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), pa.array(owner), pa.array(last), pa.array(body, pa.binary())], ["m", "h", "owner", "last", "body"])
    got = {h: o for r in suffix._owners(iter([given])) for h, o in zip(r.column("h").to_pylist(), r.column("owners").to_pylist())}
    assert got == {10: [11, 5], 21: [16, 4], 22: [70, 7, 3, 4]}


def test_ranges_are_one_row_a_text():
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1, 1, 2, 1]), pa.array([9, 9, 9, 3]), pa.array([100, 0, 7, 0]), pa.array([[3, 1, 4, 9, 2, 2], [5, 8], [6, 9], [2, 1]])], ["k", "first", "start", "owners"]
    )
    (got,) = suffix._runs_removed(iter([rows]))
    want = [(1, 3, 0, 51), (1, 9, 0, 54), (1, 9, 100, 152), (1, 9, 107, 158)]
    assert got.num_rows == 1 and sorted(map(tuple, suffix._unpacked(got.column(1), 4).T.tolist())) == want
    more = suffix._packed(suffix.TEXTS, *(np.array(x) for x in ([1, 1, 2], [1, 1, 2], [9, 9, 4], [50, 70, 0], [60, 80, 55])))
    both = pa.Table.from_batches([got, more]).sort_by("part").combine_chunks().to_batches()
    one = pa.Table.from_batches(suffix._joined(iter(both)))
    spans = {(k, f): [(x["a"], x["z"]) for x in s] for k, f, s in zip(*one.to_pydict().values())}
    assert spans == {(1, 3): [(0, 51)], (1, 9): [(0, 60), (70, 80), (100, 158)], (2, 4): [(0, 55)]}


def test_pairs_of_bytes_find_the_windows_that_bytes_find(tmp_path):
    rng = np.random.default_rng(6)
    for width, hi in ((4, 2), (10, 3)):
        size = rng.integers(width, 40, 60)
        first = np.cumsum(size) - size
        data = rng.integers(97, 97 + hi, size.sum()).astype(np.uint8)
        owner = rng.permutation(60)
        folder = tmp_path / f"{width}"
        other = tmp_path / f"{width}p"
        folder.mkdir()
        other.mkdir()
        want, at = least_owner(Collection(data, first, size, width, str(folder)), owner, width)
        pairs, first2, size2, string, offset = paired(data, first, size)
        c = Collection(pairs, first2, size2, width // 2, str(other), chunk=97)
        got, at2 = least_owner(c, owner[string], width // 2)
        assert c.turn <= 20 < size.max() <= 40
        n = np.maximum(size2 - width // 2 + 1, 0)
        back = np.empty_like(want)
        back[np.repeat(at[string] + offset, n) + 2 * (np.arange(len(got)) - np.repeat(at2, n))] = got
        assert len(got) == len(want) and np.array_equal(back, want)
