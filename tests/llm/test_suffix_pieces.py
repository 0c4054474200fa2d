"""Keys of windows are the same however the bytes are cut, and keys of several texts are found in pieces."""

import numpy as np
import pyarrow as pa

from lightfold.llm import suffix


def test_keys_do_not_depend_on_pieces(monkeypatch):
    buf = np.random.default_rng(1).integers(32, 40, 1003).astype(np.uint8)
    whole = {s: suffix.window_keys(buf, s) for s in (16, 48)}
    seen, concatenate = [], np.concatenate
    monkeypatch.setattr(suffix, "SCAN", 64)
    monkeypatch.setattr(np, "concatenate", lambda x, *a, **k: seen.append(len(x)) or concatenate(x, *a, **k))
    for s, want in whole.items():
        assert np.array_equal(suffix.window_keys(buf, s), want)
    assert seen == [15, 15]


def test_shared_keys():
    m = np.array([5, 5, 7, 9, 9, 5, -3], np.int64)
    k = np.array([1, 1, 2, 4, 3, 1, 8], np.int64)
    (b,) = suffix._shared(iter([pa.RecordBatch.from_arrays([pa.array(m), pa.array(k)], ["m", "k"])]))
    assert b.to_pydict() == {"m": [9, 9], "k": [3, 4]}
    (b,) = suffix._shared(iter([pa.RecordBatch.from_arrays([pa.array(m[:0]), pa.array(k[:0])], ["m", "k"])]))
    assert not b.num_rows
