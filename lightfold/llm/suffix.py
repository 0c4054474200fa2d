"""Exact removal of repeated passages by a suffix collection.

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller doc_id.

1. Each 50-byte window names the least hash of its 16-byte strings. Equal windows name the same,
   so windows can be compared key by key; runs of windows with one key form a segment. Keys that
   occur in one text alone are done with.
2. Texts with other keys give their segments; equal segments are collapsed to their least doc_id,
   so a passage in very many documents is one string, not one a document.
3. Of a key's different segments, windows whose second key, the least hash of their LONGER-byte
   strings, is in one segment alone are left out, and what is then equal is collapsed again. The strings of all keys that still have
   several form collections. Of a key with more than MANY segments the windows are dealt by both
   keys, so that no task holds all its segments. Each collection's Burrows-Wheeler transform and common prefixes are
   built column by column in files, on pairs of bytes (see collection); rows with common prefixes of 25 pairs
   or more are equal windows, and each window learns the least doc_id that holds it. A key left with a single
   string needs no construction: that string's owner is known.
4. Windows whose least doc_id is smaller than their document's are removed from its text.

Equal texts are one text with the least doc_id of its rows; its other rows lose every byte if
they are LENGTH long. A text is told by two 64-bit hashes. All decisions are on the input, matches
never cross documents.

Null text counts as empty. A null doc_id counts as larger than all others, and rows of equal
doc_id do not remove each other's bytes. Texts shorter than LENGTH lose nothing. Very long
texts and very many repeats only add rows. What passes in large numbers (keys, ranges) is packed: a row
holds the numbers of one part of DEALT or TEXTS, as bytes, and a task that brings texts together holds one part at a time. An empty table gives an empty result. Other columns
may have any names: report_repeats ignores them, remove_repeats keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grouped, runs
from .collection import Collection, least_owner, paired
from .common import cut, discard, drop_tmp, fresh, prepare, table, task_tmp

LENGTH = 50
SHORT = 16
LONGER = 48  # bytes of the strings that a window's second key is the least hash of
LONGEST = 64  # windows in a segment
MANY = 4_000  # different segments of a key that are brought together; those of other keys are dealt by both keys
COLLECTION = 8 << 20  # bytes of different segments in one collection
SCAN = 1 << 15  # bytes of text that are hashed at once: arrays of numbers for each byte then stay in a core's cache
DEALT = 1 << 12  # parts that keys are dealt into; a row holds a part's keys of many texts
TEXTS = 1 << 10  # parts that texts are dealt into when what was found of them is brought together
LAST = (1 << 63) - 1
_BYTES = np.random.default_rng(77).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = (np.random.default_rng(78).integers(0, 2**63, 8).astype(np.uint64) | np.uint64(1)).tolist()


def window_keys(buf: np.ndarray, short: int = SHORT) -> np.ndarray:
    """For each LENGTH-byte window of buf the least hash of its `short`-byte strings; short is a multiple of 8."""
    if len(buf) > 2 * SCAN:
        return np.concatenate([window_keys(buf[a : a + SCAN + LENGTH - 1], short) for a in range(0, len(buf) - LENGTH + 1, SCAN)])
    h, m, done = _BYTES[buf], 1, {}
    while m * 2 <= short:
        h = h[:-m] * np.uint64(_ODD[m.bit_length() - 1]) + h[m:]
        m *= 2
        done[m] = h
    if m < short:
        more = done[short - m]
        n = len(buf) - short + 1
        h = h[:n] * np.uint64(_ODD[7]) + more[m : m + n]
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    w, m = LENGTH - short + 1, 1
    while m * 2 <= w:
        h = np.minimum(h[:-m], h[m:])
        m *= 2
    return np.minimum(h[: len(h) - (w - m)], h[w - m :]) if m < w else h


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, windows, key) of each run of windows with one key, LONGEST at most."""
    parts = []

    def scan(lo: int, some: list[bytes]) -> None:
        buf = np.frombuffer(b"".join(some), np.uint8)
        if len(buf) < LENGTH:
            return
        size = np.array([len(x) for x in some])
        first = np.cumsum(size) - size
        key = window_keys(buf)
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        fits = np.flatnonzero(size >= LENGTH)
        new[first[fits]] = True
        end = first + np.maximum(size - LENGTH + 1, 0)  # where a text's windows end
        for a, z in zip(end.tolist(), (first + size).tolist()):
            new[a:z] = False
        start = np.flatnonzero(new)
        if not len(start):
            return
        text = fits[np.searchsorted(first[fits], start, "right") - 1]
        n = np.minimum(np.append(start[1:], len(key)), end[text]) - start
        pieces = -(-n // LONGEST)
        if pieces.max() > 1:
            back = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            text, start, n = np.repeat(text, pieces), np.repeat(start, pieces) + back * LONGEST, np.minimum(np.repeat(n, pieces) - back * LONGEST, LONGEST)
        parts.append((text + lo, start - first[text], n, key[start]))

    lo, some, size = 0, [], 0
    for i, t in enumerate(texts):
        some.append(t)
        size += len(t)
        if size >= SCAN:
            scan(lo, some)
            lo, some, size = i + 1, [], 0
    if some:
        scan(lo, some)
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _packed(parts: int, by: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """(part, held): the rows of 64-bit columns whose `by` is in one of so many parts, as the bytes of their numbers."""
    part = (by & (parts - 1)).astype(np.uint16)
    o = np.argsort(part, kind="stable")
    part = part[o]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    ends = np.append(at, len(part)) * 8 * len(columns)
    held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.stack(columns, axis=1)[o].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), held], ["part", "held"])


def _unpacked(column: pa.Array | pa.ChunkedArray, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, columns).T


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, k) of the keys of each text, packed by m. Of equal texts of a batch only the first gives its keys."""
    ms, ks, size = [], [], 0
    for b in batches:
        name = dict(zip(reversed(_raw(b.column(1))), range(b.num_rows - 1, -1, -1)))
        text, _, _, key = segments(list(name))
        if not len(key):
            continue
        ms.append(key.view(np.int64))
        ks.append(b.column(0).to_numpy()[list(name.values())][text])
        size += len(key)
        if size >= 1 << 18:
            m, k = np.concatenate(ms), np.concatenate(ks)
            ms, ks, size = [], [], 0
            yield _packed(DEALT, m, m, k)
    if ms:
        m, k = np.concatenate(ms), np.concatenate(ks)
        yield _packed(DEALT, m, m, k)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (m, k) whose m occurs with two k or more.

    Reads a piece at a time. Kept between pieces are one k for each m seen once so far and the
    list of m seen with several, so a key with very many texts takes no more room than another.
    """
    one_m, one_k, many = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def piece(m: np.ndarray, k: np.ndarray):
        nonlocal one_m, one_k, many
        m, k = np.concatenate((one_m, m)), np.concatenate((one_k, k))
        if not len(m):
            return m, k
        o = np.argsort(m)
        m, k = m[o], k[o]
        first = np.ones(len(m), bool)
        first[1:] = m[1:] != m[:-1]
        at = np.flatnonzero(first)
        least, most = np.minimum.reduceat(k, at), np.maximum.reduceat(k, at)
        known = np.zeros(len(at), bool)
        if len(many):
            known = many[np.minimum(np.searchsorted(many, m[at]), len(many) - 1)] == m[at]
        hot = (least < most) | known
        out = np.repeat(hot, np.diff(np.append(at, len(m))))
        many = np.union1d(many, m[at][hot & ~known])
        one_m, one_k = m[at][~hot], least[~hot]
        m, k = m[out], k[out]
        o = np.lexsort((k, m))
        m, k = m[o], k[o]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (k[1:] != k[:-1])
        return m[new], k[new]

    ms, ks, n = [], [], 0
    for b in batches:
        ms.append(b.column(0).to_numpy())
        ks.append(b.column(1).to_numpy())
        n += b.num_rows
        if n >= 1 << 21:
            m, k = piece(np.concatenate(ms), np.concatenate(ks))
            ms, ks, n = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(k)], ["m", "k"])
    if ms:
        m, k = piece(np.concatenate(ms), np.concatenate(ks))
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(k)], ["m", "k"])


def _shared_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, k) of the shared keys, packed by k, from keys packed by m."""
    rows = (pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(_unpacked(b.column(1), 2))], ["m", "k"]) for b in batches)
    for b in _shared(rows):
        m, k = b.column(0).to_numpy(), b.column(1).to_numpy()
        yield _packed(TEXTS, k, m, k)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, ms): the shared keys of each text as the bytes of their numbers, from (m, k) packed by k and sorted by part."""
    for t, _ in runs(batches, ["part"]):
        m, k = _unpacked(t.column("held"), 2)
        o = np.argsort(k)
        m, k = m[o], k[o]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
        ends = np.append(at, len(k)) * 8
        ms = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(m.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(k[at]), ms], ["k", "ms"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each text that have shared keys, with their bytes."""
    for b in batches:
        k, first, text_col, keys = (b.column(i) for i in range(4))
        raw = _raw(text_col)
        text, start, n, key = segments(raw)
        if not len(key):
            continue
        of = np.repeat(np.arange(len(raw)), pa.compute.binary_length(keys).to_numpy() // 8)
        mark = lambda t, m: m ^ (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ok = np.isin(mark(text, key), mark(of, _unpacked(keys, 1)[0].view(np.uint64)))
        text, start, n, key = text[ok], start[ok], n[ok], key[ok]
        for i in range(0, len(key), 50_000):
            t, s, w = text[i : i + 50_000], start[i : i + 50_000], n[i : i + 50_000]
            body = [raw[x][a : a + c] for x, a, c in zip(t.tolist(), s.tolist(), (w + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000].view(np.int64)), pa.array(body, pa.binary()), k.take(pa.array(t)), first.take(pa.array(t)), pa.array(s, pa.int64())], ["m", "body", "k", "first", "start"])


def second_runs(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(second key, string, start, windows) of each run of windows with one least hash of LONGER-byte strings."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    key = window_keys(data, LONGER)
    string = np.repeat(np.arange(len(size)), size)[: len(key)]
    pos = np.arange(len(key)) - first[string]
    whole = pos + LENGTH <= size[string]
    new = whole.copy()
    new[1:] &= (key[1:] != key[:-1]) | (string[1:] != string[:-1])
    at = np.flatnonzero(new)
    held = np.concatenate(([0], np.cumsum(whole)))
    n = held[np.append(at[1:], len(key))] - held[at]
    return key[at], string[at], pos[at], n


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, q, h, at, owner, last, body): the runs of one second key q of each segment, with their bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        m, h, owner, last, body = (b.column(i) for i in range(5))
        raw = body.to_pylist()
        size = np.array([len(x) for x in raw], np.int64)
        q, string, start, n = second_runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
        part = [raw[i][a : a + w] for i, a, w in zip(string.tolist(), start.tolist(), (n + LENGTH - 1).tolist())]
        of = pa.array(string)
        yield pa.RecordBatch.from_arrays([m.take(of), pa.array(q.view(np.int64)), h.take(of), pa.array(start), owner.take(of), last.take(of), pa.array(part, pa.binary())], ["m", "q", "h", "at", "owner", "last", "body"])


def trimmed(data: np.ndarray, first: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, windows): the runs of windows that another string of the group may hold too.

    Equal windows also name the same least hash of longer strings, so a window whose second key is
    in one string of its group alone is in no other string.
    """
    none = np.zeros(0, np.int64)
    key, owner, start, n = second_runs(data, first, size)
    if not len(key):
        return none, none, none
    k = key ^ (group[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    o = np.lexsort((owner, k))
    begin = np.flatnonzero(np.append(True, k[o][1:] != k[o][:-1]))
    several = owner[o][begin] != owner[o][np.append(begin[1:], len(o)) - 1]
    ok = np.zeros(len(k), bool)
    ok[o] = np.repeat(several, np.diff(np.append(begin, len(o))))
    start, n, owner = start[ok], n[ok], owner[ok]
    if not len(start):
        return none, none, none
    joins = np.zeros(len(start), bool)
    joins[1:] = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1] + n[:-1])
    head = np.flatnonzero(~joins)
    return owner[head], start[head], np.add.reduceat(n, head)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each different segment the least owner of each of its windows: windows, owner, windows, owner, and so on.

    Segments none of whose windows has an owner below the last text that holds the segment take nothing from any text and are left out.
    """

    def emit(t: pa.Table, n: np.ndarray, owner: np.ndarray, row: np.ndarray):
        """n windows with an owner a run, whose segment is a row of t; every row has a run."""
        used = np.zeros(t.num_rows, bool)
        used[row[owner < t.column("last").to_numpy()[row]]] = True
        keep = used[row]
        flat = np.stack([n[keep], owner[keep]], axis=1).ravel()
        t = t.select(["m", "h"]).filter(pa.array(used))
        size = np.bincount(row, minlength=len(used))[used] * 2
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([t.column("m").combine_chunks(), t.column("h").combine_chunks(), lists], ["m", "h", "owners"])

    def build(tables: list[pa.Table]):
        t = pa.concat_tables(tables)
        m, own = t.column("m").to_numpy(), t.column("owner").to_numpy()
        body = t.column("body").combine_chunks()
        size = pa.compute.binary_length(body).to_numpy().astype(np.int64)
        raw = b"".join(body.to_pylist())
        data, first, n = np.frombuffer(raw, np.uint8), np.cumsum(size) - size, size - LENGTH + 1
        flat, firsts = np.repeat(own, n), np.cumsum(n) - n
        string, start, w = trimmed(data, first, size, m)
        # equal runs of a group are one string with the least owner
        known: dict[tuple[int, bytes], int] = {}
        a = (first[string] + start).tolist()
        kind = np.array([known.setdefault((g, raw[x:y]), len(known)) for g, x, y in zip(m[string].tolist(), a, (first[string] + start + w + LENGTH - 1).tolist())], np.int64)
        if len(known):
            least = np.full(len(known), LAST, np.int64)
            np.minimum.at(least, kind, own[string])
            group = np.array([g for g, _ in known], np.int64)
            _, back, copies = np.unique(group, return_inverse=True, return_counts=True)
            texts = [x for _, x in known]
            width = np.array([len(x) for x in texts], np.int64) - LENGTH + 1
            begin = np.cumsum(width) - width
            values = np.repeat(least, width)
            rest_ = np.flatnonzero(copies[back] > 1)
            if len(rest_):
                part = [texts[i] for i in rest_]
                long = np.array([len(x) for x in part], np.int64)
                folder = task_tmp()
                try:
                    pairs, at, size, of, offset = paired(np.frombuffer(b"".join(part), np.uint8), np.cumsum(long) - long, long)
                    c = Collection(pairs, at, size, LENGTH // 2, folder)
                    got, at = least_owner(c, least[rest_][of], LENGTH // 2)
                finally:
                    drop_tmp(folder)
                n_at = np.maximum(size - LENGTH // 2 + 1, 0)
                values[np.repeat(begin[rest_][of] + offset, n_at) + 2 * (np.arange(len(got)) - np.repeat(at, n_at))] = got
            run = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            flat[np.repeat(firsts[string] + start, w) + run] = values[np.repeat(begin[kind], w) + run]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[firsts] = True
        at = np.flatnonzero(new)
        return emit(t, np.diff(np.append(at, len(flat))), flat[at], np.cumsum(np.bincount(firsts, minlength=len(flat)))[at] - 1)

    held, size = [], 0
    for t, start in runs(batches, ["m"]):
        n = np.diff(np.append(start, t.num_rows))
        alone = start[n == 1]
        if len(alone):
            a = t.take(pa.array(alone))
            w = pa.compute.binary_length(a.column("body")).to_numpy().astype(np.int64) - LENGTH + 1
            yield emit(a, w, a.column("owner").to_numpy(), np.arange(len(w)))
        if len(alone) < len(start):
            several = t.filter(pa.array(np.repeat(n > 1, n)))
            held.append(several)
            size += pa.compute.sum(pa.compute.binary_length(several.column("body"))).as_py()
            if size >= COLLECTION:
                yield build(held)
                held, size = [], 0
    if held:
        yield build(held)


def _runs_removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, first, a, z) of byte ranges to remove, packed by k, from segments with their windows' owners."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        k, first, start, owners = (b.column(i) for i in range(4))
        flat, each = owners.flatten().to_numpy(), owners.value_lengths().to_numpy() // 2
        row, n = np.repeat(np.arange(len(each)), each), flat[::2]
        before = np.cumsum(n) - n
        pos = start.to_numpy()[row] + before - before[np.cumsum(each) - each][row]
        hit = flat[1::2] < first.to_numpy()[row]
        row, pos, n = row[hit], pos[hit], n[hit]
        if not len(row):
            continue
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(row)) - 1
        held.append((k.to_numpy()[row[a]], first.to_numpy()[row[a]], pos[a], pos[z] + n[z] + LENGTH - 1))
        size += len(a)
        if size >= 1 << 18:
            found = [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
            yield _packed(TEXTS, found[0], *found)
    if held:
        found = [np.concatenate(x) for x in zip(*held)]
        yield _packed(TEXTS, found[0], *found)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, first, spans) with one row a text and overlapping ranges joined, from ranges packed by k and sorted by part."""
    for t, _ in runs(batches, ["part"]):
        found = _unpacked(t.column("held"), 4)
        k, first, a, z = found[:, np.lexsort((found[2], found[1], found[0]))]
        new = np.append(True, (k[1:] != k[:-1]) | (first[1:] != first[:-1]))[: len(k)]
        start, text = np.flatnonzero(new), np.cumsum(new) - 1
        # ends so far, each text's above those of the texts before it
        step = int(z.max(initial=0)) + 1
        far = np.maximum.accumulate(z + text * step)
        new[1:] |= (a + text * step)[1:] > far[:-1]
        at = np.flatnonzero(new)
        ends = (far - text * step)[np.append(at[1:], len(a)) - 1]
        spans = pa.StructArray.from_arrays([pa.array(a[at]), pa.array(ends)], ["a", "z"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[at], np.arange(len(start) + 1)), pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([pa.array(k[start]), pa.array(first[start]), lists], ["k", "first", "spans"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def dealt(segments_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners (m, h, owners, at) of the windows of segments (m, h, owner, last, body) whose keys have very many, and a table to discard.

    Their windows are dealt by both keys, so what meets in a task holds one LONGER-byte string and
    LENGTH - LONGER further bytes a window. Second keys of a single segment are done with before
    bytes are moved, equal strings are collapsed before a collection is built.
    """
    windows = (F.octet_length("body") - (LENGTH - 1)).cast("long")
    whole = segments_.filter("owner < last").select("m", "h", F.array(windows, "owner").alias("owners"), F.lit(0).cast("long").alias("at"))
    pieces = segments_.select("m", "h", "owner", "last", "body").mapInArrow(_second, "m long, q long, h long, at long, owner long, last long, body binary")
    several = pieces.groupBy("m", "q").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("m", "q")
    # a hash of both keys may join groups, whose strings still are compared byte by byte
    g, name = F.xxhash64("m", "q").alias("g"), F.xxhash64("body").alias("s")
    shared = cut(pieces.join(several, ["m", "q"], "left_semi").select(g, name, "m", "h", "at", "owner", "last", "body"), "dealt")
    strings = shared.groupBy("g", "body").agg(F.min("owner").alias("owner"), F.max("last").alias("last")).select(F.col("g").alias("m"), "body", F.xxhash64("body").alias("h"), "owner", "last")
    owners = grouped(strings, ["m"]).mapInArrow(_owners, "m long, h long, owners array<long>").withColumnsRenamed({"m": "g", "h": "s"})
    return whole.union(shared.select("g", "s", "m", "h", "at").join(owners, ["g", "s"]).select("m", "h", "owners", "at")), shared


def identity(raw: F.Column) -> tuple[F.Column, F.Column]:
    """The two names of a text. Keys are counted and dealt by the first; whether texts are equal takes both."""
    return F.xxhash64(raw, F.octet_length(raw)), F.xxhash64(F.lit(7), raw)


SPANS = "spans"


def with_removals(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of the byte ranges to remove, as array<struct<a, z>>, null where nothing goes, and its name.

    A range from 0 to -1 stands for the whole text (a later copy of another row's text).
    """
    prepare(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k, k2 = identity(raw)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord")
    long_enough = F.octet_length(raw) >= LENGTH
    given = docs.select(k.alias("k"), k2.alias("k2"), order, raw.alias("t"), long_enough.alias("fits")).filter("fits").drop("fits")
    pairs = given.select("k", "t").mapInArrow(_keys, "part int, held binary")
    shared = pairs.repartition("part").mapInArrow(_shared_packed, "part int, held binary")
    least = given.groupBy("k", "k2").agg(F.min("ord").alias("first"))
    wanted = cut(grouped(shared, ["part"]).mapInArrow(_gathered, "k long, ms binary").join(least, "k"), "wanted")
    texts = given.join(wanted, ["k", "k2"]).filter("ord = first").select("k", "first", "t", "ms")
    parts = cut(texts.mapInArrow(_contents, "m long, body binary, k long, first long, start long"), "segments")
    discard(wanted)
    h = F.xxhash64("body").alias("h")
    different = cut(parts.groupBy("m", "body").agg(F.min("first").alias("owner"), F.max("first").alias("last")).select("m", "body", h, "owner", "last"), "different")
    hot = cut(different.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("m"), "hot")
    done, few = [hot], different
    any_hot = bool(hot.take(1))
    if any_hot:
        few = different.join(hot, "m", "left_anti").select("m", "body", "h", "owner", "last")
    owners = grouped(few, ["m"]).mapInArrow(_owners, "m long, h long, owners array<long>").withColumn("at", F.lit(0).cast("long"))
    if any_hot:
        more, shared_runs = dealt(different.join(hot, "m", "left_semi"))
        owners = owners.union(more)
        done.append(shared_runs)
    found = parts.select("k", "first", "start", "m", h).join(owners, ["m", "h"]).select("k", "first", (F.col("start") + F.col("at")).alias("start"), "owners").mapInArrow(_runs_removed, "part int, held binary")
    spans = cut(grouped(found, ["part"]).mapInArrow(_joined, "k long, first long, spans array<struct<a: long, z: long>>"), "spans")
    discard(parts)
    discard(different)
    for t in done:
        discard(t)
    known = least.join(spans, ["k", "first"], "left")
    # the columns of docs ride in one struct, so that none of their names can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k.alias("k"), k2.alias("k2"), order)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("z")))
    name = fresh(docs, SPANS)
    out = rows.join(known, ["k", "k2"], "left")
    return out.select("row.*", F.when(F.col("ord") > F.col("first"), whole).otherwise(F.col("spans")).alias(name)), name


def ranges(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    if not spans:
        return []
    if spans[0]["z"] < 0:
        return [(0, n)] if n else []
    return merged([(s["a"], s["z"]) for s in spans])


def rest(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in cuts:
        out.append(raw[at:a])
        at = z
    return b"".join(out) + raw[at:]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw, spans in zip(_raw(b.column(1)), b.column(2).to_pylist()):
            cuts = ranges(spans, len(raw))
            rows.append((len(raw), sum(z - a for a, z in cuts), len(cuts), hashlib.sha256(rest(raw, cuts)).hexdigest()))
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report_repeats(docs: DataFrame) -> DataFrame:
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return with_removals(given)[0].mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def on_characters(raw: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """cuts drawn in to whole characters, so that what is left is text: a character stays if a byte of it stays."""
    out = []
    for a, z in cuts:
        while a < z and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages taken out of the texts and n_chars renewed; every row stays."""
    names, schema = docs.columns, docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("text")
            kept = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                if t and spans:
                    raw = t.encode("utf-8", "surrogatepass")
                    t = rest(raw, on_characters(raw, ranges(spans, len(raw)))).decode("utf-8", "surrogatepass")
                kept.append(t)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(kept, cols[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array([None if t is None else len(t) for t in kept], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return with_removals(docs)[0].mapInArrow(work, schema)


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_repeats(table(prepare(spark), sf_dir, "documents"))
