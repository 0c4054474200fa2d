"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

All strings are aligned at their ends. Round t inserts, for every string of at least t symbols,
its suffix of length t: the suffix t - 1 sits in a known row whose BWT symbol is the new
suffix's first symbol, so the new row follows from counting (the LF mapping), and its common
prefix with the rows above and below follows from the smallest common prefix between equal
symbols (Bauer, Cox & Rosone 2013; Cox, Garofalo, Rosone & Sciortino 2016).

A symbol is a byte, or two: a string of bytes then is two strings, of the pairs from its first
and from its second byte on, which takes half the rounds (see paired).

BWT symbols, common prefixes and suffix names lie in files that each round reads and writes
once, front to back, CHUNK rows at a time; in memory are one chunk and three numbers a string.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 21


class _Minima:
    """Minima of ranges (l, r] of an array, r inclusive."""

    SIDE = 16
    BEFORE = np.where(np.arange(SIDE) < np.arange(SIDE + 1)[:, None], 255, 0).astype(np.uint8)  # row i hides the first i places
    FROM = ~BEFORE  # row i hides all but those

    def __init__(self, values: np.ndarray):
        n = len(values)
        pad = -n % self.SIDE
        self.v = np.concatenate((values, np.full(pad, 255, np.uint8))) if pad else values
        level = self.v
        while len(level) * self.SIDE > len(self.v):
            level = np.minimum(level[::2], level[1::2])
        self.levels = [level]
        while len(level) > 2:
            step = 1 << (len(self.levels) - 1)
            if len(level) <= step:
                break
            level = np.minimum(level[:-step], level[step:])
            self.levels.append(level)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), 255, np.uint8)
        a, b = left + 1, right + 1  # half-open
        for i in range(0, len(left), 1 << 15):
            out[i : i + (1 << 15)] = self._some(a[i : i + (1 << 15)], b[i : i + (1 << 15)])
        return out

    def _some(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        side = self.SIDE
        ba, bb = a // side, (b - 1) // side
        one, same = self.v.reshape(-1, side), ba == bb
        end = b - bb * side
        head = (one[ba] | self.BEFORE[a - ba * side] | self.FROM[np.where(same, end, side)]).min(1)
        tail = (one[bb] | self.FROM[end] | self.BEFORE[np.where(same, a - ba * side, 0)]).min(1)
        out = np.minimum(head, tail)
        inner = np.flatnonzero(bb - ba > 1)
        if len(inner):
            lo, hi = ba[inner] + 1, bb[inner]
            k = np.frexp((hi - lo).astype(np.float64))[1] - 1
            got = np.empty(len(inner), np.uint8)
            for level in np.unique(k):
                w = np.flatnonzero(k == level)
                t = self.levels[level]
                got[w] = np.minimum(t[lo[w]], t[hi[w] - (1 << level)])
            out[inner] = np.minimum(out[inner], got)
        return out


class Collection:
    """The sorted suffixes of strings, as files in folder: bwt, lcp (at most cap) and name.

    strings are given as one array of uint8 or uint16 with first and length of each. A name is
    (string << 8 | suffix length) where lengths stay below 256, as they must.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, cap: int, folder: str, chunk: int = CHUNK):
        if len(length) and length.max() > 255:
            raise ValueError("strings of at most 255 symbols")
        self.data, self.first, self.length = data, first.astype(np.int64), length.astype(np.int64)
        self.cap, self.chunk, self.folder = min(cap, 254), chunk, folder
        self.kind = np.uint32 if len(length) < 1 << 24 else np.uint64
        self.symbols = max(256, int(data.max(initial=0)) + 2)
        self.rows, self.turn = len(length), 0
        self._build()

    def _file(self, what: str, turn: int) -> str:
        return os.path.join(self.folder, f"{what}{turn % 2}")

    def _before(self, strings: np.ndarray, t: int) -> np.ndarray:
        """Symbol before the suffix of length t of each string, plus 1, or 0 at its start."""
        at = self.length[strings] - t - 1
        out = np.zeros(len(strings), self.data.dtype)
        ok = at >= 0
        out[ok] = self.data[self.first[strings[ok]] + at[ok]] + 1  # UTF-8 has no byte 255
        return out

    def _build(self) -> None:
        m = len(self.length)
        every = np.arange(m)
        self._before(every, 0).tofile(self._file("bwt", 0))
        np.zeros(m, np.uint8).tofile(self._file("lcp", 0))
        (every.astype(self.kind) << 8).astype(self.kind).tofile(self._file("name", 0))
        string, row = every, every.copy()
        self.count = np.bincount(self._before(every, 0), minlength=self.symbols)
        for t in range(1, int(self.length.max(initial=0)) + 1):
            ok = self.length[string] >= t
            string, row = string[ok], row[ok]
            string, row = self._round(t, string, row)

    def _round(self, t: int, string: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inserts the suffixes of length t of the strings, whose suffixes t - 1 are in row (rising)."""
        m = len(self.length)
        count = self.count.copy()
        count[0] = 0
        first = m + np.cumsum(count) - count  # first row of each symbol
        seen = np.zeros(self.symbols, np.int64)
        low, was_new = np.zeros(self.symbols, np.uint8), np.zeros(self.symbols, bool)  # since a symbol's last row: least prefix, was it new
        place = np.empty(len(row), np.int64)
        moved_at, moved_to, risen = [], [], []
        for a in range(0, self.rows, self.chunk):
            sym = np.fromfile(self._file("bwt", self.turn), self.data.dtype, self.chunk, offset=a * self.data.itemsize)
            lcp = np.fromfile(self._file("lcp", self.turn), np.uint8, self.chunk, offset=a)
            n = len(sym)
            i, j = np.searchsorted(row, [a, a + n])
            here = row[i:j] - a
            new = np.zeros(n, bool)
            new[here] = True
            order = np.argsort(sym, kind="stable")
            size = np.bincount(sym, minlength=self.symbols)
            start = np.cumsum(size) - size
            fresh = new[order]
            q = np.flatnonzero(fresh)
            s = sym[order[q]]
            at = first[s] + seen[s] + (q - start[s])
            # within a chunk new places rise with q
            rising = i + np.searchsorted(here, order[q])
            place[rising] = at
            risen.append(rising)
            # rows whose prefix changes: new ones, and those right after a new one among equal symbols
            change = fresh.copy()
            change[1:] |= fresh[:-1]
            heads = start[size > 0]
            change[heads] = fresh[heads] | was_new[sym[order[heads]]]
            change[: size[0]] = False  # starts of strings precede nothing
            q = np.flatnonzero(change)
            if len(q):
                s, cur = sym[order[q]], order[q]
                head = q == start[s]
                least = np.zeros(len(q), np.int64)
                minima = _Minima(lcp)
                inside = np.flatnonzero(~head)
                least[inside] = minima(order[q[inside] - 1], cur[inside]).astype(np.int64) + 1
                atop = np.flatnonzero(head & (seen[s] > 0))
                if len(atop):
                    least[atop] = np.minimum(low[s[atop]], minima(np.full(len(atop), -1), cur[atop])).astype(np.int64) + 1
                moved_at.append(first[s] + seen[s] + (q - start[s]))
                moved_to.append(np.minimum(least, self.cap).astype(np.uint8))
            if a + n >= self.rows:
                break
            # what the next chunk needs of this one
            there = np.flatnonzero(size)
            absent = np.flatnonzero(size == 0)
            low[absent] = np.minimum(low[absent], lcp.min())
            last = order[start[there] + size[there] - 1]
            tail = np.full(len(there), 255, np.uint8)
            more = np.flatnonzero(last < n - 1)
            if len(more):
                suffix_min = np.minimum.accumulate(lcp[last[more].min() + 1 :][::-1])[::-1]
                tail[more] = suffix_min[last[more] + 1 - (last[more].min() + 1)]
            low[there], was_new[there] = tail, new[last]
            seen += size
        one = self.rows <= self.chunk
        sort = np.concatenate(risen)
        if not one:
            sort = sort[np.argsort(place[sort], kind="stable")]  # a run a chunk
        place, string = place[sort], string[sort]
        change_at = np.concatenate(moved_at) if moved_at else np.zeros(0, np.int64)
        change_to = np.concatenate(moved_to) if moved_to else np.zeros(0, np.uint8)
        if not one:
            sort = np.argsort(change_at, kind="stable")
            change_at, change_to = change_at[sort], change_to[sort]
        self._merge(t, string, place, change_at, change_to)
        return string, place

    def _merge(self, t: int, string: np.ndarray, place: np.ndarray, change_at: np.ndarray, change_to: np.ndarray) -> None:
        symbol = self._before(string, t)
        name = ((string.astype(self.kind) << 8) | self.kind(t)).astype(self.kind)
        total, old = self.rows + len(place), 0
        # the files of the turn before last are written over, since every turn's are longer; emptying them first is slow
        out = {k: open(self._file(k, self.turn + 1), "r+b" if self.turn else "wb") for k in ("bwt", "lcp", "name")}  # noqa: SIM115
        for a in range(0, total, self.chunk):
            n = min(self.chunk, total - a)
            i, j = np.searchsorted(place, [a, a + n])
            new = np.zeros(n, bool)
            new[place[i:j] - a] = True
            kept, rest = ~new, n - (j - i)
            for what, values, kind in (("bwt", symbol, self.data.dtype), ("lcp", None, np.uint8), ("name", name, self.kind)):
                block = np.zeros(n, kind)
                block[kept] = np.fromfile(self._file(what, self.turn), kind, rest, offset=old * np.dtype(kind).itemsize)
                if values is None:
                    x, y = np.searchsorted(change_at, [a, a + n])
                    block[change_at[x:y] - a] = change_to[x:y]
                else:
                    block[new] = values[i:j]
                block.tofile(out[what])
            old += rest
        for f in out.values():
            f.close()
        self.turn, self.rows = self.turn + 1, total
        self.count = self.count + np.bincount(symbol, minlength=self.symbols)

    def sorted_suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of (string, suffix length, common prefix with the row before), in order."""
        for a in range(0, self.rows, self.chunk):
            name = np.fromfile(self._file("name", self.turn), self.kind, self.chunk, offset=a * np.dtype(self.kind).itemsize)
            lcp = np.fromfile(self._file("lcp", self.turn), np.uint8, self.chunk, offset=a)
            yield (name >> self.kind(8)).astype(np.int64), (name & self.kind(255)).astype(np.int64), lcp


def paired(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, first, length, string, offset): the pairs of bytes of strings, from offset 0 and from offset 1 on.

    Equal pairs are equal numbers, counted from 0 on.
    """
    string = np.repeat(np.arange(len(length)), 2)
    offset = np.tile([0, 1], len(length))
    size = (length[string] - offset) // 2
    begin = np.cumsum(size) - size
    at = 2 * (np.arange(size.sum()) - np.repeat(begin, size)) + np.repeat(first[string] + offset, size)
    pairs = (data[at].astype(np.uint16) << np.uint16(8)) | data[at + 1]
    used = np.zeros(1 << 16, bool)
    used[pairs] = True
    return (np.cumsum(used) - 1).astype(np.uint16)[pairs], begin, size, string, offset


def least_owner(c: Collection, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, firsts): for each string and each of its windows of width symbols, the least owner
    of any string that holds the same window. Windows of string i start at values[firsts[i]]."""
    windows = np.maximum(c.length - width + 1, 0)
    firsts = np.cumsum(windows) - windows
    values = np.repeat(owner, windows)
    held_at, held_least = np.zeros(0, np.int64), None  # the group that the last chunk left open
    for string, size, lcp in c.sorted_suffixes():
        whole = size >= width
        at = np.where(whole, firsts[string] + c.length[string] - size, -1)
        own = np.where(whole, owner[string], np.iinfo(np.int64).max)
        same = (lcp >= width) & whole
        start = np.flatnonzero(~same)
        joins = len(same) and same[0]
        if len(start) == 0 or start[0] != 0:
            start = np.concatenate(([0], start))
        least = np.minimum.reduceat(own, start)
        if held_least is not None and joins:
            least[0] = min(least[0], held_least)
            if least[0] < held_least:
                values[held_at] = least[0]
        each = np.repeat(least, np.diff(np.append(start, len(own))))
        ok = at >= 0
        values[at[ok]] = each[ok]
        tail = at[start[-1] :]
        tail = tail[tail >= 0]
        if joins and len(start) == 1:
            held_at = np.concatenate((held_at, tail))
        else:
            held_at = tail
        held_least = least[-1]
    return values, firsts
