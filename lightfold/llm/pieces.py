"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

The lattice of a text holds every way to cut it into vocabulary pieces, characters outside the
vocabulary as their bytes. A segmentation's probability is proportional to the product of its
pieces' weights, a piece of rank r weighing 1 / (r + ZIPF) to the power ALPHA. The forward pass sums
weights over all segmentations of each prefix; the backward pass draws a segmentation exactly from
that distribution. No piece joins text across the start of a run of spaces or across a line
end, so the lattice is a chain of independent chunks. Texts are taken together, about SCAN
characters at a time: the forward pass runs over their different chunks, column by column, and
the backward pass over all chunks, step by step.

Uniform numbers come from a counter-based generator keyed by SEED and the row's key (doc_id), so
a row's segmentation does not depend on partitions, order, batches or retries.

Decoding joins the pieces: U+2581 in a piece is a space, and U+2581 in a text is spelled in bytes,
so every text comes back exactly. Null text counts as empty (no ids). Rows with null doc_id share
one key with doc_id 0. Repeated rows with one key and text get one segmentation. An empty table gives an
empty result. Further columns are ignored, whatever their names. Words of over LONG letters draw a
number a step; shorter chunks draw all their steps from one number of 53 bits, so segmentations of
a chunk rarer than about 1 in 2 ** 53 don't come up.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

MODEL = "piece_bpe_32k.model"
ALPHA = 1.0
ZIPF = 10.0
UNKNOWN = -10.0  # log weight of a character in bytes; it has no other way, so this changes nothing
LIFT = 5.0  # log weight that every character adds to every segmentation alike, against underflow
SEED = 5
LONG = 32  # chunks with more characters are passed one by one
SCAN = 1_600_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n-th number in [0, 1) of each key."""
    start = _mix(key.astype(np.uint64) + _U(SEED * 0xD6E8FEB86659FD93 % 2**64))
    return (_mix(start + (n.astype(np.uint64) + _U(1)) * _U(_BASE)) >> _U(11)).astype(np.float64) * 2.0**-53


def own_keys(key: int, order: np.ndarray) -> np.ndarray:
    """A key for each chunk of a row; mixed twice, so that no step in order makes up for one in key."""
    return _mix(_mix(np.full(len(order), key % 2**64, np.uint64)) + order.astype(np.uint64) + _U(1))


class Lattice:
    """Vocabulary and weights."""

    def __init__(self, model: str = MODEL, alpha: float = ALPHA):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.bytes_of: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.byte_id = np.zeros(256, np.int64)
        size = sp.get_piece_size()
        self.weight = np.zeros(size)
        rank = 0
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                rank += 1
                plain = piece.replace("▁", " ")
                self.bytes_of.append(plain.encode())
                self.weight[i] = -alpha * math.log(rank + ZIPF) + LIFT * len(plain)
                if "\n" not in plain and not re.search(r"[^ ] ", plain):
                    self.ids[plain] = i
        self.longest = max(map(len, self.ids))
        # by id; the last two places are for -2, a character in bytes, and -1, no piece
        self.linear = np.concatenate((np.exp(self.weight), [math.exp(UNKNOWN + LIFT), 0.0]))
        self._tables()

    def _tables(self) -> None:
        """Pieces by the hash of their characters: two tables, the second for what collides in the first."""
        names = list(self.ids)
        self.number = np.array([self.ids[n] for n in names], np.int64)
        keys = np.zeros(len(names), np.uint64)
        for i, n in enumerate(names):
            h = 0
            for k, c in enumerate(reversed(n)):
                h = (h + (ord(c) + 1) * pow(_BASE, k, 1 << 64)) % (1 << 64)
            keys[i] = h
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.keys, self.bits, self.slots = keys, 20, []
        left = np.arange(len(keys))
        for odd in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F):
            t = np.full(1 << self.bits, -1, np.int32)
            at = (keys[left] * _U(odd)) >> _U(64 - self.bits)
            t[at[::-1]] = left[::-1]
            self.slots.append((_U(odd), t))
            left = left[t[at] != left]
        if len(left):
            raise ValueError("the tables are too small for the vocabulary")

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The id of the piece with each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for odd, t in self.slots:
            hs = h[todo]
            got = t[(hs * odd) >> _U(64 - self.bits)]
            there = got >= 0
            todo, got, hs = todo[there], got[there], hs[there]
            ok = self.keys[got] == hs
            out[todo[ok]] = self.number[got[ok]]
            todo = todo[~ok]
        return out

    def pieces_ending(self, chars: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """ids[k, l - 1] of the piece of l characters that ends with chars[k], where inside[k] >= l
        characters of its chunk are there; -1: none, -2: the character in bytes."""
        n = len(chars)
        out = np.full((n, self.longest), -1, np.int64)
        h, power = np.zeros(n, np.uint64), 1
        plus = chars.astype(np.uint64) + _U(1)
        rows = np.arange(n)
        for l in range(1, self.longest + 1):
            rows = rows[inside[rows] >= l]
            if not len(rows):
                break
            h[rows] += plus[rows - (l - 1)] * _U(power)
            power = power * _BASE % (1 << 64)
            out[rows, l - 1] = self.lookup(h[rows])
        out[out[:, 0] < 0, 0] = -2
        return out

    def forward(self, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cumulative shares of the pieces that end at each character of chunks of given lengths."""
        weight = self.linear[ids]
        first = np.cumsum(length) - length
        total = np.zeros(len(ids))
        for j in range(int(length.max(initial=0))):
            rows = first[length > j] + j
            w = weight[rows]
            for l in range(1, min(j, self.longest) + 1):
                w[:, l - 1] *= total[rows - l]
            w[:, j + 1 :] = 0.0
            s = w.sum(1)
            total[rows] = s
            weight[rows] = w / s[:, None]
        return np.cumsum(weight, 1)

    def sample_many(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of a sampled segmentation of each text."""
        out: list[np.ndarray] = []
        some, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SCAN or i == len(texts) - 1:
                out += self._together(texts[some : i + 1], keys[some : i + 1])
                some, size = i + 1, 0
        return out

    def _together(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        none = np.zeros(0, np.uint32)
        if not n:
            return [none for _ in texts]
        doc_at = np.cumsum(size) - size
        prev = np.concatenate(([0], chars[:-1]))
        new = (chars == 10) | (prev == 10) | ((chars == 32) & (prev != 32))
        new[doc_at[size > 0]] = True
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, n))
        doc = np.repeat(np.arange(len(texts)), size)[start]
        order = np.arange(len(start)) - np.searchsorted(doc, doc)
        key = np.array([k & (2**64 - 1) for k in keys], np.uint64)
        u = uniform(key[doc], order)
        # different chunks, by hash and length
        power = np.full(n, _U(_BASE))
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n, _U(pow(_BASE, -1, 1 << 64)))
        back[0] = 1
        back = np.multiply.accumulate(back)
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + _U(1)) * power, dtype=np.uint64)))
        name = _mix((summed[start + length] - summed[start]) * back[start]) + length.astype(np.uint64)
        _, first, kind = np.unique(name, return_index=True, return_inverse=True)
        short = length <= LONG
        use = length[first] <= LONG
        begin, wide = start[first[use]], length[first[use]]
        base = np.full(len(first), -1, np.int64)
        base[use] = np.cumsum(wide) - wide
        at = np.repeat(begin - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        inside = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide) + 1
        ids = self.pieces_ending(chars[at], inside)
        share = self.forward(wide, ids)
        # backward, one step of every chunk at a time
        who = np.flatnonzero(short)
        j, v, of = length[who].copy(), u[who], base[kind[who]]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(start), np.int64)
        while len(who):
            rows = of + j - 1
            c = share[rows]
            k = (v[:, None] >= c[:, :-1]).sum(1)
            k = np.minimum(k, np.minimum(j, self.longest) - 1)
            got = ids[rows, k]
            while (bad := np.flatnonzero(got == -1)).size:  # rounding at the end of the shares
                k[bad] -= 1
                got[bad] = ids[rows[bad], k[bad]]
            r = np.arange(len(rows))
            low = np.where(k > 0, c[r, k - 1], 0.0)
            v = np.clip((v - low) / np.maximum(c[r, k] - low, 1e-300), 0.0, 1 - 2.0**-53)
            count[who] += 1
            # a character in bytes is kept as minus its code point, less two
            steps.append((who, np.where(got == -2, -2 - chars[start[who] + j - 1].astype(np.int64), got)))
            j = j - (k + 1)
            go = j > 0
            who, j, v, of = who[go], j[go], v[go], of[go]
        long: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~short):
            long[i] = self._alone("".join(map(chr, chars[start[i] : start[i] + length[i]].tolist())), int(key[doc[i]]), int(order[i]))
            count[i] = len(long[i])
        place = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int64)
        for step, (w, got) in enumerate(steps):
            flat[place[w] + count[w] - 1 - step] = got
        for i, got in long.items():
            flat[place[i] : place[i] + len(got)] = got
        ends = np.append(place, len(flat))
        lo, hi = np.searchsorted(doc, np.arange(len(texts))), np.searchsorted(doc, np.arange(len(texts)), side="right")
        return [self._spelled(flat[ends[a] : ends[b]]) if b > a else none for a, b in zip(lo, hi)]

    def _spelled(self, got: np.ndarray) -> np.ndarray:
        """ids with the characters outside the vocabulary replaced by their bytes."""
        odd = np.flatnonzero(got < 0)
        if not len(odd):
            return got.astype(np.uint32)
        code = -2 - got[odd]
        if code.max() < 128:
            got[odd] = self.byte_id[code]
            return got.astype(np.uint32)
        parts, at = [], 0
        for i, c in zip(odd.tolist(), code.tolist()):
            parts += [got[at:i], self.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))]]
            at = i + 1
        return np.concatenate([*parts, got[at:]]).astype(np.uint32)

    def _alone(self, chunk: str, key: int, order: int) -> np.ndarray:
        """One long chunk: the same two passes in log weights, a uniform number a step."""
        n = len(chunk)
        logs, edges = np.zeros(n + 1), []
        for j in range(1, n + 1):
            here = [(j - l, i) for l in range(1, min(j, self.longest) + 1) if (i := self.ids.get(chunk[j - l : j])) is not None]
            if not here or here[0][0] != j - 1:
                here.insert(0, (j - 1, -2 - ord(chunk[j - 1])))
            w = [logs[s] + (self.weight[i] if i >= 0 else UNKNOWN + LIFT) for s, i in here]
            top = max(w)
            mass = [math.exp(x - top) for x in w]
            total = sum(mass)
            logs[j] = top + math.log(total)
            cum, at = [], 0.0
            for x in mass[:-1]:
                at += x / total
                cum.append(at)
            edges.append((cum, here))
        us = uniform(own_keys(key, np.full(n, order)), np.arange(n))
        parts, j, step = [], n, 0
        while j:
            cum, here = edges[j - 1]
            j, got = here[bisect_right(cum, us[step])]
            parts.append(got)
            step += 1
        return np.array(parts[::-1], np.int64)

    def sample(self, text: str, key: int) -> bytes:
        return self.sample_many([text], [key])[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The text's UTF-8 bytes."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def lattice(model: str = MODEL, alpha: float = ALPHA) -> Lattice:
    return Lattice(model, alpha)


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """doc_id and ids (array of int) of each row's sampled segmentation."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha)
        for b in batches:
            got = [x.astype(np.int32) for x in lat.sample_many([t or "" for t in b.column(1).to_pylist()], [d or 0 for d in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    prepare(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in batches:
            texts = [lat.decode(np.array(i or [], "<u4").tobytes()).decode("utf-8", "surrogatepass") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digest(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """Counts and checksums of each row's sampled ids and of what they decode to."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model, alpha)
        for b in batches:
            n, ids_crc, text_crc, same = [], [], [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for t, got in zip(texts, lat.sample_many(texts, [d or 0 for d in b.column(0).to_pylist()])):
                ids = got.astype("<u4").tobytes()
                back = lat.decode(ids)
                n.append(len(got))
                ids_crc.append(zlib.crc32(ids))
                text_crc.append(zlib.crc32(back))
                same.append(back == t.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(prepare(spark), sf_dir, "documents"))
