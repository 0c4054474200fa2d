"""Exact duplicates by exchanging Golomb-coded fingerprints, so that only suspects are shuffled.

Texts are equal when they are identical after deleting white space (`[\\x20\\x09-\\x0D]`).

1. A source is a run of rows of one task, bounded by rows and bytes. It merges its own equal texts
   (compared byte by byte) into one entry with the ids of its rows, and sends each owner the sorted
   fingerprints of its entries as a Golomb code of their gaps. A fingerprint has log2(rows) + 8
   bits, so that a text without copies is suspected with a chance of about 1 in 256, and an owner
   holds an equal part of the range of fingerprints.
2. An owner decodes what all sources sent it, and answers each with one bit a fingerprint: whether
   another entry of any source has it too.
3. Entries that no other entry shares are done with. Suspects are grouped by their bytes, which
   Spark aggregates within tasks before the shuffle: of a text in a third of all rows a task sends
   one copy. Groups go back to their entries by SHA-256, entries without their texts.

Entries are written bucketed by source, so that answers meet them without moving texts. An owner's
load follows the count of different entries, not of rows: a hot text is one fingerprint a source.

Of equal texts the row with the most code points in the original text stays, then the smallest
doc_id (nulls last). Null texts count as empty and are equal to texts of white space only. Repeated
rows are copies. An empty table gives an empty result. Further columns are ignored, whatever their
names, and kept by drop_copies.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, fresh, prepare, scratch, shared_dir, table

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SOURCE_ROWS = 20_000
SOURCE_BYTES = 64 << 20
OWNER_PRINTS = 1 << 19
SPARE_BITS = 8

IDS = pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64())]))
#: An entry of a source has at (its place among the fingerprints sent to its owner); a message has code, width and sent.
FIELDS = {"src": pa.int64(), "owner": pa.int32(), "at": pa.int32(), "text": pa.binary(), "sha": pa.string(), "n": pa.int64(), "chars": pa.int64(), "keep_id": pa.int64(), "keep_row": pa.int64(), "ids": IDS, "code": pa.binary(), "width": pa.int32(), "sent": pa.int32()}
SOURCE = "src long, owner int, at int, text binary, sha string, n long, chars long, keep_id long, keep_row long, ids array<struct<row:long,doc_id:long>>, code binary, width int, sent int"


def golomb(gaps: np.ndarray) -> tuple[bytes, int]:
    """Gaps (0 or more) as a Golomb code whose parameter is 2 ** width: the quotients in unary, then the rests.

    The parameter is the power of two nearest to ln 2 times the mean gap.
    """
    mean = float(gaps.mean()) if len(gaps) else 0.0
    width = max(0, int(round(np.log2(max(mean * np.log(2), 1.0)))))
    quotient = gaps >> width
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rests = ((gaps[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, rests])).tobytes(), width


def ungolomb(code: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    rests = bits[int(ends[-1]) + 1 :][: n * width].reshape(n, width).astype(np.int64) if n else np.zeros((0, width), np.int64)
    return (quotient << width) + (rests << np.arange(width)).sum(1)


def _batch(length: int, **columns) -> pa.RecordBatch:
    """Rows of FIELDS; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(length, t) for c, t in FIELDS.items()], list(FIELDS))


def best(rows: list[tuple]) -> tuple:
    """Of (chars, doc_id, row) the one that stays."""
    return min(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))


def _source(bits: int, owner_bits: int):
    """Entries of this task's sources, and the coded fingerprints that each source sends to each owner."""

    def send(src: int, held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        texts, rows = list(held), list(held.values())
        shas = [hashlib.sha256(t) for t in texts]
        prints = np.array([int.from_bytes(s.digest()[:8], "big") >> (64 - bits) for s in shas], np.int64)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        owner = prints >> (bits - owner_bits)
        at = np.arange(len(order)) - np.searchsorted(owner, owner)
        piece = np.cumsum([len(texts[i]) for i in order]) // (SOURCE_BYTES // 8)
        for p in np.unique(piece):
            of = np.flatnonzero(piece == p)
            which = [int(i) for i in order[of]]
            stay = [best(rows[i]) for i in which]
            ids = [[{"row": r, "doc_id": d} for _, d, r in rows[i]] for i in which]
            yield _batch(len(of), src=[src] * len(of), owner=owner[of], at=at[of], text=[texts[i] for i in which], sha=[shas[i].hexdigest() for i in which], n=[len(x) for x in ids],
                         chars=[s[0] for s in stay], keep_id=[s[1] for s in stay], keep_row=[s[2] for s in stay], ids=ids)
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
        sent = [(int(owner[s]), *golomb(np.diff(prints[s:e], prepend=owner[s] << (bits - owner_bits))), int(e - s)) for s, e in zip(np.append(0, ends[:-1]), ends)]
        who, code, width, count = (list(x) for x in zip(*sent))
        yield _batch(len(sent), src=[src] * len(sent), owner=who, code=code, width=width, sent=count)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        held: dict[bytes, list] = {}
        rows = size = 0
        for b in batches:
            chars = pc.utf8_length(b.column("text")).to_pylist()
            for text, *rest in zip(b.column("text").cast(pa.binary()).to_pylist(), chars, b.column("doc_id").to_pylist(), b.column("row").to_pylist()):
                bare = text.translate(None, SPACE)
                if bare not in held:
                    size += len(bare)
                held.setdefault(bare, []).append(tuple(rest))
                rows += 1
                if rows >= SOURCE_ROWS or size >= SOURCE_BYTES:
                    yield from send(src, held)
                    held, rows, size, src = {}, 0, 0, src + 1
        if held:
            yield from send(src, held)

    return work


def answer(t: pa.Table) -> pa.Table:
    """One owner's answers: for each source a bit a fingerprint, set where another entry has it too."""
    base = [np.cumsum(ungolomb(c, w, n)) for c, w, n in zip(t.column("code").to_pylist(), t.column("width").to_pylist(), t.column("sent").to_pylist())]
    every = np.sort(np.concatenate(base))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    hit = [np.isin(p, twice) for p in base]
    some = np.array([h.any() for h in hit])  # no answer: no copies
    bits = [np.packbits(h).tobytes() for h in hit if h.any()]
    return pa.table({"src": t.column("src").filter(pa.array(some)), "owner": t.column("owner").filter(pa.array(some)), "bitmap": pa.array(bits, pa.binary())})


def exchange(rows: DataFrame, n: int, name: str, path: str) -> DataFrame:
    """Entries of n rows (row, doc_id, text) with suspect; what the sources hold and send is written to a table bucketed by source."""
    spark = rows.sparkSession
    owner_bits = max(3, (n // OWNER_PRINTS).bit_length())
    bits = min(62, max(n.bit_length() + SPARE_BITS, owner_bits + 1))
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SOURCE_ROWS))
    made = rows.select("row", "doc_id", "text").mapInArrow(_source(bits, owner_bits), SOURCE)
    made.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "src").sortBy("src").saveAsTable(name)
    held = spark.table(name)
    sent = held.filter("code IS NOT NULL").select("src", "owner", "code", "width", "sent")
    told = sent.groupBy("owner").applyInArrow(answer, "src long, owner int, bitmap binary")
    answers = told.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("owner", "bitmap"))).alias("answers"))
    byte = "cast(conv(hex(substring(element_at(answers, owner), at div 8 + 1, 1)), 16, 10) as int)"
    suspect = F.coalesce(F.expr(f"(shiftright({byte}, 7 - at % 8) & 1) = 1"), F.lit(False))
    return held.filter("code IS NULL").join(answers, "src", "left").withColumn("suspect", suspect)


def classes(rows: DataFrame, n: int) -> DataFrame:
    """row, doc_id, keep_row, keep_id, group_size and text_sha256 for each of n rows (row: distinct long, doc_id: long, text: string)."""
    spark = prepare(rows.sparkSession)
    name, path = f"lightfold_{uuid.uuid4().hex}", f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"
    with scratch():
        found = exchange(rows, n, name, path)
        entries = cut(found.select("suspect", F.when(F.col("suspect"), F.col("text")).alias("text"), "sha", "n", "chars", "keep_id", "keep_row", "ids"), "entries")
        # ~x falls as x rises, without overflow
        first = F.struct("chars", F.col("keep_id").isNotNull().alias("has"), F.bitwise_not("keep_id").alias("id"), F.bitwise_not("keep_row").alias("row"))
        groups = entries.filter("suspect").groupBy("sha", "text").agg(F.sum("n").alias("size"), F.max(first).alias("first"))
        groups = groups.select("sha", "size", F.bitwise_not("first.id").alias("id"), F.bitwise_not("first.row").alias("kept"))
        shared = entries.filter("suspect").select("sha", "ids").join(groups, "sha").select("sha", "ids", "size", "id", "kept")
        alone = entries.filter("NOT suspect").select("sha", "ids", F.col("n").alias("size"), F.col("keep_id").alias("id"), F.col("keep_row").alias("kept"))
        out = shared.union(alone).select(F.inline("ids"), F.col("kept").alias("keep_row"), F.col("id").alias("keep_id"), F.col("size").alias("group_size"), F.col("sha").alias("text_sha256"))
        out = cut(out, "exact")
    spark.sql(f"DROP TABLE {name}")
    found._scratch = path
    discard(found)
    return out


def _rows(docs: DataFrame, row) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs (doc_id, text)."""
    found = classes(_rows(docs, F.monotonically_increasing_id()), docs.count())
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    row = fresh(docs, "row")
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = classes(_rows(held, F.col(row)), held.count()).filter("row = keep_row").select(F.col("row").alias(row))
    return held.join(kept, row, "left_semi").drop(row)


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(prepare(spark), sf_dir, "documents"))
