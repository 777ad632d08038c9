"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash over its last 32 bytes hits a mask, so equal
content gives equal chunks. A chunk's identity is its length and two
independent digests (SHA-256 and BLAKE2b); each distinct chunk gets one small
identifier, and a text becomes the ordered list of its chunk identifiers. Texts
are equal exactly if their lists are. A text is read once, in the task that
scans it; after that only digests and identifiers move, never the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, rows_named, runs_of, text_buffers, written

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16384   # bytes; a cut every 2^11 bytes past the minimum
_SPAN = 4 << 20                                    # bytes hashed at a time

_RAW = ("_row long, _id {id}, _sha string, _n int, "
        "_chunks array<struct<d:binary,c:binary,n:int>>")


def _gear() -> np.ndarray:
    """256 well-mixed 32-bit values: the splitmix64 sequence from zero."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.uint32)


_GEAR = _gear()


def _cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: the gear hash of the last 32 bytes has MASK_BITS
    zero top bits. The hash is built by doubling its window, five vector steps."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[w:] += h[:-w] << np.uint32(w)
        h = nxt
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_ends(data: np.ndarray) -> list[int]:
    """Chunk ends of one text (bytes); the empty text has none."""
    return _ends_within(_all_cuts(data), 0, len(data))


def _all_cuts(data: np.ndarray) -> np.ndarray:
    """Cut points of a buffer, in slices of bounded size that overlap by the window."""
    found = []
    for a in range(0, len(data), _SPAN):
        lo = max(0, a - 31)
        cuts = _cut_points(data[lo:a + _SPAN]) + lo
        found.append(cuts[cuts > a])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ends_within(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of [start, end): the first cut at least MIN_CHUNK after the
    last end, or MAX_CHUNK after it. As MIN_CHUNK > 32, no used cut's window
    reaches back before the text."""
    ends, at = [], start
    while at < end:
        k = int(np.searchsorted(cuts, at + MIN_CHUNK))
        nxt = min(int(cuts[k]) if k < len(cuts) else end, at + MAX_CHUNK, end)
        ends.append(nxt)
        at = nxt
    return ends


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        rows, shas, counts, lists = [], [], [], []
        for a, b in runs_of(np.diff(off), _SPAN):
            base = int(off[a])
            part = data[base:off[b]]
            cuts, view = _all_cuts(part), memoryview(part)
            for i in range(a, b):
                s, e = int(off[i]) - base, int(off[i + 1]) - base
                chunks, at = [], s
                for end in _ends_within(cuts, s, e):
                    piece = view[at:end]
                    chunks.append({"d": hashlib.sha256(piece).digest(),
                                   "c": hashlib.blake2b(piece, digest_size=16).digest(), "n": end - at})
                    at = end
                rows.append(row)
                row += 1
                shas.append(hashlib.sha256(view[s:e]).hexdigest())
                counts.append(len(chunks))
                lists.append(chunks)
        kind = pa.list_(pa.struct([("d", pa.binary()), ("c", pa.binary()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), batch.column(0), pa.array(shas, pa.string()),
             pa.array(counts, pa.int32()), pa.array(lists, kind)],
            names=["_row", "_id", "_sha", "_n", "_chunks"])


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, _sha, recipe): the ordered chunk identifiers of every text.

    An identifier is (row, position) of the chunk's first occurrence, so it does
    not depend on the run's task order beyond the written row numbers.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    raw = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                  .mapInArrow(_chunked, _RAW.format(id=kind)), "recipes")
    parts = (raw.select("_row", F.posexplode("_chunks").alias("_pos", "_c"))
             .select("_row", "_pos", "_c.*"))
    # written, so that both sides of the join are plain shuffles and AQE splits a hot chunk
    ids = written(parts.groupBy("d", "c", "n").agg(F.min(F.struct("_row", "_pos")).alias("chunk")), "chunks")
    lists = (parts.join(ids, ["d", "c", "n"])
             .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "chunk"))).alias("l"))
             .select("_row", F.col("l.chunk").alias("recipe")))
    # texts of no chunk have an empty recipe
    return (raw.select("_row", "_id", "_sha").join(lists, "_row", "left")
            .withColumn("recipe", F.coalesce("recipe", F.array().cast(lists.schema["recipe"].dataType))))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text; empty texts form one group. Of equal texts the
    row with the largest id is kept (a null id is smaller than any; of rows that
    repeat the largest id, exactly one is kept); keep_id is that id. Columns of
    ``docs`` other than the two named are not read. No rows give no rows.
    """
    return (_grouped(docs, id_col, text_col)
            .select(F.col("_id").alias(id_col), F.col("keep._id").alias("keep_id"), "group_size",
                    (F.col("_row") == F.col("keep._row")).alias("kept"), F.col("_sha").alias("text_sha256")))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    per_row = written(recipes(docs, id_col, text_col), "recipe-rows")
    groups = written(per_row.groupBy("recipe").agg(      # as for chunks: the copies of one text are split
        F.max(F.struct("_id", "_row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return per_row.join(groups, "recipe")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dedup`` does not keep, same columns. Of
    rows that agree in id and text too, the one whose other columns hash lowest
    stays."""
    keys = (_grouped(docs, id_col, text_col).where(F.col("_id").eqNullSafe(F.col("keep._id")))
            .groupBy(F.col("_id").alias("_k_id"), F.col("_sha").alias("_k_sha"))
            .agg(F.count(F.lit(1)).alias("_k_n")))
    return rows_named(docs, keys, id_col, text_col)
