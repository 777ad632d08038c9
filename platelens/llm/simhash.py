"""SimHash near-duplicates through a segment-popcount embedding.

Each 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
The Manhattan distance of two such vectors never exceeds the Hamming distance
of the fingerprints, so fingerprints within 3 bits have vectors within 3. Then
one half of the vector (16 segments) differs by at most 1, so a pair meets in
the grid over half-vectors: either in the same cell, or one lies one step up
from the other. Every fingerprint goes to its own cell and to the cells one
step up, of either half; a pair is tested by Manhattan distance first and then
by its exact bit distance.

Copies collapse before the grid (one row per distinct fingerprint), a cell
gives tree links rather than all its pairs, and a cell of many fingerprints is
cut into blocks whose pairs go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, rows_named, text_sha, wide_batches, written
from .components import components

_SEED = 42
_LOW = 0x5555555555555555
_SLICE = 1 << 16          # shingles counted at a time
_BLOCK = 1 << 14          # fingerprints of a cell that one task compares at a time
_PAIRWISE = 48            # cells up to this size are compared pair by pair, all cells at once
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: ASCII-lowered words, ``shingle``-word shingles (fewer
    words: the whole sequence; none: 0), XXH64 seed 42 of each, repeats
    included; a bit is 1 if set in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, _SEED)]
        return hashes[0]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    begin, end = starts[:n].tolist(), (starts[shingle:shingle + n] - 1).tolist()
    counts = np.zeros(2048, np.int64)
    places = np.arange(8, dtype=np.int64) * 256
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, _SLICE):
        b = min(n, a + _SLICE)
        h = np.fromiter((digest(joined[s:e], _SEED) for s, e in zip(begin[a:b], end[a:b])), np.uint64, b - a)
        counts += np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + places).ravel(), minlength=2048)
    bits = counts.reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((2 * bits > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 with_sha: bool = False) -> DataFrame:
    """(_id, _sha, fp long): the fingerprint of every row, null text as empty;
    with_sha adds the text's SHA-256, else _sha is null."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())],
                                             names=["_id", "_sha", "fp"])

    kind = dict(docs.dtypes)[id_col]
    sha = text_sha(text_col) if with_sha else F.lit(None).cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), sha.alias("_sha")
                       ).mapInArrow(of, f"_id {kind}, _sha string, fp long")


def embedded(fp: str) -> str:
    """SQL: the segment bit counts of ``fp`` in unary (00, 01, 11 per segment), so
    bit_count(x ^ y) of two of them is their Manhattan distance."""
    up = f"shiftrightunsigned({fp}, 1)"
    return f"((({fp}) | {up}) & {_LOW}L) | shiftleft((({fp}) & {up}) & {_LOW}L, 1)"


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp, own): each fingerprint's own cell of either half, and the cells
    one step up in one segment (own = 0)."""
    half = ["(u & 4294967295L)", "shiftrightunsigned(u, 32)"]
    own = [f"struct({k}L * 4294967296L + {h} AS cell, 1 AS own)" for k, h in enumerate(half)]
    up = [f"transform(filter(sequence(0, 30, 2), j -> (shiftrightunsigned({h}, j) & 3) < 3), j -> "
          f"struct({k}L * 4294967296L + ({h} | shiftleft((shiftrightunsigned({h}, j) & 3) + 1, j)) AS cell, 0 AS own))"
          for k, h in enumerate(half)]
    return (fps.select("fp", F.expr(embedded("fp")).alias("u"))
            .select("fp", F.explode(F.expr(f"concat(array({', '.join(own)}), {', '.join(up)})")).alias("c"))
            .select("c.cell", "fp", "c.own"))


def _unary(x: np.ndarray) -> np.ndarray:
    low, up = np.uint64(_LOW), x >> np.uint64(1)
    return ((x | up) & low) | (((x & up) & low) << np.uint64(1))


def _linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Manhattan distance as the lower bound, then the exact bit distance."""
    near = np.bitwise_count(_unary(a) ^ _unary(b)) <= most
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= most
    return near


def _tree(fp: np.ndarray, own: np.ndarray, most: int) -> tuple[list, list]:
    """Tree links of one large cell, owners first: whatever is linked to a reached
    fingerprint leaves the rest that is still compared, so dense groups cost
    little. A fingerprint one step below the cell is compared with owners only,
    and none starts a tree: a cell of few owners costs few passes."""
    src, dst = [], []
    rest, owners = fp, int(own.sum())       # rest[:owners] own the cell
    while owners:
        todo, rest, owners = [(rest[0], True)], rest[1:], owners - 1
        while todo:
            x, mine = todo.pop()
            others = rest if mine else rest[:owners]
            at = np.flatnonzero(_linked(np.full(len(others), x), others, most))
            if len(at):
                src.append(np.full(len(at), x))
                dst.append(rest[at])
                todo.extend(zip(rest[at], at < owners))
                rest, owners = np.delete(rest, at), owners - int((at < owners).sum())
    return src, dst


def _cell_links(most: int):
    def links(cell: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(cell)])
        src, dst = [], []
        size_at = np.repeat(sizes, sizes)
        small = (size_at > 1) & (size_at <= _PAIRWISE)
        group = np.repeat(np.arange(len(starts)), sizes)
        i = np.flatnonzero(small & own)
        for k in range(1, int(size_at[i].max(initial=0))):   # owners come first in a cell
            i = i[i + k < len(cell)]
            i = i[group[i] == group[i + k]]
            if not len(i):
                break
            hit = i[_linked(fp[i], fp[i + k], most)]
            src.append(fp[hit])
            dst.append(fp[hit + k])
        for g in np.flatnonzero(sizes > _PAIRWISE):
            s, e = starts[g], starts[g] + sizes[g]
            if own[s]:
                a, b = _tree(fp[s:e], own[s:e], most)
                src += a
                dst += b
        if not src:
            return None
        a, b = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []     # rows of cells whose end has not been seen; bounded by two blocks
        for b in batches:
            if b.num_rows:
                held.append(b)
                cols = pa.Table.from_batches(held).combine_chunks()
                key = np.stack([cols["cell"].to_numpy(), cols["block"].to_numpy()], axis=1)
                cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
                if len(cut):
                    n = int(cut[-1]) + 1
                    out = links(key[:n], cols["fp"].to_numpy()[:n].view(np.uint64), cols["own"].to_numpy()[:n] == 1)
                    if out is not None:
                        yield out
                    held = cols.slice(n).to_batches()
        if held:
            cols = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([cols["cell"].to_numpy(), cols["block"].to_numpy()], axis=1)
            out = links(key, cols["fp"].to_numpy().view(np.uint64), cols["own"].to_numpy() == 1)
            if out is not None:
                yield out

    return run


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within
    ``max_distance`` bits (at most 3) that join the same components as all of
    them do. A cell of more than _BLOCK rows is dealt out as block pairs."""
    if not 0 <= max_distance <= 3:
        raise ValueError("the grid covers bit distances 0 to 3")
    cells = _cells(fps)
    full = (cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _BLOCK)
            .select("cell", F.ceil(F.col("n") / _BLOCK).cast("int").alias("nb")))
    dealt = (cells.join(full, "cell", "left")
             .withColumn("nb", F.coalesce("nb", F.lit(1)))
             .withColumn("h", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("cell", (F.least("h", "j") * F.lit(1 << 20) + F.greatest("h", "j")).cast("long").alias("block"),
                     "fp", "own"))
    wide_batches(fps.sparkSession)
    return (dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("own"), "fp")
            .mapInArrow(_cell_links(max_distance), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id in the component of fingerprints linked at
    ``max_distance`` or fewer bits (null only if all its ids are null). Null and
    empty texts, and texts of white space only, have fingerprint zero and link
    like any other. Repeated rows come out as often as they go in; other columns
    of ``docs`` are not read; no rows give no rows.
    """
    return (_rooted(docs, shingle, max_distance, id_col, text_col, False)
            .select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def _rooted(docs: DataFrame, shingle: int, max_distance: int, id_col: str, text_col: str,
            with_sha: bool) -> DataFrame:
    """(_id, _sha, fp, root, component_id) of every row; root names the component."""
    rows = written(fingerprints(docs, shingle, id_col, text_col, with_sha), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("_id").alias("_low")), "simhash-distinct")
    found = components(links(fps.select("fp"), max_distance))
    rooted = (fps.join(found, fps.fp == found.node, "left")
              .select("fp", "_low", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("_low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, shingle: int = 3, max_distance: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component, same columns: the
    row with the smallest id (null ids last), of rows that share it the one with
    the smallest text digest, of rows that share that too the one whose other
    columns hash lowest."""
    near = _rooted(docs, shingle, max_distance, id_col, text_col, True)
    keys = (near.groupBy("root", "_id", "_sha").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("root").agg(F.min(F.struct(F.isnull("_id").alias("last"), "_id", "_sha", "n")).alias("k"))
            .select(F.col("k._id").alias("_k_id"), F.col("k._sha").alias("_k_sha"), F.col("k.n").alias("_k_n")))
    return rows_named(docs, keys, id_col, text_col)
