"""Periodic runs of words, by scale-tiled distribution.

A run of period q is a maximal stretch in which words q apart are identical. It
is found through its matches (places i with word i = word i + q, a stretch
[s, t) of them) at the *anchors* of q's scale: scale 0 has periods 1 to 15, scale
k those from 2^(k+3) to 2^(k+4) - 1, with an anchor every S = 8 * 2^k words (8 at
scale 0). A run of at least MIN_WORDS words and MIN_POWER periods has at least
MIN_WORDS - q and 2 q matches, so an anchor c lies in [s, t - 8].

1. Every document explodes into tiles, one per scale and anchor: the words from S
   before the anchor to S + 8 after it and the scale's longest period on. Only
   anchors whose 8 words occur again at a distance of the scale make one, as a
   run needs that.
2. Tiles are dealt out and solved apart. The Z-function of the words from the
   anchor on gives, for all periods at once, how many matches follow the anchor,
   that of the words before it, read backwards, how many precede it. Periods
   that a divisor explains are dropped (the Z-function tells too); a fragment
   that ends inside the tile on both sides is a run or none.
3. Fragments that reach a tile's edge meet again by document and period, and
   overlapping ones are stitched to whole stretches.

The join of runs with texts reads only documents that had a tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

MIN_WORDS = 24            # words of the shortest run, at least 23 = 8 + 15
MIN_POWER = 3             # periods of the shortest run
_GRAM = 8
_FIRST = 16               # scale 0 has the periods below this
_MUL = np.uint64(0x9E3779B97F4A7C15)


def scales(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(scale, first period, end of periods, anchor step) of a text of n words."""
    k, low, high = 0, 1, _FIRST
    while low * MIN_POWER <= n:
        yield k, low, min(high, n // MIN_POWER + 1), max(_GRAM, high // 2)
        k, low, high = k + 1, high, 2 * high


def anchors(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(scale, end of periods, step, anchors) of one text: the multiples of the
    step whose 8 words occur again at a distance of the scale, by their hashes."""
    n = len(ids)
    if n < MIN_WORDS:
        return
    gram = np.zeros(n - _GRAM + 1, np.uint64)
    for j in range(_GRAM):
        gram = (gram ^ (gram >> np.uint64(29))) * _MUL + ids[j:n - _GRAM + 1 + j].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return
    group = np.r_[0, np.cumsum(~same)]
    key = (group << 32) | order                     # ascending: by gram, then place
    of = np.empty(n, np.int64)
    of[order] = group
    for k, low, high, step in scales(n):
        c = np.arange(0, len(gram), step)
        first = (of[c] << 32) | c
        at = np.searchsorted(key, first + low)
        hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] < first + high)
        if hit.any():
            yield k, high, step, c[hit]


def z_function(x: list) -> list[int]:
    """z[i]: how many values from i on equal those from 0 on."""
    n = len(x)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    head = x[0]
    left = right = 0
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif x[i] != head:
            continue
        else:
            k = 1
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(1 << 16)
def _prime_factors(n: int) -> list[int]:
    out, r = [], 2
    while r * r <= n:
        if n % r == 0:
            out.append(r)
            while n % r == 0:
                n //= r
        r += 1
    return out + [n] if n > 1 else out


def solved(ids: np.ndarray, c: int, low: int, high: int, step: int, head: bool, tail: bool
           ) -> list[tuple[int, int, int, bool]]:
    """(period, from, to, whole) of the matches round the anchor ``c`` of a tile, in
    the tile's places, for each period from ``low`` to ``high`` - 1 of at least 8
    matches from the anchor on. ``whole``: neither end is cut by the tile;
    ``head`` and ``tail`` tell that the tile's ends are the text's."""
    x = ids.tolist()
    n = len(x)
    ahead = ids[c:c + _GRAM]
    limit = min(high, n - c - _GRAM + 1)
    if limit <= low:
        return []
    fit = np.ones(limit - low, bool)
    for j in range(_GRAM):
        fit &= ids[c + low + j:c + limit + j] == ahead[j]
    periods = (np.flatnonzero(fit) + low).tolist()
    if not periods:
        return []
    right = z_function(x[c:])
    reach = min(c, step)                            # matches before the anchor that the tile shows
    back = x[c - reach:c][::-1]
    longest = periods[-1]
    left = z_function(back + [-1] + x[c - reach:c + longest][::-1]) if reach else []
    out = []
    for p in periods:
        after = min(right[p], step + _GRAM)
        if any(right[p // r] >= p - p // r for r in _prime_factors(p)):
            continue                                # a shorter period holds here, and so in the whole stretch
        # word c + p - 1 stands at place longest - p of the part that is read backwards
        before = min(left[reach + 1 + longest - p], reach) if reach else 0
        whole = (before < reach or (head and c - reach == 0)) and (after < step + _GRAM or (tail and c + p + after == n))
        out.append((p, c - before, c + after, whole))
    return out


def _numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))


_TILES = ("_row long, _id {id}, n long, plain string, _text string, scale int, anchor long, lo long, "
          "head boolean, tail boolean, high int, step int, ids binary")


def tiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds. Of every document (scale null): _row, its number in this
    table; _id; n, its words; plain, the SHA-256 of its words joined by spaces;
    _text, these, if the document has a tile. Of every tile: _row, its scale, anchor
    and first word's number lo, whether its ends are the text's, the end of its
    periods, the anchor step, and its words as numbers."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 33) - 1
        names = [f.split()[0] for f in _TILES.split(",")]
        kinds = [pa.int64(), None, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(),
                 pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]

        def packed(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_kind) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            out, held, id_kind = [], 0, b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row += 1
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                text = b" ".join(words)
                numbers = _numbered(words)
                n, any_tile = len(words), False
                for k, high, step, places in anchors(numbers):
                    any_tile = True
                    for c in places.tolist():
                        lo, hi = max(0, c - step), min(n, c + step + _GRAM + high)
                        out.append((row, None, None, None, None, k, c, lo, lo == 0, hi == n, high, step,
                                    numbers[lo:hi].tobytes()))
                        held += 4 * (hi - lo)
                        if held > 8 << 20:
                            yield packed(out, id_kind)
                            out, held = [], 0
                out.append((row, i, n, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass") if any_tile else None,
                            *[None] * 8))
                held += len(text) if any_tile else 0
            yield packed(out, id_kind)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        of, _TILES.format(id=kind))


def fragments(tiled: DataFrame) -> DataFrame:
    """(_row, period, s, t, whole): stretches of matches that the tiles show, in the
    document's places."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, anchor, lo, head, tail, high, step, ids in zip(*[b.column(i).to_pylist() for i in range(8)]):
                low = 1 if step == _GRAM else step
                for p, s, t, whole in solved(np.frombuffer(ids, np.int32), anchor - lo, low, high, step, head, tail):
                    if not whole or t - s + p >= max(MIN_WORDS, MIN_POWER * p):
                        rows.append((row, p, s + lo, t + lo, whole))
            cols = zip(*rows) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["_row", "period", "s", "t", "whole"])

    dealt = (tiled.select("_row", "anchor", "lo", "head", "tail", "high", "step", "ids")
             .repartition("_row", "step", "anchor"))
    return dealt.mapInArrow(of, "_row long, period long, s long, t long, whole boolean")


def stitched(parts: DataFrame) -> DataFrame:
    """(_row, start, length, period): overlapping fragments of a document and period
    united, those that are long enough for a run."""
    w = Window.partitionBy("_row", "period").orderBy("s", "t")
    before = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = parts.select("_row", "period", "s", "t").withColumn(
        "new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    island = cut.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (island.groupBy("_row", "period", "island").agg(F.min("s").alias("s"), F.max("t").alias("t"))
            .select("_row", F.col("s").alias("start"), (F.col("t") - F.col("s") + F.col("period")).alias("length"), "period")
            .where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_POWER * F.col("period"))))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, runs): the document rows of ``tiles`` and (_row, start, length,
    period) of every run; _row ties them."""
    table = written(tiles(docs, id_col, text_col), "run-tiles")
    runs = stitched(fragments(table.where("scale IS NOT NULL")))
    return table.where("scale IS NULL").select("_row", "_id", "n", "plain", "_text"), runs


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run (start, length, period) contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge)[:n] == 0


_OUT = ("{id_col} {id}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long, collapsed string, "
        "runs array<struct<start:long,length:long,period:long>>")


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, its runs and its text with the repeats collapsed.

    Words are runs without ASCII white space. n_runs; start (word number), length,
    period and exponent_milli of the run of the greatest length / period (ties: the
    smallest start, then period), null without runs; runs_sha256 of all runs as
    ``start,length,period`` lines by start, then period; collapsed_sha256 of the
    words that no run contains after its first period, joined by one space; n_words,
    n_kept; runs, and collapsed, that text, null where no word goes. Null and
    empty texts have no words; repeated rows come out each; other columns are not
    read; no rows give no rows.
    """
    rows, runs = found(docs, id_col, text_col)
    per = written(runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs")),
                  "runs")      # at most as many as the document has words
    kind = dict(docs.dtypes)[id_col]
    kinds = [None, *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]
    empty = hashlib.sha256(b"").hexdigest()

    def told(i, n, text, own):
        own = [(r["start"], r["length"], r["period"]) for r in own or []]
        best = (max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in own)
        keep = kept_words(n, own)
        words = text.split(" ")
        rest = " ".join([words[j] for j in np.flatnonzero(keep).tolist()]) if own else text
        return (i, len(own), *best, 1000 * best[1] // best[2] if own else None,
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest(), n, int(keep.sum()),
                rest if own else None, [{"start": s, "length": length, "period": q} for s, length, q in own])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [told(i, n, t, own)
                   for i, n, t, own in zip(*[b.column(c).to_pylist() for c in range(4)])]
            cols = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k or b.column(0).type) for c, k in zip(cols, kinds)],
                                             names=[f.split()[0] for f in names])

    names = ["_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
             "n_words", "n_kept", "collapsed", "runs"]
    schema = _OUT.format(id_col="_id", id=kind)
    tiled = (rows.where("_text IS NOT NULL").join(per, "_row", "left")
             .select("_id", "n", "_text", "_runs").mapInArrow(of, schema))
    none = F.lit(None).cast("long")
    plain = (rows.where("_text IS NULL")
             .select("_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"),
                     none.alias("period"), none.alias("exponent_milli"), F.lit(empty).alias("runs_sha256"),
                     F.col("plain").alias("collapsed_sha256"), F.col("n").alias("n_words"), F.col("n").alias("n_kept"),
                     F.lit(None).cast("string").alias("collapsed"),
                     F.expr("CAST(array() AS array<struct<start:long,length:long,period:long>>)").alias("runs")))
    return tiled.unionByName(plain).withColumnRenamed("_id", id_col)
