"""Packing by optimal length buckets.

One scan takes the length of every document; documents longer than the context
are cut into windows, so lengths are bounded by the context and the global
histogram has at most that many rows. Dynamic programming over it chooses the
bucket boundaries with the least padding, and batches of a token budget are
formed inside each bucket. Numbering inside a bucket runs in shards whose
number follows from the histogram, so no task holds a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, written

MAX_LENGTH, BUCKETS, BUDGET = 2048, 16, 65536   # tokens of a window, buckets, padded tokens of a batch
SHARD_ROWS = 50_000


def word_count(text: Column) -> Column:
    """The default length: words between ASCII white space, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over a histogram (ascending
    lengths) such that padding every item to its bucket's bound costs least; of
    equal costs the one of fewer buckets, then of smaller bounds."""
    n = len(lengths)
    if n == 0:
        return []
    items = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    tokens = np.r_[0, np.cumsum(counts * lengths, dtype=np.int64)]
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        nxt, arg = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (items[j] - items[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], arg[j] = cost[i], i
        best = nxt
        back.append(arg)
    bounds, j = [], n
    for arg in reversed(back):
        if j and arg[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(arg[j])
    return bounds[::-1]


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
         max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET,
         ids: Column | None = None) -> DataFrame:
    """One row per window of every document: id, part, first_token, n_tokens,
    bucket_length, batch_id, slot, and with ``ids``, the documents' token ids (an
    array of ``length`` of them), those of the window.

    ``length`` is any integer column of ``docs`` (default: words of the text; null
    counts as 0). A document of n tokens has ceil(n / max_length) windows, at
    least one, so an empty document has one of 0 tokens. A batch holds at most
    max(1, budget // bucket_length) windows of one bucket; nothing is dropped.
    Repeated rows and null ids are packed like any other row; no rows give no
    rows. Only the id column and what ``length`` needs are read.
    """
    size = length if length is not None else word_count(F.col(f"`{text_col}`"))
    sizes = written(docs.select(F.col(f"`{id_col}`").alias("_id"),
                                F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_n"),
                                F.monotonically_increasing_id().alias("_row"),
                                *([] if ids is None else [ids.alias("_ids")])), "lengths")
    cut = [] if ids is None else [F.slice("_ids", F.col("part").cast("int") * max_length + 1, F.lit(max_length)).alias("ids")]
    last = F.greatest(F.ceil(F.col("_n") / max_length) - 1, F.lit(0))
    windows = (sizes.select(*sizes.columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
               .select("_id", "_row", "part", F.least(F.col("_n") - F.col("part") * max_length, F.lit(max_length)).alias("n_tokens"),
                       *cut))
    # at most max_length + 1 rows
    hist = sorted(map(tuple, windows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()))
    lengths, counts = (np.array(x, np.int64) for x in (zip(*hist) if hist else ((), ())))
    bounds = bucket_bounds(np.maximum(lengths, 1), counts, buckets) or [1]
    which = np.searchsorted(bounds, np.maximum(lengths, 1))
    held = np.bincount(which, weights=counts, minlength=len(bounds)).astype(np.int64) if len(hist) else np.zeros(len(bounds))
    room = [max(1, budget // b) for b in bounds]
    shards = [max(1, int(h) // max(SHARD_ROWS, r)) for h, r in zip(held, room)]

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_b"))

    bucket = F.lit(1)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    dealt = (windows.withColumn("_b", bucket)
             .withColumn("_shard", F.pmod(F.xxhash64("_row", "part"), of_bucket(shards))))
    place = F.row_number().over(Window.partitionBy("_b", "_shard").orderBy("_row", "part")) - 1
    return (dealt.withColumn("_at", place).select(
        F.col("_id").alias(id_col), "part", (F.col("part") * max_length).alias("first_token"), "n_tokens",
        of_bucket(bounds).cast("long").alias("bucket_length"),
        F.concat_ws("-", (F.col("_b") - 1).cast("string"), F.col("_shard").cast("string"),
                    F.floor(F.col("_at") / of_bucket(room)).cast("string")).alias("batch_id"),
        (F.col("_at") % of_bucket(room)).cast("long").alias("slot"), *["ids"] * bool(cut)))
