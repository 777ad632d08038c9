"""Distributed row numbering and ranking without a single-partition window.

All helpers use the same idea: rows are laid out in order over range partitions
(or file splits) and written once, numbered there by
``monotonically_increasing_id``; sums per partition, and a running sum over
those, give each partition its offset. Only that last table is ordered in one
task, and it has one row per range partition (``spark.sql.shuffle.partitions``),
whatever the number of rows or file splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_written
from .joins import spread_join


def laid_out(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` in ``order`` over range partitions, with _mid (the place) and _pid (the partition)."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return scratch_written(laid, name).withColumn("_pid", F.shiftright("_mid", 33))


def partition_offsets(x: DataFrame, n: Column, count: bool = False) -> DataFrame:
    """(_pid, _off, _m0): sums of ``n`` over all earlier partitions, first place; with
    ``count`` also _s, the partition's own sum."""
    parts = x.groupBy("_pid").agg(F.sum(n).alias("_s"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_pid", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"), "_m0", *["_s"] * count)


def prefix_sums(df: DataFrame, order: list, value: str, out: str = "_before") -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over all rows before it in ``order``
    (which must tell rows apart).

    Two levels: a running sum within each range partition, whose rows are as many
    as the range, and the sums of whole partitions before it."""
    x = laid_out(df, order, "prefix")
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (y.join(partition_offsets(x, F.col(value)).drop("_m0"), "_pid")
            .withColumn(out, F.col("_off") + F.col("_in")).select(*df.columns, out))


def sequence_ids(df: DataFrame, group_cols: list[str], id_col: str = "id",
                 start: int = 1) -> DataFrame:
    """Dense ids ``start..start+N-1`` in the order (group_cols, scan position).

    ``group_cols`` must identify contiguous runs of the scan, e.g. the file
    path and split start of a file source (``_metadata.file_path``,
    ``_metadata.file_block_start``); inside a run the scan order is kept.

    The rows are evaluated once, into the shared folder, each with its place in
    its task. A run's rows follow each other there, so a run is four numbers
    (task, first place, rows, rows of all runs before): that table is written
    too, so that the planner knows its size and broadcasts it while that is small,
    and joins by the task, of a split's size each, beyond.
    """
    x = scratch_written(df.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    runs = (x.withColumn("_p", F.shiftright("_mid", 33)).groupBy("_p", *group_cols)
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")))
    off = scratch_written(prefix_sums(runs, group_cols, "_n").select("_p", "_m0", "_n", "_before"), "runs")
    at = (F.shiftright("_mid", 33) == F.col("_p")) & (F.col("_mid") >= F.col("_m0")) & (F.col("_mid") < F.col("_m0") + F.col("_n"))
    return (x.join(off, at).withColumn(id_col, F.col("_before") + (F.col("_mid") - F.col("_m0")) + F.lit(start))
            .drop("_mid", "_p", "_m0", "_n", "_before"))


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank",
                tie_cols: list[str] | None = None, dense_ties: bool = True) -> DataFrame:
    """SQL ``rank()`` over the whole frame (ties share the lowest position).

    ``order`` are sort expressions (``F.desc('x')`` ...) over ``tie_cols``, the
    columns whose equality makes a tie. The rank is worked out on the distinct
    values: one more than the rows of all values before, by ``prefix_sums`` of
    their counts, so rows that share one value count as one row there. Then every
    row takes its value's rank in a join that spreads hot values.

    Without ``tie_cols``, or with ``dense_ties=False``, the result is
    ``row_number()`` instead: rows are laid out by ``order`` and numbered.
    """
    if not (dense_ties and tie_cols):
        x = laid_out(df, order, "ranked")
        return (x.join(partition_offsets(x, F.lit(1)), "_pid")
                .withColumn(rank_col, F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1)
                .drop("_mid", "_pid", "_off", "_m0"))
    x = scratch_written(df, "ranked")
    counts = x.groupBy(*tie_cols).agg(F.count(F.lit(1)).alias("_n"))
    ranks = scratch_written(prefix_sums(counts, order, "_n").withColumn(rank_col, F.col("_before") + 1), "ranks")
    return spread_join(x, ranks.select(*tie_cols, rank_col), tie_cols, ranks, "_n")
