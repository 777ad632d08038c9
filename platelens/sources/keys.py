"""Surrogate keys 1..N in file order, computed without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank, sequence_ids

FILE_COLS = ["_file_dir", "_file_part", "_file_path", "_file_block"]


def tag_file_position(df: DataFrame) -> DataFrame:
    """Add the place of every row's split (call right on a file scan, before any
    operator that would hide ``_metadata``): folder, part number, path, start.

    The number of a ``part-<n>`` file is compared as a number, since its text
    does not sort past 99,999 parts; other files have none and come first, by
    path."""
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).try_cast("long")
    return df.select("*", F.regexp_extract(path, "^(.*)/", 1).alias("_file_dir"),
                     F.coalesce(part, F.lit(-1)).alias("_file_part"), path.alias("_file_path"),
                     F.col("_metadata.file_block_start").alias("_file_block"))


def with_file_order_ids(tagged: DataFrame, id_col: str = "id", start: int = 1) -> DataFrame:
    """Dense ids in file order (path, split, position) over the rows that are
    left in ``tagged`` (e.g. after a null drop); drops the tag columns.

    Part files written by Spark are named in partition order, so the order of
    a sorted write is kept. Rows that no longer stand in scan order carry their
    place in the split as ``_file_pos`` and are numbered by a distributed sort.
    """
    if "_file_pos" in tagged.columns:
        order = [F.col(c) for c in [*FILE_COLS, "_file_pos"]]
        out = global_rank(tagged, order, id_col).withColumn(id_col, F.col(id_col) + F.lit(start - 1))
        return out.drop(*FILE_COLS, "_file_pos")
    out = sequence_ids(tagged, FILE_COLS, id_col, start)
    return out.drop(*FILE_COLS)
