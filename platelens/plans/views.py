"""Menu-shaped views over the driver tables (no menu data is supplied).

* ``items``: one row per part. id = p_partkey, restaurant = p_brand,
  item = the cleaned form of a dirtied p_name, calories = p_retailprice,
  total_carb = p_size; the other features are per-part aggregates of
  lineitem (max extended price, total quantity, max discount and tax in
  percent, number of lines). Rows with a null in any column are dropped,
  as at load time.
* ``dictionary``: (pos, item, item_gr) from ECONOMY / PROMO parts, with
  repeated names (last row = highest p_partkey wins) and null values
  (p_size > 45).
* ``lexicon``: (word, word_tr) for name words of 4+ letters; shorter words
  are missing from it and stay untranslated.
* ``menu_raw``: the full 17-column menu as text, as a CSV file would hold
  it, including null tokens and one unparsable number.

Everything grows with the driver tables: the feature aggregate scans all of
lineitem, the views scan all of part.
"""

from __future__ import annotations

import os
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_item_name
from ..operators.nulls import drop_nulls
from ..operators.translate import add_translation


_READS: ContextVar[dict | None] = ContextVar("platelens_reads", default=None)


@contextmanager
def shared_reads():
    """Within this block every driver table is read (and its files listed)
    once: views that need ``part`` four times share one relation. Nothing is
    kept after the block, so a later query sees new files."""
    token = _READS.set({})
    try:
        yield
    finally:
        _READS.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    reads = _READS.get()
    if reads is None:
        return spark.read.parquet(path)
    key = (id(spark), path)
    if key not in reads:
        reads[key] = spark.read.parquet(path)
    return reads[key]


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-part aggregate of lineitem: partial aggregation on the map side,
    one shuffle on l_partkey (a hot part collapses to one row per task before
    the shuffle)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(
        F.max("l_extendedprice").alias("total_fat"),
        F.sum("l_quantity").alias("sugar"),
        (F.max("l_discount") * F.lit(100.0)).alias("protein"),
        (F.max("l_tax") * F.lit(100.0)).alias("calcium"),
        F.count(F.lit(1)).cast("double").alias("fiber"))


def dirty_name(name: Column, key: Column, size: Column) -> Column:
    """Give a clean name one of eight kinds of dirt (the kind is picked by
    ``key % 8``; every row is kept): outer quotes, a trailing ``®``, a
    trailing ``*``, commas, odd whitespace, a leading or trailing inch mark,
    and a quote followed by ``®``."""
    sz = size.cast("string")
    k = key % 8
    return (F.when(k == 0, F.concat(F.lit('"'), name, F.lit('"')))
            .when(k == 1, F.concat(name, F.lit("®")))
            .when(k == 2, F.concat(name, F.lit(" *")))
            .when(k == 3, F.replace(name, F.lit(" "), F.lit(", ")))
            .when(k == 4, F.concat(F.lit("\u00a0"), F.replace(name, F.lit(" "), F.lit(" \u00a0 ")), F.lit("\t")))
            .when(k == 5, F.concat(sz, F.lit('" '), name))
            .when(k == 6, F.concat(name, F.lit(" "), sz, F.lit('"')))
            .otherwise(F.concat(F.lit('"'), name, F.lit('"®'))))


def _part_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    f = part_features(spark, sf_dir)
    return p.join(f, p["p_partkey"] == f["l_partkey"], "left")


def items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed menu rows before cleaning and null drop."""
    j = _part_with_features(spark, sf_dir)
    return j.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("restaurant"),
        dirty_name(F.col("p_name"), F.col("p_partkey"), F.col("p_size")).alias("item"),
        F.col("p_retailprice").alias("calories"),
        "total_fat", "sugar",
        F.col("p_size").cast("double").alias("total_carb"),
        "protein", "calcium", "fiber")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned menu items, rows with any null dropped.

    Cleaning maps null to null and text to text, so the null drop runs on the
    raw columns first (same rows, and the filter stays small)."""
    raw = items_raw(spark, sf_dir)
    return drop_nulls(raw).withColumn("item", clean_item_name("item"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "PROMO"))
    gr = F.when(F.col("p_size") <= 45,
                F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("item"), gr.alias("item_gr"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return (words.where(F.length("word") >= 4)
            .select("word", F.upper(F.reverse("word")).alias("word_tr")))


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned name a part can have: a superset of the names in
    ``items`` (no feature join, no null drop), enough to build translations."""
    p = table(spark, sf_dir, "part")
    return p.select(clean_item_name(dirty_name(F.col("p_name"), F.col("p_partkey"),
                                               F.col("p_size"))).alias("item"))


def translated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items plus ``item_gr``. The names to translate come straight from
    ``part`` (one narrow scan), so the items plan with its feature join is
    evaluated once."""
    return add_translation(items(spark, sf_dir), dictionary(spark, sf_dir), lexicon(spark, sf_dir),
                           names=item_names(spark, sf_dir))


def menu_raw(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """All 17 menu columns as text, with CSV null tokens: item 'None' for
    p_size 1, sodium 'n/a' for p_size 2, vit_c 'NA' for p_size 50 (those rows
    are dropped at load), calcium 'trace' for p_size 3 (kept, but not a
    number, so not clustered). ``with_id`` adds p_partkey as ``id`` in front."""
    j = _part_with_features(spark, sf_dir)
    s = F.col("p_size")
    txt = lambda c: c.cast("string")
    front = [F.col("p_partkey").alias("id")] if with_id else []
    return j.select(
        *front,
        F.col("p_brand").alias("restaurant"),
        F.when(s == 1, F.lit("None")).otherwise(
            dirty_name(F.col("p_name"), F.col("p_partkey"), s)).alias("item"),
        txt(F.col("p_retailprice")).alias("calories"),
        txt(s * 9).alias("cal_fat"),
        txt(F.col("total_fat")).alias("total_fat"),
        txt(F.col("protein") / 2).alias("sat_fat"),
        F.lit("0").alias("trans_fat"),
        txt(s * 3).alias("cholesterol"),
        F.when(s == 2, F.lit("n/a")).otherwise(txt(F.col("p_retailprice") * 2)).alias("sodium"),
        txt(s.cast("double")).alias("total_carb"),
        txt(F.col("fiber")).alias("fiber"),
        txt(F.col("sugar")).alias("sugar"),
        txt(F.col("protein")).alias("protein"),
        txt(s).alias("vit_a"),
        F.when(s == 50, F.lit("NA")).otherwise(txt(s * 2)).alias("vit_c"),
        F.when(s == 3, F.lit("trace")).otherwise(txt(F.col("calcium"))).alias("calcium"),
        F.lit("Other").alias("salad"))


# A sales line is identified by these columns together (order and line number
# alone repeat in the driver tables).
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines as menu rows: key = l_partkey, calories = l_extendedprice,
    total_carb = l_quantity (every line of lineitem)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("calories"),
                     F.col("l_quantity").alias("total_carb"), *LINE_ID)


def fact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item each line refers to: key = p_partkey, restaurant = p_brand,
    item = p_name."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("restaurant"),
                    F.col("p_name").alias("item"))
