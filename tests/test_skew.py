"""Hot keys: one restaurant / one item holding a third or more of all rows.
Results must equal a brute-force computation, whatever the partitioning."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens.operators import reports


def _skewed(spark, n=6000, parts=13):
    random.seed(3)
    rows = []
    for i in range(n):
        hot = i % 3 == 0 or i % 5 == 0                      # ~47% of rows
        r = "Hot" if hot else f"R{random.randint(0, 30)}"
        item = "Burger" if hot and i % 2 == 0 else f"i{random.randint(0, 60)}"
        rows.append((i, r, item, f"gr_{item}", float(random.randint(100, 999)), float(random.randint(0, 80))))
    df = spark.createDataFrame(rows, "id long, restaurant string, item string, item_gr string, "
                                     "calories double, total_carb double").repartition(parts)
    return df, pd.DataFrame(rows, columns=["id", "restaurant", "item", "item_gr", "calories", "total_carb"])


def test_top_items_under_skew(spark):
    df, pdf = _skewed(spark)
    got = sorted((r.restaurant, r.item, r.max_calories, r.rank) for r in reports.top_items(df, None, 5).collect())
    g = pdf.groupby(["restaurant", "item"], as_index=False)["calories"].max()
    g = g.sort_values(["restaurant", "calories", "item"], ascending=[True, False, True])
    g["rank"] = g.groupby("restaurant").cumcount() + 1
    want = sorted((r.restaurant, r.item, r.calories, r.rank) for r in g[g["rank"] <= 5].itertuples())
    assert got == want


def test_max_calorie_items_under_skew(spark):
    df, pdf = _skewed(spark)
    got = {r.restaurant: (r.item, r.max_calories) for r in reports.max_calorie_items(df).collect()}
    best = pdf.sort_values(["restaurant", "calories", "id"], ascending=[True, False, True]).groupby("restaurant").head(1)
    want = {r.restaurant: (r.item, r.calories) for r in best.itertuples()}
    assert got == want


def test_fact_variants_equal_direct(spark):
    df, pdf = _skewed(spark)
    lines = df.select(F.col("id").alias("key"), "calories", "total_carb", F.col("id").alias("line"))
    items = df.select(F.col("id").alias("key"), "restaurant", "item")
    a = {r.restaurant: (round(r.avg_calories, 9), r.min_calories, r.max_calories)
         for r in reports.nutrition_stats_by_key(lines, items).collect()}
    b = {r.restaurant: (round(r.avg_calories, 9), r.min_calories, r.max_calories)
         for r in reports.nutrition_stats(df).collect()}
    assert a == b
    c = {r.restaurant: (r.item, r.max_calories) for r in
         reports.max_calorie_items_by_key(lines, items, ["line"]).collect()}
    d = {r.restaurant: (r.item, r.max_calories) for r in reports.max_calorie_items(df).collect()}
    assert c == d


@pytest.fixture()
def shuffled(spark):
    """Shuffle joins only, whose tasks are as many as shuffle partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _rows_per_task(df):
    n = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())
    return n[-1], n[len(n) // 2], sum(n)


def test_a_hot_name_is_not_gathered_by_the_translation(spark, shuffled):
    """90 % of all rows have one name."""
    from platelens.operators.translate import add_translation
    hot = F.when(F.col("id") % 10 > 0, F.lit("Cheese Burger")).otherwise(F.concat(F.lit("dish "), (F.col("id") % 997).cast("string")))
    items = spark.range(60000).select("id", hot.alias("item"))
    lookup = spark.createDataFrame([("dish 10", "X"), ("dish 20", None)], "item string, item_gr string")
    lexicon = spark.createDataFrame([("Cheese", "Tyri"), ("dish", "piato")], "word string, word_tr string")
    out = add_translation(items, lookup, lexicon)
    most, median, total = _rows_per_task(out)
    assert total == 60000 and most <= 2 * median
    got = {r.item: r.item_gr for r in out.select("item", "item_gr").distinct().collect()}
    assert got["Cheese Burger"] == "Tyri Burger" and got["dish 10"] == "X" and got["dish 20"] is None
    assert got["dish 30"] == "piato 30" and out.where("item_gr IS NULL AND item <> 'dish 20'").count() == 0


def test_a_hot_tie_is_not_gathered_by_the_rank(spark, shuffled):
    """90 % of all rows share one value, some have none."""
    from platelens.operators.ranking import global_rank
    v = F.when(F.col("id") % 10 > 0, F.lit(7.0)).when(F.col("id") % 100 > 0, (F.col("id") % 1009).cast("double"))
    df = spark.range(60000).select("id", v.alias("v"))
    out = global_rank(df, [F.desc("v")], "rank", tie_cols=["v"])
    most, median, total = _rows_per_task(out)
    assert total == 60000 and most <= 2 * median
    df.createOrReplaceTempView("tied")
    want = {r.id: r.r for r in spark.sql("SELECT id, rank() OVER (ORDER BY v DESC) AS r FROM tied").collect()}
    assert {r.id: r["rank"] for r in out.collect()} == want


def test_spread_join_is_a_left_join_with_null_keys(spark, shuffled):
    from platelens.operators.joins import hot_keys, spread_join
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("a"), F.lit("x").alias("b"))
    table = spark.createDataFrame([(0, "x", 10), (1, "x", None), (None, "x", 30), (4, "y", 40)], "a long, b string, v int")
    counts = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    assert hot_keys(counts, parts=5).count() < 5
    want = sorted((r.id, {0: 10, None: 30}.get(r.a)) for r in rows.collect())
    for parts in (1, 4, 1000):                       # none, some, all of the keys are hot
        out = spread_join(rows, table, ["a", "b"], counts, parts=parts)
        assert out.columns == ["id", "a", "b", "v"] and sorted((r.id, r.v) for r in out.collect()) == want


def test_prefix_sums_over_many_ranges(spark):
    from platelens.operators.ranking import prefix_sums
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 11).alias("n"))
    got = {r.k: r._before for r in prefix_sums(df, [F.desc("k")], "n").collect()}
    total, want = 0, {}
    for r in sorted(df.collect(), key=lambda r: -r.k):
        want[r.k] = total
        total += r.n
    assert got == want
