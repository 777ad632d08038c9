"""Distributed rank / dense ids equal SQL rank / row_number."""

import random

from pyspark.sql import functions as F

from platelens.operators.ranking import global_rank, sequence_ids


def test_global_rank_matches_sql(spark):
    random.seed(7)
    rows = [(i, float(random.randint(0, 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    got = {r.k: r.rank for r in global_rank(df, [F.desc("v")], "rank", tie_cols=["v"]).collect()}
    df.createOrReplaceTempView("rk")
    want = {r.k: r.r for r in spark.sql("SELECT k, rank() OVER (ORDER BY v DESC) AS r FROM rk").collect()}
    assert got == want


def test_row_number_dense(spark):
    df = spark.range(0, 1000, 1, 9).withColumn("v", F.col("id") % 13)
    got = sorted(r.rank for r in global_rank(df, [F.asc("v"), F.asc("id")], "rank").collect())
    assert got == list(range(1, 1001))


def test_sequence_ids_dense_in_order(spark):
    df = spark.range(0, 500, 1, 5).withColumn("g", (F.col("id") / 100).cast("int")).where("id % 3 <> 0")
    out = sequence_ids(df, ["g"], "seq").orderBy("id").collect()
    assert [r.seq for r in out] == list(range(1, len(out) + 1))


def test_global_rank_over_many_range_partitions_loses_no_row(spark, tmp_dir):
    path = tmp_dir + "/ranked"
    spark.range(400_000).select((F.col("id") % 50_000).alias("v"), "id").repartition(16).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = global_rank(spark.read.parquet(path), [F.desc("v")], "rank", tie_cols=["v"])
        assert out.count() == 400_000
        assert out.where("rank <> (49999 - v) * 8 + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_hot_value_and_nulls_share_their_rank(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7.0).when(F.col("id") < 900, F.col("id") * 1.0).alias("v"))
    got = {r.id: r["rank"] for r in global_rank(df, [F.desc("v")], "rank", tie_cols=["v"]).collect()}
    df.createOrReplaceTempView("hot")
    assert got == {r.id: r.r for r in spark.sql("SELECT id, rank() OVER (ORDER BY v DESC) r FROM hot").collect()}
