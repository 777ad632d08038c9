"""Physical plans: pushdown, partial top-n, no cartesian products."""

import pytest

import __spark_entry__ as E
from platelens.operators import reports
from platelens.plans import views
from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_in_list_pushed_to_scan(spark):
    p = views.table(spark, SF001, "part").where("p_brand IN ('Brand#1', 'Brand#2')").select("p_name")
    s = _plan(p)
    assert "PushedFilters: [In(p_brand" in s or "PushedFilters: [IsNotNull(p_brand), In(p_brand" in s


def test_top_n_uses_partial_window_group_limit(spark):
    top = reports.top_items(views.translated_items(spark, SF001), None, 5)
    assert "WindowGroupLimit" in _plan(top)


@pytest.mark.parametrize("name", ["nutrition_stats", "max_calorie_items", "avg_carbs_share",
                                  "top5_items_rollup", "translate_items", "restaurant_rank"])
def test_no_cartesian_product(spark, name):
    s = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in s and "BroadcastNestedLoopJoin" not in s


def _read_schemas(df):
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [line.split("ReadSchema: ", 1)[1] for line in text.splitlines() if "ReadSchema:" in line]


def test_fact_scan_reads_only_needed_columns(spark):
    df = E.queries()["top5_items_facts"](spark, SF001)
    schemas = _read_schemas(df)
    li = [s for s in schemas if "l_partkey" in s]
    assert li and all(s == "struct<l_partkey:bigint,l_extendedprice:double>" for s in li)
    pt = [s for s in schemas if "p_partkey" in s]
    assert pt and all("p_type" not in s and "p_size" not in s for s in pt)


@pytest.mark.parametrize("name", ["nutrition_stats_facts", "max_calorie_items_facts", "top5_items_facts_listed"])
def test_fact_queries_no_cartesian(spark, name):
    s = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in s and "BroadcastNestedLoopJoin" not in s


@pytest.mark.parametrize("name", ["max_calorie_items_facts", "max_calorie_items_facts_listed"])
def test_no_sort_aggregate_over_the_lines(spark, name):
    s = _plan(E.queries()[name](spark, SF001))
    assert "SortAggregate" not in s and "HashAggregate" in s


def test_deep_pages_hold_one_range(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), (F.col("id") % 7).cast("string").alias("s"))
    rows = sorted(map(tuple, df.collect()), key=lambda r: (r[1], -r[0]))
    sort = [("s", "asc"), ("k", "desc")]
    for offset, limit in ((2500, 40), (1, 3), (4990, 40), (5000, 5), (9000, 5), (4000, None)):
        page = reports.browse(df, sort, limit, offset, shallow=0)
        want = rows[offset:] if limit is None else rows[offset:offset + limit]
        assert [tuple(r) for r in page.collect()] == want
    page = reports.browse(df, sort, 40, 2500, shallow=0)
    text = page._sc._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(_mid" in text and "LessThan(_mid" in text      # the scan skips the other ranges
    assert page.sparkSession.range(0).select("id").count() == 0
    assert reports.browse(df.limit(0), sort, 10, 10, shallow=0).collect() == []
