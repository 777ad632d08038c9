"""Same results under 1, 4 and 17 partitions and shuffled input (SURVEY 5 (4))."""

import pytest
from pyspark.sql import functions as F

from platelens.operators import reports
from platelens.operators.translate import add_translation
from platelens.plans import views

from conftest import SF001


def _rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


OPS = {
    "nutrition_stats": lambda t: reports.nutrition_stats(t),
    "restaurant_rank": lambda t: reports.restaurant_rank(t),
    "max_calorie_items": lambda t: reports.max_calorie_items(t),
    "avg_carbs_share": lambda t: reports.avg_carbs_share(t),
    "top_items": lambda t: reports.top_items(t, None, 5),
    "rollup": lambda t: reports.hierarchy_rollup(reports.top_items(t, None, 5)),
}


@pytest.fixture(scope="module")
def base(spark):
    return views.translated_items(spark, SF001).persist()


@pytest.mark.parametrize("op", sorted(OPS))
def test_reports_partition_invariant(spark, base, op):
    want = _rows(OPS[op](base))
    for n in (1, 4, 17):
        assert _rows(OPS[op](base.repartition(n))) == want
    shuffled = base.orderBy(F.xxhash64("id", F.lit(7)))
    assert _rows(OPS[op](shuffled.repartition(5))) == want


def test_translation_partition_invariant(spark):
    items = views.items(spark, SF001)
    d, lx = views.dictionary(spark, SF001), views.lexicon(spark, SF001)
    want = _rows(add_translation(items, d, lx).select("id", "item_gr"))
    for n in (1, 4, 17):
        got = add_translation(items.repartition(n), d.repartition(n), lx.repartition(n)).select("id", "item_gr")
        assert _rows(got) == want
