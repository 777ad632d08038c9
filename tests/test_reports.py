"""Report operators: ties, top-n, labels, shares, roll-up, browse."""

from pyspark.sql import functions as F

from platelens.functions.text import number_text
from platelens.operators import reports


def _menu(spark):
    rows = [
        (1, "A", "x", "X", 500.0, 10.0), (2, "A", "y", "Y", 500.0, 20.0), (3, "A", "z", None, 100.0, 30.0),
        (4, "B", "x", "X", 700.0, 40.0), (5, "B", "x", "X2", 700.0, 50.0), (6, "B", "w", "W", 650.5, 60.0),
        (7, "C", "q", "Q", 1210.0, 5.0),
    ]
    return spark.createDataFrame(rows, "id long, restaurant string, item string, item_gr string, "
                                       "calories double, total_carb double")


def test_nutrition_stats(spark):
    r = reports.nutrition_stats(_menu(spark)).collect()
    assert [x.restaurant for x in r] == ["B", "A", "C"]
    a = [x for x in r if x.restaurant == "A"][0]
    assert (a.min_calories, a.max_calories, a.avg_carbohydrates) == (100.0, 500.0, 20.0)


def test_restaurant_rank_ties(spark):
    df = spark.createDataFrame([("A", 1.0, 5.0), ("B", 1.0, 5.0), ("C", 1.0, 7.0), ("D", 1.0, 1.0)],
                               "restaurant string, calories double, total_carb double")
    got = sorted((r.restaurant, r.carb_rank) for r in reports.restaurant_rank(df).collect())
    assert got == [("A", 2), ("B", 2), ("C", 1), ("D", 4)]


def test_max_calorie_items_lowest_id_wins(spark):
    r = {x.restaurant: x for x in reports.max_calorie_items(_menu(spark)).collect()}
    assert (r["A"].item, r["A"].item_gr, r["A"].label) == ("x", "X", "x<br>X")
    assert (r["B"].item, r["B"].item_gr) == ("x", "X")
    assert r["A"].avg_carbohydrates == 20.0


def test_listed_filter(spark):
    r = reports.max_calorie_items(_menu(spark), ["A", "C", "Nope"]).collect()
    assert sorted(x.restaurant for x in r) == ["A", "C"]


def test_top_items_and_labels(spark):
    t = reports.top_items(_menu(spark), None, 2).collect()
    got = [(x.restaurant, x.item, x.rank, x.max_calories) for x in t]
    assert got == [("A", "x", 1, 500.0), ("A", "y", 2, 500.0), ("B", "x", 1, 700.0), ("B", "w", 2, 650.5),
                   ("C", "q", 1, 1210.0)]
    lab = {(x.restaurant, x.item): x.label for x in t}
    assert lab[("C", "q")] == "q<br>Q<br>Calories: 1210"
    assert lab[("B", "w")] == "w<br>W<br>Calories: 650.5"
    a_z = reports.top_items(_menu(spark), None, 3).where("item = 'z'").first()
    assert a_z.label is None and a_z.label_short is None      # null part -> null label


def test_number_text(spark):
    df = spark.createDataFrame([(1210.0,), (650.5,), (0.0,)], "x double")
    assert [r[0] for r in df.select(number_text("x")).collect()] == ["1210", "650.5", "0"]


def test_share_sums_to_one(spark):
    r = reports.avg_carbs_share(_menu(spark)).collect()
    assert abs(sum(x.share for x in r) - 1.0) < 1e-12


def test_rollup(spark):
    top = reports.top_items(_menu(spark), None, 5)
    r = reports.hierarchy_rollup(top).collect()
    root = [x for x in r if x.level == 3][0]
    parents = {x.restaurant: x.value for x in r if x.level == 1}
    assert abs(root.value - sum(parents.values())) < 1e-9 and abs(root.share_of_root - 1.0) < 1e-12
    assert parents["A"] == 1100.0


def test_browse_page(spark):
    df = spark.createDataFrame([(str(i % 3), f"n{i:02d}") for i in range(20)], "category string, item string")
    page = reports.browse(df, [("category", "desc"), ("item", "asc")], limit=4, offset=2).collect()
    assert [(x.category, x.item) for x in page] == [("2", "n08"), ("2", "n11"), ("2", "n14"), ("2", "n17")]
