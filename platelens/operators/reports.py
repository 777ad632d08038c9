"""Report tables over the menu table (restaurant, item, item_gr, calories,
total_carb, id ...).

Ties are broken deterministically: an arg-max keeps the lowest id among rows
with the same maximum, a per-restaurant ranking orders equal values by item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, number_text
from .ranking import global_rank, laid_out, partition_offsets

#: A page that ends within so many rows of the start is read by a top-n sort.
SHALLOW = 10_000


def _listed(items: DataFrame, restaurants: list[str] | None) -> DataFrame:
    # IN-list on the base scan: Catalyst pushes it to the parquet reader.
    return items if restaurants is None else items.where(F.col("restaurant").isin(list(restaurants)))


def nutrition_stats(items: DataFrame) -> DataFrame:
    """Per restaurant: avg/min/max calories and avg carbohydrates, sorted by
    avg carbohydrates (desc), restaurant."""
    return (items.groupBy("restaurant")
            .agg(F.avg("calories").alias("avg_calories"),
                 F.min("calories").alias("min_calories"),
                 F.max("calories").alias("max_calories"),
                 F.avg("total_carb").alias("avg_carbohydrates"))
            .orderBy(F.desc("avg_carbohydrates"), "restaurant"))


def restaurant_rank(items: DataFrame) -> DataFrame:
    """``nutrition_stats`` plus the SQL rank of each restaurant by average
    carbohydrates (1 = highest; equal averages share a rank)."""
    stats = nutrition_stats(items)
    return (global_rank(stats, [F.desc("avg_carbohydrates")], "carb_rank",
                        tie_cols=["avg_carbohydrates"])
            .orderBy("carb_rank", "restaurant"))


def max_calorie_items(items: DataFrame, restaurants: list[str] | None = None) -> DataFrame:
    """Per restaurant the item with the most calories (lowest id on ties),
    its translation, the maximum, the average carbohydrates and a hover label
    ``item<br>item_gr``. One aggregation, no self-join."""
    top = F.max_by(F.struct("item", "item_gr"), F.struct(F.col("calories"), -F.col("id")))
    agg = (_listed(items, restaurants).groupBy("restaurant")
           .agg(top.alias("_top"),
                F.max("calories").alias("max_calories"),
                F.avg("total_carb").alias("avg_carbohydrates")))
    return (agg.select("restaurant",
                       F.col("_top.item").alias("item"),
                       F.col("_top.item_gr").alias("item_gr"),
                       "max_calories", "avg_carbohydrates",
                       label(F.col("_top.item"), "<br>", F.col("_top.item_gr")).alias("label"))
            .orderBy(F.desc("max_calories"), "restaurant"))


def avg_carbs_share(items: DataFrame, restaurants: list[str] | None = None) -> DataFrame:
    """Average carbohydrates per restaurant and each one's share of the sum of
    those averages (the donut slices). The total is a scalar subquery: computed
    by a distributed aggregate, used as a constant - no cross join and no
    single-partition window."""
    avgs = (_listed(items, restaurants).groupBy("restaurant")
            .agg(F.avg("total_carb").alias("avg_carbohydrates")))
    total = avgs.select(F.sum("avg_carbohydrates")).scalar()
    return (avgs.withColumn("share", F.try_divide(F.col("avg_carbohydrates"), total))
            .orderBy(F.desc("avg_carbohydrates"), "restaurant"))


def top_items(items: DataFrame, restaurants: list[str] | None = None, n: int = 5) -> DataFrame:
    """Top ``n`` items per restaurant by their maximum calories.

    Items are first grouped by (restaurant, item): ``max_calories`` is the
    maximum, ``item_gr`` comes from the max-calorie row (lowest id on ties).
    Then ``row_number`` per restaurant ordered by max_calories desc, item;
    rows with rank <= n are kept. Spark plans the rank filter as a partial
    WindowGroupLimit before the shuffle, so a restaurant with millions of
    items sends only ``n`` rows per task to the final window.

    Two labels: ``label`` (item<br>item_gr<br>Calories: N) and ``label_short``
    (item<br>item_gr); null when the translation is null.
    """
    grouped = (_listed(items, restaurants).groupBy("restaurant", "item")
               .agg(F.max("calories").alias("max_calories"),
                    F.max_by("item_gr", F.struct(F.col("calories"), -F.col("id"))).alias("item_gr")))
    w = Window.partitionBy("restaurant").orderBy(F.desc("max_calories"), "item")
    ranked = grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return (ranked.select(
                "restaurant", "item", "item_gr", "max_calories", "rank",
                label(F.col("item"), "<br>", F.col("item_gr"), "<br>", "Calories: ",
                      number_text("max_calories")).alias("label"),
                label(F.col("item"), "<br>", F.col("item_gr")).alias("label_short"))
            .orderBy("restaurant", F.desc("max_calories"), "item"))


def hierarchy_rollup(top: DataFrame, path: tuple[str, str] = ("restaurant", "label_short"),
                     value: str = "max_calories") -> DataFrame:
    """Two-level hierarchy (root, parent, leaf) of ``value``.

    Leaves keep their value, a parent is the sum of its children, the root
    the sum of all; ``level`` is 0 for leaves, 1 for parents, 3 for the root
    (the grouping id); ``share_of_root`` is value / root value."""
    parent, leaf = path
    total = top.select(F.sum(value)).scalar()
    r = (top.rollup(parent, leaf)
         .agg(F.sum(value).alias("value"), F.grouping_id().alias("level")))
    return r.select(F.col(parent), F.col(leaf), "value",
                    F.col("level").cast("int").alias("level"),
                    F.try_divide(F.col("value"), total).alias("share_of_root"))


def browse(df: DataFrame, sort: list[tuple[str, str]], limit: int | None = None,
           offset: int = 0, shallow: int = SHALLOW) -> DataFrame:
    """One page of a table sorted by user-chosen columns ('asc' / 'desc').

    All columns are appended as a final tie-break, so a page is the same on
    every run. A page within the first ``shallow`` rows is planned as a
    TakeOrderedAndProject (each task keeps only offset + limit rows). A deeper one
    (see ``deep_page``) reads only the ranges of the sorted table it lies in.
    """
    keys = [F.desc(c) if d.lower().startswith("d") else F.asc(c) for c, d in sort]
    chosen = {c for c, _ in sort}
    keys += [F.asc_nulls_first(c) for c in df.columns if c not in chosen]
    if offset and (limit is None or offset + limit > shallow):
        return deep_page(df, keys, limit, offset)
    out = df.orderBy(*keys)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def deep_page(df: DataFrame, keys: list, limit: int | None, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in the order of ``keys``, sorted.

    The table is laid out once in range partitions, each sorted, and its rows
    numbered there. The counts of the ranges (one row each, as many as shuffle
    partitions) turn both ends of the page into places, and the page is the rows
    between them: the scan skips all ranges, and all blocks of them, outside.
    No task holds more than a range, whatever the offset.
    """
    x = laid_out(df, keys, "browse")
    ranges = [tuple(r) for r in partition_offsets(x, F.lit(1), count=True).orderBy("_off").collect()]

    def place(at: int) -> int:
        """The place of the row number ``at``, or one past the last row."""
        for _, off, first, n in ranges:
            if at < off + n:
                return first + at - off
        return ranges[-1][2] + ranges[-1][3] if ranges else 0

    page = x.where(F.col("_mid") >= place(offset))
    if limit is not None:
        page = page.where(F.col("_mid") < place(offset + limit))
    return page.orderBy("_mid").drop("_mid", "_pid")


# --- fact-scale variants ---------------------------------------------------------
#
# The same reports when every sales line is a menu row: lines (key, value,
# carbs) reference items (key, restaurant, item). Lines are aggregated per
# item key first (partial aggregation on the map side, one shuffle on the
# key), and only those per-key partials are joined with the items; a key
# holding a third of all lines becomes one row per task before any shuffle.

def nutrition_stats_by_key(lines: DataFrame, items: DataFrame, key: str = "key") -> DataFrame:
    """``nutrition_stats`` over ``lines`` (key, calories, total_carb) whose
    restaurant comes from ``items`` (key, restaurant)."""
    per_key = lines.groupBy(key).agg(
        F.sum("calories").alias("_s"), F.count("calories").alias("_n"),
        F.min("calories").alias("_mn"), F.max("calories").alias("_mx"),
        F.sum("total_carb").alias("_sc"), F.count("total_carb").alias("_nc"))
    j = per_key.join(items.select(key, "restaurant"), key)
    return (j.groupBy("restaurant")
            .agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("avg_calories"),
                 F.min("_mn").alias("min_calories"),
                 F.max("_mx").alias("max_calories"),
                 F.try_divide(F.sum("_sc"), F.sum("_nc")).alias("avg_carbohydrates"))
            .orderBy(F.desc("avg_carbohydrates"), "restaurant"))


def top_items_by_key(lines: DataFrame, items: DataFrame, key: str = "key", n: int = 5,
                     restaurants: list[str] | None = None) -> DataFrame:
    """``top_items`` (without translation) over ``lines`` (key, calories):
    the maximum per key is taken before the join, then per (restaurant,
    item), then the top ``n`` items per restaurant."""
    it = _listed(items.select(key, "restaurant", "item"), restaurants)
    per_key = lines.groupBy(key).agg(F.max("calories").alias("_mx"))
    grouped = (per_key.join(it, key).groupBy("restaurant", "item")
               .agg(F.max("_mx").alias("max_calories")))
    w = Window.partitionBy("restaurant").orderBy(F.desc("max_calories"), "item")
    ranked = grouped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return (ranked.select("restaurant", "item", "max_calories", "rank",
                          label(F.col("item"), "<br>", "Calories: ", number_text("max_calories")).alias("label"))
            .orderBy("restaurant", F.desc("max_calories"), "item"))


def max_calorie_items_by_key(lines: DataFrame, items: DataFrame, line_id: list[str], key: str = "key",
                             restaurants: list[str] | None = None) -> DataFrame:
    """``max_calorie_items`` over ``lines`` (key, calories, total_carb and the
    ``line_id`` columns): per restaurant the item of the line with the most
    calories (lowest line id on ties) and the average carbohydrates.

    Every aggregate over the lines has fixed-width buffers, so it is a hash
    aggregate: the maximum and the sums per item key, then per restaurant. The
    keys that reach their restaurant's maximum, one or a few each, are looked up
    in the lines again, and only those lines are ordered by line id; a line needs
    no order of its own."""
    per_key = lines.groupBy(key).agg(
        F.max("calories").alias("_mx"), F.sum("total_carb").alias("_sc"), F.count("total_carb").alias("_nc"))
    it = _listed(items.select(key, "restaurant", "item"), restaurants)
    j = per_key.join(it, key)
    agg = (j.groupBy("restaurant")
           .agg(F.max("_mx").alias("max_calories"),
                F.try_divide(F.sum("_sc"), F.sum("_nc")).alias("avg_carbohydrates")))
    best = (j.join(agg.withColumnRenamed("restaurant", "_r"),
                   F.col("restaurant").eqNullSafe(F.col("_r")) & F.col("_mx").eqNullSafe(F.col("max_calories")))
            .select(F.col(key).alias("_k"), "restaurant", "item", "max_calories", "avg_carbohydrates"))
    top = lines.select(key, "calories", *line_id).join(
        best, (F.col(key) == F.col("_k")) & F.col("calories").eqNullSafe(F.col("max_calories")))
    w = Window.partitionBy("restaurant").orderBy(*line_id)
    return (top.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("restaurant", "item", "max_calories", "avg_carbohydrates")
            .orderBy(F.desc("max_calories"), "restaurant"))
