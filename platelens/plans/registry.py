"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query runs over the whole driver tables (or data Spark derives from
them). Doubles whose last bits depend on the order of addition are rounded
to 6 decimals (4 for profile means), exactly as in the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import coerce_numeric
from ..functions.text import clean_item_name, number_text
from ..operators import reports
from ..operators.joins import write_back
from ..operators.kmeans import classify, inertia
from ..operators.nulls import drop_nulls, null_tokens_to_null, valid_feature_flag
from ..operators.pca import correlation_matrix, pca_scores
from ..operators.scaling import stats_frame, standardize
from ..operators.translate import add_translation, dedupe_lookup
from ..schema import FEATURES, MENU_SCHEMA
from ..session import scratch_path
from ..sources.csv_io import read_csv_text, read_lookup_csv, write_csv
from ..sources.keys import tag_file_position, with_file_order_ids
from ..sources.tables import drop_table, reset_table, table_location
from . import views
from .jobs import browse_categories, export_categories, load_items, load_menu_table, read_categories
from .oracle import LISTED

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# --- reports -----------------------------------------------------------------

def q_nutrition_stats(spark, d):
    return _round(reports.nutrition_stats(views.items(spark, d)), ["avg_calories", "avg_carbohydrates"])


def q_restaurant_rank(spark, d):
    r = reports.restaurant_rank(views.items(spark, d))
    return _round(r, ["avg_calories", "avg_carbohydrates"]).withColumn("carb_rank", F.col("carb_rank").cast("bigint"))


def _max_cal(listed):
    def q(spark, d):
        r = reports.max_calorie_items(views.translated_items(spark, d), LISTED if listed else None)
        return _round(r, ["avg_carbohydrates"])
    return q


def _share(listed):
    def q(spark, d):
        r = reports.avg_carbs_share(views.items(spark, d), LISTED if listed else None)
        return _round(r, ["avg_carbohydrates", "share"])
    return q


def _rank_bigint(df: DataFrame) -> DataFrame:
    # SQL's row_number() is BIGINT; Spark's is INT.
    return df.withColumn("rank", F.col("rank").cast("bigint"))


def _top(listed):
    def q(spark, d):
        return _rank_bigint(reports.top_items(views.translated_items(spark, d), LISTED if listed else None, 5))
    return q


def q_top5_items_rollup(spark, d):
    top = reports.top_items(views.translated_items(spark, d), None, 5)
    return _round(reports.hierarchy_rollup(top), ["value", "share_of_root"])


def q_nutrition_stats_facts(spark, d):
    r = reports.nutrition_stats_by_key(views.fact_lines(spark, d), views.fact_items(spark, d))
    return _round(r, ["avg_calories", "avg_carbohydrates"])


def _max_cal_facts(listed):
    def q(spark, d):
        r = reports.max_calorie_items_by_key(views.fact_lines(spark, d), views.fact_items(spark, d),
                                             views.LINE_ID, "key", LISTED if listed else None)
        return _round(r, ["avg_carbohydrates"])
    return q


def _top_facts(listed):
    def q(spark, d):
        return _rank_bigint(reports.top_items_by_key(views.fact_lines(spark, d), views.fact_items(spark, d),
                                                     "key", 5, LISTED if listed else None))
    return q


# --- load: cleaning, nulls, coercion, CSV, ids ----------------------------------

def q_clean_names(spark, d):
    raw = views.items_raw(spark, d)
    return raw.select("id", F.col("item").alias("raw_item"), clean_item_name("item").alias("item"))


def q_drop_nulls(spark, d):
    raw = null_tokens_to_null(views.menu_raw(spark, d))
    kept = drop_nulls(raw)
    return kept.select("restaurant", "item", coerce_numeric("calories").alias("calories"))


def q_coerce_numeric(spark, d):
    raw = null_tokens_to_null(views.menu_raw(spark, d, with_id=True))
    typed = raw.select("id", *[coerce_numeric(c).alias(c) for c in FEATURES + ["sodium", "vit_c"]])
    return typed.select("id", "sodium", "vit_c", "calcium",
                        valid_feature_flag(FEATURES).alias("valid_features"))


def q_load_items(spark, d):
    path = _fresh(spark, "menu_csv")
    write_csv(_sorted_menu(spark, d), path)
    return load_items(spark, path)


def _sorted_menu(spark, d):
    return views.menu_raw(spark, d, with_id=True).orderBy("id").drop("id")


def q_load_by_header(spark, d):
    """Columns in reverse order and one missing: matched by the header's names."""
    path = _fresh(spark, "menu_csv")
    menu = _sorted_menu(spark, d)
    write_csv(menu.select(*[c for c in reversed(menu.columns) if c != "vit_a"]), path)
    return load_items(spark, path)


def q_load_append(spark, d):
    """DDL, reset, then two loads into one table, ids going on."""
    name = f"platelens_{uuid.uuid4().hex[:12]}"
    menu = views.menu_raw(spark, d, with_id=True)
    for attempt in ("create", "reset"):
        reset_table(spark, name, _fresh(spark, "menu_table"))
        for odd in ((0,) if attempt == "create" else (0, 1)):
            path = _fresh(spark, "menu_csv")
            write_csv(menu.where(F.col("id") % 2 == odd).orderBy("id").drop("id"), path)
            load_menu_table(spark, path, name)
    rows = spark.read.schema(MENU_SCHEMA).parquet(table_location(spark, name))
    drop_table(spark, name)          # the table's files stay in its own folder
    return rows


def q_number_labels(spark, d):
    p = views.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"),
                    number_text(F.col("p_partkey") + F.lit(10000000.5)).alias("large"),
                    number_text(F.col("p_size") / F.lit(10000.0)).alias("small"),
                    number_text(F.col("p_size") * F.lit(3e17)).alias("wide"),
                    number_text(-F.col("p_size") * F.lit(1e20)).alias("vast"),
                    coerce_numeric(F.concat(F.col("p_size").cast("string"), F.lit("e400"))).alias("huge"))


def q_csv_roundtrip(spark, d):
    """Dirty names (quotes, commas, NBSP, tab, inch marks) and null tokens
    through CSV write -> read: text comes back as written, tokens as null."""
    from pyspark.sql import types as T
    path = _fresh(spark, "raw_csv")
    write_csv(views.menu_raw(spark, d, with_id=True).select("id", "restaurant", "item", "sodium"), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "restaurant", "item", "sodium")])
    back = read_csv_text(spark, path, schema)
    return back.select(F.col("id").cast("bigint").alias("id"), "restaurant", "item",
                       coerce_numeric("sodium").alias("sodium"))


def q_surrogate_key(spark, d):
    path = _fresh(spark, "lineitem_sorted")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    (views.table(spark, d, "lineitem").select(*keys).orderBy(*keys)
     .write.mode("overwrite").parquet(path))
    tagged = tag_file_position(spark.read.parquet(path))
    return with_file_order_ids(tagged, "id").select("id", *keys)


# --- translation ------------------------------------------------------------------

def _dictionary_via_csv(spark, d):
    path = _fresh(spark, "dictionary_csv")
    write_csv(views.dictionary(spark, d).orderBy("pos").select("item", "item_gr"), path)
    return read_lookup_csv(spark, path)          # pos = row order in the file


def q_translate_lookup(spark, d):
    items = views.items(spark, d)
    dct = dedupe_lookup(_dictionary_via_csv(spark, d)).withColumn("in_dictionary", F.lit(True))
    j = items.join(dct, "item", "left")
    return j.select("id", "item", "item_gr", F.coalesce("in_dictionary", F.lit(False)).alias("in_dictionary"))


def q_translate_words(spark, d):
    from ..operators.translate import dedupe_lexicon, translate_words
    names = views.items(spark, d).select("item").distinct()
    missing = names.join(dedupe_lookup(views.dictionary(spark, d)), "item", "left_anti")
    return translate_words(missing, dedupe_lexicon(views.lexicon(spark, d)))


def q_translate_items(spark, d):
    return views.translated_items(spark, d).select("id", "item", "item_gr")


def q_translate_hook(spark, d):
    """The fallback through a pandas function over the distinct missing words."""
    out = add_translation(views.items(spark, d), views.dictionary(spark, d), names=views.item_names(spark, d),
                          translate_word=lambda words: words.str[::-1].str.upper())
    return out.select("id", "item", "item_gr")


def q_write_back(spark, d):
    items = views.items(spark, d)
    base = items.select("id", "item", F.col("item").alias("item_gr"))
    hits = items.join(dedupe_lookup(views.dictionary(spark, d)), "item", "inner").select("id", "item_gr")
    return write_back(base, hits, "id", ["item_gr"])


# --- scaling, clustering, PCA -------------------------------------------------------

def q_feature_stats(spark, d):
    return _round(stats_frame(views.items(spark, d), FEATURES), ["mean", "sd"])


def q_standardize(spark, d):
    z = standardize(views.items(spark, d), FEATURES)
    zc = ["z_" + f for f in FEATURES]
    return _round(z.select("id", *zc), zc)


def _lloyd_categorized(spark, d):
    return classify(views.translated_items(spark, d), FEATURES, 3, start="first", fit_on=views.items(spark, d)).assigned


def q_kmeans_fixed_start(spark, d):
    return _lloyd_categorized(spark, d).select("id", "cluster", "category")


def q_kmeans_fixed_names(spark, d):
    """Categories by the fixed cluster -> name map."""
    res = classify(views.translated_items(spark, d), FEATURES, 3, start="first", naming="fixed", fit_on=views.items(spark, d))
    return res.assigned.select("id", "cluster", "category")


def q_category_profile(spark, d):
    c = _lloyd_categorized(spark, d)
    prof = c.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"),
                                     *[F.avg(f).alias(f"avg_{f}") for f in FEATURES])
    return _round(prof, [f"avg_{f}" for f in FEATURES], 4)


def q_kmeans_categories(spark, d):
    res = classify(views.translated_items(spark, d), FEATURES, 3, fit_on=views.items(spark, d))
    return res.assigned.select("id", "restaurant", "item", "cluster", "category")


def q_correlation_matrix(spark, d):
    return _round(correlation_matrix(views.items(spark, d), FEATURES), ["corr"])


def q_pca_scores(spark, d):
    items = _lloyd_categorized(spark, d)
    return _round(pca_scores(items, FEATURES, 2).scores, ["PC1", "PC2"])


def q_kmeans_invalid_kept(spark, d):
    """Text features: rows with one that is no number stay, without a category."""
    menu = views.menu_raw(spark, d, with_id=True).select("id", *FEATURES)
    return classify(menu, FEATURES, 3, start="first").assigned.select("id", "cluster", "category")


def q_inertia(spark, d):
    items = views.items(spark, d)
    res = classify(items, FEATURES, 3, start="first")
    zc = ["z_" + f for f in FEATURES]
    z = standardize(res.assigned.where("cluster IS NOT NULL"), FEATURES)
    total = inertia(z, zc, res.centroids)
    return z.agg(F.round(F.lit(total), 4).alias("inertia"), F.count(F.lit(1)).alias("n_items"))


def q_top5_items_rollup_label(spark, d):
    top = reports.top_items(views.translated_items(spark, d), None, 5)
    return _round(reports.hierarchy_rollup(top, ("restaurant", "label")), ["value", "share_of_root"])


def _export(spark, d):
    path = _fresh(spark, "categories_csv")
    export_categories(_lloyd_categorized(spark, d), path)
    return path


def q_export_roundtrip(spark, d):
    return read_categories(spark, _export(spark, d))


def q_browse_categories(spark, d):
    return browse_categories(spark, _export(spark, d), [("category", "asc"), ("item", "desc")],
                             limit=25, offset=10)


def q_browse_deep(spark, d):
    """A page from the middle of the table, read from the ranges it lies in."""
    t = read_categories(spark, _export(spark, d))
    return reports.browse(t, [("item", "desc"), ("category", "asc")], limit=1000, offset=t.count() // 2, shallow=0)


def _menu_with_line_breaks(spark, d):
    """The sorted menu with a line feed in place of every space of an item that has
    one, and in some a carriage return too; text quoted."""
    menu = _sorted_menu(spark, d)
    item = F.when(F.length("item") % 3 == 0, F.replace(F.col("item"), F.lit(" "), F.lit("\r\n"))).otherwise(
        F.replace(F.col("item"), F.lit(" "), F.lit("\n")))
    path = _fresh(spark, "menu_csv")
    write_csv(menu.withColumn("item", item), path)
    return path


def q_load_line_breaks(spark, d):
    """Quoted line breaks, read in splits (cleaning turns them into spaces)."""
    return load_items(spark, _menu_with_line_breaks(spark, d), multiline="split")


def q_browse_all(spark, d):
    return browse_categories(spark, _export(spark, d), [("item", "asc")])


QUERIES: dict[str, Query] = {
    "nutrition_stats": q_nutrition_stats,
    "restaurant_rank": q_restaurant_rank,
    "max_calorie_items": _max_cal(False),
    "max_calorie_items_listed": _max_cal(True),
    "avg_carbs_share": _share(False),
    "avg_carbs_share_listed": _share(True),
    "top5_items_label": _top(False),
    "top5_items_label_listed": _top(True),
    "top5_items_rollup": q_top5_items_rollup,
    "nutrition_stats_facts": q_nutrition_stats_facts,
    "top5_items_facts": _top_facts(False),
    "max_calorie_items_facts": _max_cal_facts(False),
    "max_calorie_items_facts_listed": _max_cal_facts(True),
    "top5_items_facts_listed": _top_facts(True),
    "clean_names": q_clean_names,
    "drop_nulls": q_drop_nulls,
    "coerce_numeric": q_coerce_numeric,
    "load_items": q_load_items,
    "csv_roundtrip": q_csv_roundtrip,
    "surrogate_key": q_surrogate_key,
    "translate_lookup": q_translate_lookup,
    "translate_words": q_translate_words,
    "translate_items": q_translate_items,
    "write_back": q_write_back,
    "feature_stats": q_feature_stats,
    "standardize": q_standardize,
    "kmeans_fixed_start": q_kmeans_fixed_start,
    "category_profile": q_category_profile,
    "kmeans_categories": q_kmeans_categories,
    "correlation_matrix": q_correlation_matrix,
    "pca_scores": q_pca_scores,
    "export_roundtrip": q_export_roundtrip,
    "browse_categories": q_browse_categories,
    "browse_all": q_browse_all,
    "browse_deep": q_browse_deep,
    "load_line_breaks": q_load_line_breaks,
    "kmeans_fixed_names": q_kmeans_fixed_names,
    "load_by_header": q_load_by_header,
    "load_append": q_load_append,
    "number_labels": q_number_labels,
    "translate_hook": q_translate_hook,
    "kmeans_invalid_kept": q_kmeans_invalid_kept,
    "inertia": q_inertia,
    "top5_items_rollup_label": q_top5_items_rollup_label,
}

# Queries without oracle SQL, checked only by row count: none.
ROWS_ONLY: set[str] = set()
