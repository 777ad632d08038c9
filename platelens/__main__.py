"""Run the whole menu job: load -> translate -> categorise -> export -> reports.

    python -m platelens --menu MENU_CSV --dictionary DICT_CSV [--lexicon LEX_CSV]
                        --out OUT_DIR [--restaurants "A,B,C"] [--k 3] [--method lloyd|mllib] [--multiline]

Writes under OUT_DIR: ``menu/`` (typed parquet table with item_gr and
category), ``food_categories/`` (CSV: item, item_gr, category) and one
parquet folder per report (nutrition_stats, max_calorie_items,
avg_carbs_share, top_items, top_items_rollup, pca_scores). Each output is one
Spark job writing with the usual commit protocol, so a rerun overwrites it.
"""

from __future__ import annotations

import argparse
import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import reports
from .operators.kmeans import classify
from .operators.pca import pca_scores
from .operators.translate import add_translation
from .plans.jobs import export_categories, load_items
from .schema import DEFAULT_RESTAURANTS, FEATURES, LEXICON_SCHEMA
from .session import build_session, scratch_path
from .sources.csv_io import read_csv_text, read_lookup_csv


def run(spark: SparkSession, menu: str, dictionary: str, out: str, lexicon: str | None = None,
        restaurants: list[str] | None = None, k: int = 3, method: str = "lloyd",
        multiline: bool | str = False) -> dict[str, str]:
    """Run every step; returns {output name: path}."""
    restaurants = restaurants if restaurants is not None else DEFAULT_RESTAURANTS
    paths = {}

    def dest(name: str) -> str:
        paths[name] = os.path.join(out, name)
        return paths[name]

    # written once: every later step reads the typed table, not the CSV
    path = scratch_path(spark, f"menu-{uuid.uuid4().hex[:12]}")
    load_items(spark, menu, multiline=multiline).write.parquet(path)
    items = spark.read.parquet(path)
    lookup = read_lookup_csv(spark, dictionary)
    if lexicon:
        lex = read_csv_text(spark, lexicon, LEXICON_SCHEMA)
    else:  # no lexicon: words the dictionary misses stay as they are
        lex = spark.createDataFrame([], T.StructType(LEXICON_SCHEMA.fields))
    translated = add_translation(items.drop("item_gr"), lookup, lex)
    categorized = classify(translated.drop("category"), FEATURES, k, method).assigned.drop("cluster")
    categorized.write.mode("overwrite").parquet(dest("menu"))

    menu_table = spark.read.parquet(paths["menu"])
    export_categories(menu_table, dest("food_categories"))
    reports.nutrition_stats(menu_table).write.mode("overwrite").parquet(dest("nutrition_stats"))
    reports.max_calorie_items(menu_table, restaurants).write.mode("overwrite").parquet(dest("max_calorie_items"))
    reports.avg_carbs_share(menu_table, restaurants).write.mode("overwrite").parquet(dest("avg_carbs_share"))
    top = reports.top_items(menu_table, restaurants, 5)
    top.write.mode("overwrite").parquet(dest("top_items"))
    top_saved = spark.read.parquet(paths["top_items"])
    reports.hierarchy_rollup(top_saved).write.mode("overwrite").parquet(dest("top_items_rollup"))
    valid = menu_table.where(F.col("category").isNotNull())
    pca_scores(valid, FEATURES, 2).scores.write.mode("overwrite").parquet(dest("pca_scores"))
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="platelens", description=__doc__.splitlines()[0])
    ap.add_argument("--menu", required=True)
    ap.add_argument("--dictionary", required=True)
    ap.add_argument("--lexicon")
    ap.add_argument("--out", required=True)
    ap.add_argument("--restaurants", help="comma-separated list for the restaurant reports")
    ap.add_argument("--k", type=int, default=3)
    ap.add_argument("--method", choices=["mllib", "lloyd"], default="lloyd")
    ap.add_argument("--multiline", action="store_const", const="split", default=False,
                    help="the menu CSV has quoted line breaks")
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    names = [r.strip() for r in a.restaurants.split(",")] if a.restaurants else None
    for name, path in run(spark, a.menu, a.dictionary, a.out, a.lexicon, names, a.k, a.method, a.multiline).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
