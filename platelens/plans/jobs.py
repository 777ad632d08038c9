"""End-to-end jobs (load, translate, classify, export, reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import coerce_numeric
from ..functions.text import clean_item_name
from ..operators import reports
from ..operators.kmeans import classify
from ..operators.pca import pca_scores
from ..operators.translate import add_translation
from ..schema import FEATURES, MENU_COLUMNS, NULL_TOKENS, NUMERIC_COLUMNS, RAW_MENU_SCHEMA
from ..session import scratch_scope, scratch_written
from ..sources.csv_io import header_columns, read_csv_text, read_menu_csv, write_csv
from ..sources.keys import with_file_order_ids
from ..sources.tables import conform

MENU_NAMES = [n for n, _ in MENU_COLUMNS]


def complete_rows(raw: DataFrame, columns: list[str] = MENU_NAMES) -> DataFrame:
    """Keep rows whose menu cells are all present: not null and not a null
    token (a plain filter on the raw text, pushed into the scan)."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~F.col(c).isin(NULL_TOKENS)
    return raw.where(cond)


def clean_and_type(rows: DataFrame) -> DataFrame:
    """Clean names and type numbers of complete rows.

    Cleaning maps text to text, so dropping incomplete rows before it keeps
    the same rows as dropping after it. Typing comes last: a non-numeric cell
    is not null, so its row survives the drop and only becomes null when
    typed (it is then not clustered). Other columns are carried along.
    """
    x = rows.withColumn("item", clean_item_name("item"))
    return x.select(*[coerce_numeric(c).alias(c) if c in NUMERIC_COLUMNS else F.col(c)
                      for c in x.columns])


def kept_rows(spark: SparkSession, path: str, multiline: bool | str = False) -> DataFrame:
    """The CSV's rows that have a value in every column its header names."""
    names = header_columns(spark, path, RAW_MENU_SCHEMA, multiline)
    return complete_rows(read_menu_csv(spark, path, multiline, null_tokens=False), names)


def load_items(spark: SparkSession, path: str, kept: DataFrame | None = None,
               multiline: bool | str = False) -> DataFrame:
    """CSV file(s) -> typed menu table with ids 1..N in file order over the
    kept rows; item_gr and category are null, and so are columns that the CSV's
    header does not have.

    The CSV is parsed once: the kept rows are written with their places, and ids
    and the per-column work read those.
    """
    if kept is None:
        kept = kept_rows(spark, path, multiline)
    return conform(clean_and_type(with_file_order_ids(kept, "id")))


def load_menu_table(spark: SparkSession, path: str, table: str, mode: str = "append",
                    multiline: bool | str = False) -> int:
    """The whole load job: CSV -> clean -> drop incomplete rows -> ids ->
    write to ``table`` (created with the menu schema if absent). Returns the
    number of rows written.

    Ids go on after those of the table and of all other appends, also ones that
    run at the same time (``sources.tables.reserved_ids``). Overwriting starts
    them at 1 and must run alone.
    """
    from ..sources.tables import append_table, create_table, reserved_ids

    create_table(spark, table)
    with scratch_scope(spark):
        rows = with_file_order_ids(kept_rows(spark, path, multiline), "id")
        if mode != "append":
            rows = scratch_written(rows, "load")
            conform(clean_and_type(rows)).write.mode(mode).insertInto(table, overwrite=True)
            return rows.count()
        n = rows.count()
        with reserved_ids(spark, table, n) as first:
            append_table(clean_and_type(rows.withColumn("id", F.col("id") + F.lit(first - 1))), table)
        return n


def add_category(items: DataFrame, method: str = "lloyd", k: int = 3, **kw) -> DataFrame:
    return classify(items, FEATURES, k, method, **kw).assigned.drop("cluster")


def export_categories(items: DataFrame, path: str) -> None:
    write_csv(items.select("item", "item_gr", "category"), path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in ("item", "item_gr", "category")])
    return read_csv_text(spark, path, schema)


def browse_categories(spark: SparkSession, path: str, sort: list[tuple[str, str]],
                      limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of the exported table, with the table's row count."""
    t = read_categories(spark, path)
    total = t.select(F.count(F.lit(1))).scalar()
    return reports.browse(t, sort, limit, offset).withColumn("n_rows", total)


__all__ = ["clean_and_type", "load_items", "add_translation", "add_category", "export_categories",
           "read_categories", "browse_categories", "pca_scores", "reports"]
