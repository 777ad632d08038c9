"""CSV sources and sinks.

Reading: header row, comma separator, ``"`` quotes with doubled-quote escape
(``"6"" Sub"`` -> ``6" Sub``). Columns are matched by the header's names, in any
order: the first file's header line gives the order (every other file must have
the same header, which Spark checks), a column that the header lacks is null, and
one that the table does not have is an error. Every field is read as text (no
inference), then the null tokens of ``schema.NULL_TOKENS`` become null. A row
with too few fields has nulls at its end; one with too many is an error.
``multiline`` is off by default: a quoted line break is an error then where it
leaves a quote open. ``multiline="split"`` reads them in splits of large files
(``sources.csv_records``); ``multiline=True`` is Spark's own reader, one task
per file, which also takes quotes inside unquoted fields.

Writing: header, quotes doubled, padding kept, null and '' both written as an
empty field. The output is a folder of part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.nulls import null_tokens_to_null
from ..schema import LOOKUP_SCHEMA, RAW_MENU_SCHEMA
from .csv_records import read_records
from .keys import FILE_COLS, tag_file_position, with_file_order_ids

READ_OPTIONS = {"header": "true", "sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
                "enforceSchema": "false", "columnNameOfCorruptRecord": "_bad", "columnPruning": "false"}
WRITE_OPTIONS = {"header": "true", "sep": ",", "quote": '"', "escape": '"',
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                 "emptyValue": "", "nullValue": ""}


def header_columns(spark: SparkSession, path: str, schema: T.StructType,
                   multiline: bool | str = False) -> list[str]:
    """Column names of the (first) file's header line; raises for names that
    ``schema`` does not have and for repeated ones. Reads one line."""
    names = (spark.read.options(**READ_OPTIONS).option("multiLine", str(multiline is True).lower())
             .csv(path).columns)
    names = [n for n in names if n != "_bad"]
    unknown = sorted(set(names) - set(schema.fieldNames()))
    if unknown:
        raise ValueError(f"columns not in the table: {unknown}")
    return names


def checked_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the ``_bad`` column of malformed lines: a line of too many
    fields, or one that ends inside a quote, is an error; a short line stays."""
    bare = F.regexp_replace("_bad", r'"(?:[^"]|"")*"', "")
    wide = (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(names)) | bare.contains('"')
    fine = F.when(F.col("_bad").isNull() | ~wide, True).otherwise(
        # names a column of the file too: Spark refuses scans of the malformed lines alone
        F.raise_error(F.concat(F.lit("malformed CSV line: "), F.col("_bad"), F.lit(" at "),
                               F.coalesce(names[0], F.lit("")))).cast("boolean"))
    return df.where(fine).drop("_bad")


def _split_records(spark: SparkSession, path: str, text_schema: T.StructType, names: list[str]) -> DataFrame:
    """The fields of ``read_records`` under ``text_schema``, each file's header checked and left out."""
    rows = read_records(spark, path)
    header = (F.col("_file_block") == 0) & (F.col("_file_pos") == 0)
    fits = F.replace(F.col("text"), F.lit('"'), F.lit("")) == ",".join(names)
    kept = rows.where(F.when(~header, True).when(fits, False).otherwise(F.raise_error(F.concat(
        F.lit("another header in "), F.col("_file_path"))).cast("boolean")))
    options = {k: v for k, v in READ_OPTIONS.items() if k in ("sep", "quote", "escape", "mode", "columnNameOfCorruptRecord")}
    fields = F.from_csv("text", text_schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {**options, "multiLine": "true"})
    return kept.select(fields.alias("_f"), *FILE_COLS, "_file_pos").select("_f.*", *FILE_COLS, "_file_pos")


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType,
                  multiline: bool | str = False, tag_position: bool = False,
                  null_tokens: bool = True) -> DataFrame:
    """Scan CSV as text columns of ``schema`` and apply the null tokens.

    ``tag_position`` adds the file place needed for file-order ids (see
    ``sources.keys``).
    """
    names = header_columns(spark, path, schema, multiline)
    text_schema = T.StructType([T.StructField(n, T.StringType(), True) for n in [*names, "_bad"]])
    if multiline == "split":
        df = _split_records(spark, path, text_schema, names)
        df = df if tag_position else df.drop(*FILE_COLS, "_file_pos")
    else:
        df = (spark.read.schema(text_schema).options(**READ_OPTIONS)
              .option("multiLine", str(multiline is True).lower()).csv(path))
        df = tag_file_position(df) if tag_position else df
    df = checked_rows(df, names)
    tags = [c for c in df.columns if c not in names]
    df = df.select(*[F.col(f.name) if f.name in names else F.lit(None).cast("string").alias(f.name)
                     for f in schema.fields], *tags)
    return null_tokens_to_null(df, names) if null_tokens else df


def read_menu_csv(spark: SparkSession, path: str, multiline: bool | str = False,
                  null_tokens: bool = True) -> DataFrame:
    """Raw menu rows (all text, file position tagged; null tokens made null
    unless ``null_tokens`` is False)."""
    return read_csv_text(spark, path, RAW_MENU_SCHEMA, multiline, tag_position=True,
                         null_tokens=null_tokens)


def read_lookup_csv(spark: SparkSession, path: str, multiline: bool | str = False) -> DataFrame:
    """Translation dictionary (item, item_gr) with ``pos`` = file row order,
    so a repeated key can be resolved as "last row wins"."""
    df = read_csv_text(spark, path, LOOKUP_SCHEMA, multiline, tag_position=True)
    return with_file_order_ids(df, "pos")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as CSV (see module docstring for the format)."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)
