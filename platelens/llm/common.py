"""Helpers shared by the text operators: scratch tables, Arrow text batches,
bounded labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words everywhere in this subpackage: maximal runs without space, tab, LF, VT, FF, CR.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that Spark packs into one Arrow batch for a Python task. Texts
#: may be very long, so batches are small; a single row is never cut.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python tasks (memory of long texts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def wide_batches(spark: SparkSession) -> None:
    """Larger Arrow batches, for narrow numeric rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, fixes row ids, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    arr = col.fill_null("").cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into consecutive [a, b) of at most ``most`` total size each
    (a larger single row stands alone)."""
    a, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > a and total + s > most:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int,
                    per_class: int, max_bytes: int, id_col: str = "doc_id",
                    text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) training rows of each class.

    Rows whose crc32(id as text) mod ``fold`` equals ``held`` are never taken,
    nor texts over ``max_bytes`` bytes, so the driver gets at most
    2 * per_class * max_bytes bytes whatever the input. Which rows are taken
    depends only on a hash of their id. Null ids or labels are left out;
    repeated label rows count once (largest label).
    """
    lab = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_y"))
           .where(F.crc32(F.col("_id").cast("string")) % fold != held))
    picks = None
    for y in (0, 1):
        part = lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picks = part if picks is None else picks.unionByName(part)
    texts = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
             .where(F.octet_length("_text") <= max_bytes))
    rows = (texts.join(F.broadcast(picks), "_id")   # at most 2 * per_class ids
            .orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(2 * per_class)
            .select("_text", "_y").collect())
    return [(r[0], r[1]) for r in rows]


def text_sha(text_col: str):
    """SHA-256 (hex) of a text column, null as empty."""
    return F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)


def rows_named(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (_k_id, _k_sha, _k_n) name by id and text
    digest, one row per key, same columns.

    _k_n is how many rows of ``docs`` have that key. Where it is over 1 the rows
    agree in id and text, and the one whose other columns hash lowest stays.
    """
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{id_col}`").alias("_r_id"), text_sha(text_col).alias("_r_sha"))
    found = mine.join(keys, (F.col("_r_sha") == F.col("_k_sha")) & F.col("_r_id").eqNullSafe(F.col("_k_id")))
    many = (found.where("_k_n > 1").groupBy("_r_id", "_r_sha")
            .agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")))
    return found.where("_k_n = 1").select("_row.*").unionByName(many.select("_row.*"))
