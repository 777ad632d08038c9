"""Typed menu tables stored as parquet.

Several writers may append to one table at once. Ids: each reserves its range
first, in a log beside the table's files (folder ``_ids``, which readers skip):
entry number m holds the first id and the number of ids of the m-th append, and is
made by one atomic create, so of two writers that want the same entry one takes
the next. Files: each append is written in a folder of its own and its files then
renamed into the table, since two jobs that commit in one folder lose files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MENU_SCHEMA
from ..session import delete_path

ID_LOG = "_ids"


def create_table(spark: SparkSession, name: str, location: str | None = None,
                 schema=MENU_SCHEMA) -> None:
    """CREATE TABLE IF NOT EXISTS with the fixed menu schema (parquet)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")


def drop_table(spark: SparkSession, name: str) -> None:
    """DROP TABLE IF EXISTS (an absent table is not an error)."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def reset_table(spark: SparkSession, name: str, location: str | None = None,
                schema=MENU_SCHEMA) -> None:
    """Start from an empty table: drop, then create."""
    drop_table(spark, name)
    create_table(spark, name, location, schema)


def conform(df: DataFrame, schema=MENU_SCHEMA) -> DataFrame:
    """Select into table order by column name; missing columns become null,
    types are coerced with try_cast (never raises)."""
    types = dict(df.dtypes)
    cols = set(types)
    out = []
    for f in schema.fields:
        if f.name in cols:
            c = F.col(f.name)
            out.append((c if types[f.name] == f.dataType.simpleString()
                        else c.try_cast(f.dataType)).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = cols - {f.name for f in schema.fields}
    if extra:
        raise ValueError(f"columns not in the table: {sorted(extra)}")
    return df.select(*out)


def table_location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").select("data_type")
    return rows.first()[0].rstrip("/")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def _text_of(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with its whole text, unless it is there: True for exactly
    one of several callers. A file is written beside it and put in place by one
    atomic step: a hard link on a mounted folder (a rename would replace what is
    there), a rename elsewhere, which HDFS refuses where the target is there."""
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    if urlparse(path).scheme in ("", "file"):
        here, there = unquote(urlparse(part).path), unquote(urlparse(path).path)
        with open(here, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
    out = fs.create(_fs(spark, part)[1], False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.exists(target) and fs.rename(_fs(spark, part)[1], target):
        return True
    delete_path(spark, part)
    return False


@contextmanager
def reserved_ids(spark: SparkSession, name: str, n: int) -> Iterator[int]:
    """The first of ``n`` ids that no other writer of the table gets; they go on after
    all ids that are reserved or in the table. If the block fails and nobody has
    reserved since, the ids are given back; otherwise they stay unused."""
    folder = f"{table_location(spark, name)}/{ID_LOG}"
    while True:
        entries = [f for f in _listed(spark, folder) if f.isdigit()]
        last = 0
        if entries:
            start, count = map(int, _text_of(spark, f"{folder}/{entries[-1]}").split())
            last = start + count - 1
        in_table = spark.table(name).agg(F.max("id")).first()[0] or 0
        first = max(last, in_table) + 1
        number = int(entries[-1]) + 1 if entries else 1
        entry = f"{folder}/{number:020d}"
        if create_once(spark, entry, f"{first} {n}"):
            break
    try:
        yield first
    except BaseException:
        if [f for f in _listed(spark, folder) if f.isdigit()][-1] == f"{number:020d}":
            delete_path(spark, entry)
        raise


def append_table(df: DataFrame, name: str, schema=MENU_SCHEMA) -> None:
    """Append rows by column name. The rows are written apart first, so a job that
    fails adds none; then their files are renamed into the table."""
    spark = df.sparkSession
    location = table_location(spark, name)
    stage = f"{location}/_append-{uuid.uuid4().hex}"
    try:
        conform(df, schema).write.parquet(stage)
        for file in _listed(spark, stage):
            if not file.startswith(("_", ".")):
                fs, target = _fs(spark, f"{location}/{file}")
                if not fs.rename(_fs(spark, f"{stage}/{file}")[1], target):
                    raise OSError(f"could not move {file} into {location}")
    finally:
        delete_path(spark, stage)
    spark.catalog.refreshTable(name)
