"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every platelens job relies on. AQE re-plans joins from runtime sizes
# (a shuffled side that turns out small becomes a broadcast) and splits skewed
# shuffle partitions; both matter when one restaurant or item holds a large
# share of the rows.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Generated-code cache (static; default 100 classes). One report query
    # generates dozens of classes and every Lloyd step new ones, so the
    # default evicts and recompiles on each run.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(master: str | None = None, app: str = "platelens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the platelens defaults.

    ``master`` is only set when given, so a cluster submit keeps its own.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; that setting wins. Only a
    local-mode session without it (tests, laptops) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="platelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "tables", name)


#: Folders written inside a ``scratch_scope``; None outside of one.
_SCOPE: ContextVar[list[str] | None] = ContextVar("platelens_scratch", default=None)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What ``scratch_written`` writes inside the block goes when it ends, so nothing
    lazy that reads it may leave the block."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        for path in _SCOPE.get():
            delete_path(spark, path)
        _SCOPE.reset(token)


def scratch_folder(df: DataFrame, name: str) -> str:
    """Write ``df`` as parquet into a fresh folder under the shared one; its path."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return path


def scratch_written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet under the shared folder and read back: it is
    evaluated once, its rows keep their place, and lost executors do no harm."""
    return df.sparkSession.read.schema(df.schema).parquet(scratch_folder(df, name))


@contextmanager
def scratch_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``scratch_written`` in a scope of its own."""
    with scratch_scope(df.sparkSession):
        yield scratch_written(df, name)
