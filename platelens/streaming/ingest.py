"""Structured Streaming version of the chunked load.

New CSV files in ``source_dir`` are read as they arrive (bounded by
``max_files_per_trigger``), cleaned and null-dropped exactly as the batch
load does, typed, and written under ``target_dir/batch_id=<n>``. Each
micro-batch overwrites its own folder, so a batch that is retried after a
failure replaces its first attempt instead of adding duplicates; progress is
kept in a checkpoint under the shared ``spark.checkpoint.dir``, so a
restarted query neither loses nor repeats a file. Reading ``target_dir``
gives every row plus its ``batch_id``. There is no event time and no state:
each micro-batch is independent, like one chunk of the batch load.

Ids: a stream has no global file order, so an id is ``batch_id`` times 2^63 plus
the row's ``monotonically_increasing_id`` in its micro-batch, as a 38-digit
decimal: unique and increasing without ever wrapping, not dense. Use the batch
loader for dense 1..N ids.

The files' headers must name the menu's columns in table order; another header
is an error, as is a row of too many fields.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW_MENU_SCHEMA
from ..session import ensure_checkpoint_dir
from ..sources.csv_io import READ_OPTIONS, checked_rows


def start_menu_ingest(spark: SparkSession, source_dir: str, target_dir: str,
                      name: str = "menu_ingest", max_files_per_trigger: int = 16,
                      available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``."""
    from ..plans.jobs import clean_and_type, complete_rows   # plans depends on sources

    ckpt = os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "streams", name)
    schema = T.StructType([*RAW_MENU_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    raw = (spark.readStream.schema(schema).options(**READ_OPTIONS)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        typed = clean_and_type(complete_rows(checked_rows(batch, RAW_MENU_SCHEMA.names)))
        first = F.lit(str(batch_id << 63)).cast("decimal(38,0)")
        typed = typed.withColumn("id", (first + F.monotonically_increasing_id()).cast("decimal(38,0)"))
        typed.write.mode("overwrite").parquet(os.path.join(target_dir, f"batch_id={batch_id}"))

    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.queryName(name).start()
