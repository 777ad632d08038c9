"""From raw documents to packed training batches, in five stages.

Each stage takes the documents its predecessor kept (read back from Parquet) and
the folder of the input tables; all but the last return the columns of
documents. Between stages the rows are written to the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.llm import exact_dedup, packing, pieces, quality, secret_scan, simhash
from platelens.llm.common import table, written
from platelens.llm.queries import PIECE_MODEL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, accepts."""
    return quality.accepted(docs, quality.fit_tables(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (3-word shingles, 3 bits)."""
    return simhash.one_of_each(docs, shingle=3, max_distance=3)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew (null
    texts keep theirs)."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of all documents in token-budget batches, each with its token ids."""
    return packing.pack(pieces.encode(docs, PIECE_MODEL), F.col("n_tokens"), ids=F.col("ids"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("simhash", near_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]

#: The stages learn weights, hash shingles and lex sources: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
