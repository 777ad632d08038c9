"""Importance resampling of documents towards a target text distribution.

Texts become bags of hashed n-grams. A bucket's gain is the log ratio of its
smoothed frequency in the target texts to that in all documents; a document
weighs the mean gain of its features, and documents are drawn without
replacement by adding Gumbel noise, a hash of the id, to the weight.

Features are found a batch of texts at a time: the texts are joined with
sentinels, one regex pass finds all words and sentinels, ``searchsorted`` in the
sentinels' places gives each word's document, and an n-gram whose ends lie in
different documents is masked before the counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import bounded_batches, written

MAX_N = 1                 # words of the longest n-gram
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 10                # percent of the eligible documents that are drawn
SEED = "2024"
#: A word: no ASCII but digits and lower-case letters, everything beyond ASCII; or the sentinel.
_TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
_SENTINEL = zlib.crc32(b"\0")


def features(texts: list[str | None], max_n: int = MAX_N, buckets: int = BUCKETS
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, their texts' numbers, words of each text).

    A text's features are all runs of 1 to ``max_n`` of its words, joined by one
    space; the bucket is their CRC-32 modulo ``buckets``. A null text has none.
    """
    n = len(texts)
    joined = "\0".join([(t or "").replace("\0", " ") for t in texts] + [""]).encode("utf-8", "surrogatepass").lower()
    tokens = _TOKEN.findall(joined)
    crc = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    at = np.flatnonzero(crc == _SENTINEL)           # a word may share the sentinel's CRC
    ends = np.array([i for i in at.tolist() if tokens[i] == b"\0"], np.int64)
    place = np.arange(len(tokens))
    doc = np.searchsorted(ends, place)
    word = np.ones(len(tokens), bool)
    word[ends] = False
    spaced, run = None, crc
    found, owner = [crc[word] % buckets], [doc[word]]
    for k in range(1, max_n):                       # the (k + 1)-grams that start at each place
        if spaced is None:
            spaced = [b" " + t for t in tokens]
        m = len(tokens) - k
        if m <= 0:
            break
        run = np.fromiter(map(zlib.crc32, spaced[k:], run[:m].tolist()), np.uint32, m)
        whole = word[:m] & (doc[:m] == doc[k:]) & word[k:]
        found.append(run[whole] % buckets)
        owner.append(doc[:m][whole])
    return (np.concatenate(found).astype(np.int64), np.concatenate(owner), np.bincount(doc[word], minlength=n)[:n])


def bucket_counts(docs: DataFrame, text_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket long, n long): features of all rows by bucket, empty buckets left
    out. A task sends at most ``buckets`` rows to the final sum."""
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(features(b.column(0).to_pylist(), max_n, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return (docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(of, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():                      # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text",
          max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths of a nat, rounded down, from counts
    over all rows of both tables (one is added to every bucket)."""
    s = _dense(bucket_counts(raw, text_col, max_n, buckets), buckets)
    t = _dense(bucket_counts(target, target_col, max_n, buckets), buckets)
    every_s, every_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * every_s / ((float(a) + 1) * every_t)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            max_n: int = MAX_N) -> DataFrame:
    """(_id, n_words, n_features, weight) of every row; weight is the mean gain of
    its features, rounded down, 0 without any."""
    bounded_batches(docs.sparkSession)
    buckets = len(gain)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owner, words = features(b.column(1).to_pylist(), max_n, buckets)
            many = np.bincount(owner, minlength=b.num_rows)[:b.num_rows]
            # sums of whole numbers below 2 ** 53 are exact in doubles
            total = np.bincount(owner, weights=gain[found], minlength=b.num_rows)[:b.num_rows].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words), pa.array(many), pa.array(total // np.maximum(many, 1))],
                names=["_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        of, f"_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: str = SEED):
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of ``seed:id``
    (a null id is the empty text)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              target_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS,
              min_words: int = MIN_WORDS, share: int = SHARE, seed: str = SEED) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank, n_words.

    Of the rows with at least ``min_words`` words, ``share`` percent (rounded down)
    with the highest scores are drawn, ties to the smaller id (null ids last);
    rank numbers them from 1 and is null for all others. Null and empty texts have
    no features, weight 0 and are never drawn unless ``min_words`` is 0; an empty
    target makes every gain the same function of the documents' own counts.
    Repeated rows are drawn each; other columns are not read; no rows give no rows.
    """
    gain = gains(docs, target, text_col, target_col, max_n, buckets)
    rows = written(weighed(docs, gain, id_col, text_col, max_n)
                   .withColumn("score", F.col("weight") + noise("_id", seed)), "resampling")
    fit = rows.where(F.col("n_words") >= min_words)
    drawn = fit.count() * share // 100
    # rows that agree in score and id stay apart by their place, so no range is bound to one task
    placed = fit.withColumn("_place", F.monotonically_increasing_id())
    ranked = global_rank(placed, [F.desc("score"), F.asc_nulls_last("_id"), F.asc("_place")], "rank")
    out = (ranked.drop("_place").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
           .unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))))
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")
