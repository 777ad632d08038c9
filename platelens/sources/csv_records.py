"""Records of CSV files with quoted line breaks, read in splits.

Spark's own reader for such files takes each file in one task. Here every split
reads its physical lines. Quotes come in pairs outside and inside fields (a quote
in a field is doubled), so a line starts a record if the number of quotes before
it in the file is even:

1. the quotes of every split are counted; their sum over the earlier splits
   of the file tells whether a split begins inside quotes;
2. each split joins its lines to records; what lies before its first record, and a
   record it does not end, are pieces;
3. pieces are few, two per split at most: they are put together by file.

A quote inside an unquoted field breaks the pairing and is an error here, as
is a quote that is open at a file's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_written
from .keys import FILE_COLS, tag_file_position

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
#: A record whose quotes stand round fields only.
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+", re.S)
_WHOLE, _HEAD, _OPEN = 0, 1, 2        # a record, lines before a split's first record, a record that goes on
_OUT = "_file_dir string, _file_part long, _file_path string, _file_block long, _file_pos long, kind int, text string"
_BATCH = 4 << 20


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (place columns, open, value), whole splits in order, as records and pieces."""
    names = [f.split()[0] for f in _OUT.split(",")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    out, size = [], 0
    place, held, kind, pos = None, [], _WHOLE, 0    # the split, its unfinished lines, what they are, records so far

    def closed(what: int) -> None:
        nonlocal held, pos, size
        text = "\n".join(held)
        held = []
        if what == _WHOLE:
            text = text.removesuffix("\r")
            if not text.strip():
                return
            if '"' in text and not _RECORD.fullmatch(text):
                raise ValueError(f"malformed CSV record in {place[2]}: {text[:200]}")
        out.append((*place, pos if what != _HEAD else -1, what, text))
        size += len(text)
        pos += what != _HEAD

    def flushed() -> pa.RecordBatch:
        nonlocal out, size
        cols = zip(*out) if out else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        out, size = [], 0
        return batch

    for b in batches:
        for *at, starts_open, line in zip(*[b.column(i).to_pylist() for i in range(6)]):
            at = tuple(at)
            if at != place:
                if held:
                    closed(_OPEN if kind != _HEAD else _HEAD)
                place, pos = at, 0
                kind, inside = (_HEAD, True) if starts_open else (_WHOLE, False)
            if at[3] == 0 and not held and pos == 0:
                line = line.removeprefix("\ufeff")
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                closed(kind)
                kind = _WHOLE
            if size > _BATCH:
                yield flushed()
    if held:
        closed(_OPEN if kind != _HEAD else _HEAD)
    yield flushed()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(place columns, _file_pos, text): every record of the CSV file(s), header
    records too, blank ones left out; _file_pos counts a split's records from 0."""
    lines = tag_file_position(spark.read.option("lineSep", "\n").text(path))
    lines = lines.select(*FILE_COLS, F.monotonically_increasing_id().alias("_mid"), "value")
    odd = F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2
    splits = lines.groupBy(*FILE_COLS).agg(odd.alias("odd"))
    file = Window.partitionBy("_file_path")
    before = F.sum("odd").over(file.orderBy("_file_block").rowsBetween(Window.unboundedPreceding, -1))
    open_end = F.when(F.sum("odd").over(file) % 2 == 1,
                      F.raise_error(F.concat(F.lit("malformed CSV: open quote at the end of "), F.col("_file_path"))))
    # written, so that the planner knows how small it is
    splits = scratch_written(splits.select(
        F.col("_file_path").alias("_p"), F.col("_file_block").alias("_b"),
        F.coalesce(open_end.cast("boolean"), F.coalesce(before % 2 == 1, F.lit(False))).alias("open")), "splits")
    # either way of joining keeps a split in one task; the sort restores its order
    dealt = (lines.join(splits, (F.col("_file_path") == F.col("_p")) & (F.col("_file_block") == F.col("_b")))
             .sortWithinPartitions("_file_path", "_file_block", "_mid").select(*FILE_COLS, "open", "value"))
    rows = scratch_written(dealt.mapInArrow(_assembled, _OUT), "records")
    # pieces in file order: an open record takes the pieces up to and with the next head that ends it
    order = Window.partitionBy("_file_path").orderBy("_file_block", "_file_pos")
    pieces = rows.where(F.col("kind") != _WHOLE).withColumn("record", F.sum(
        F.when(F.col("kind") == _OPEN, 1).otherwise(0)).over(order))
    joined = (pieces.groupBy("_file_path", "record").agg(
        F.min(F.struct("_file_block", F.when(F.col("kind") == _OPEN, 0).otherwise(1).alias("k"), "_file_pos", "_file_dir",
                       "_file_part")).alias("first"),
        F.sort_array(F.collect_list(F.struct("_file_block", "text"))).alias("parts"))
        .select("first._file_dir", "first._file_part", "_file_path", "first._file_block", "first._file_pos",
                F.regexp_replace(F.array_join(F.expr("parts.text"), "\n"), "\r\\z", "").alias("text")))
    good = F.when(F.regexp_like("text", F.lit(f"(?s)\\A{_FIELD}(?:,{_FIELD})*+\\z")), F.col("text")).otherwise(
        F.raise_error(F.concat(F.lit("malformed CSV record in "), F.col("_file_path"), F.lit(": "), F.substring("text", 1, 200))))
    cols = [*FILE_COLS, "_file_pos"]
    return rows.where(F.col("kind") == _WHOLE).select(*cols, "text").unionByName(joined.select(*cols, good.alias("text")))
