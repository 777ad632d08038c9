"""Incremental CSV ingest with Structured Streaming."""

import os

from platelens.schema import MENU_COLUMNS
from platelens.streaming import start_menu_ingest


def _csv(rows):
    header = ",".join(n for n, _ in MENU_COLUMNS)
    return header + "\n" + "\n".join(rows) + "\n"


def _row(item, cal="10"):
    return ",".join(["R", item, cal] + ["1"] * 13 + ["No"])


def test_ingest_two_drops(spark, tmp_dir):
    src, dst = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(_csv([_row('"Burger®"'), _row("None"), _row("Fries *", "NA")]))
    q = start_menu_ingest(spark, src, dst, name="ingest_test_a")
    q.awaitTermination(120)
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write(_csv([_row('"Shake, Large"', "7.5")]))
    q = start_menu_ingest(spark, src, dst, name="ingest_test_a")   # same checkpoint: only the new file
    q.awaitTermination(120)
    got = sorted((r.item, r.calories) for r in spark.read.parquet(dst).collect())
    assert got == [("Burger", 10.0), ("Shake Large", 7.5)]
    assert spark.read.parquet(dst).select("id").distinct().count() == 2
