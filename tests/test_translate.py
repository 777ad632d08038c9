"""Dictionary lookup + word fallback (J1-J4, S2, C6, C7)."""

import os

from platelens.operators.joins import write_back
from platelens.operators.translate import add_translation, dedupe_lookup
from platelens.sources import csv_io


def _items(spark, names):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "id long, item string")


def test_lookup_and_fallback(spark):
    items = _items(spark, ["Big Mac", "Big Mac", "Fries", "Hot Dog", "", "cold hot dog", "Spicy®"])
    lookup = spark.createDataFrame(
        [(1, "Big Mac", "old"), (2, "Big Mac", "Μπιγκ Μακ"), (3, "Fries", None), (4, "Spicy®", "x")],
        "pos long, item string, item_gr string")
    lexicon = spark.createDataFrame([("Hot", "Ζεστό"), ("Dog", "Σκύλος"), ("dog", "σκύλος")],
                                    "word string, word_tr string")
    out = add_translation(items, lookup, lexicon)
    got = sorted((r.id, r.item_gr) for r in out.collect())
    assert got == [(1, "Μπιγκ Μακ"), (2, "Μπιγκ Μακ"),   # last row wins
                   (3, None),                           # hit with null value stays null
                   (4, "Ζεστό Σκύλος"),                 # word by word, order kept
                   (5, ""),                             # no words -> ''
                   (6, "cold hot σκύλος"),              # case-sensitive, misses kept
                   (7, "x")]                            # raw key matches the raw item
    assert out.count() == items.count()


def test_lookup_csv_last_row_wins(spark, tmp_dir):
    p = os.path.join(tmp_dir, "dict")
    os.makedirs(p)
    with open(os.path.join(p, "d.csv"), "w", encoding="utf-8") as f:
        f.write('item,item_gr\nA,first\nB,\nA,second\n"6"" Sub",έξι\n')
    d = dedupe_lookup(csv_io.read_lookup_csv(spark, p))
    got = sorted((r.item, r.item_gr) for r in d.collect())
    assert got == [('6" Sub', "έξι"), ("A", "second"), ("B", None)]


def test_write_back(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, item string, item_gr string")
    upd = spark.createDataFrame([(1, "X"), (3, None)], "id long, item_gr string")
    got = sorted(tuple(r) for r in write_back(base, upd, "id", ["item_gr"]).collect())
    assert got == [(1, "a", "X"), (2, "b", "y"), (3, "c", None)]


def test_word_translator_function(spark):
    items = _items(spark, ["Big Mac", "hot dog", "hot  hot", ""])
    lookup = spark.createDataFrame([(1, "Big Mac", "Μπιγκ Μακ")], "pos long, item string, item_gr string")
    out = add_translation(items, lookup, translate_word=lambda s: s.str.upper())
    got = sorted((r.id, r.item_gr) for r in out.collect())
    assert got == [(1, "Μπιγκ Μακ"), (2, "HOT DOG"), (3, "HOT HOT"), (4, "")]
