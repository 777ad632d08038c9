"""Name cleaning: golden pairs (FIXTURES.md) and properties."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platelens.functions.text import clean_item_name, split_words, strip_ws
from platelens.schema import WS_CHARS

GOLDEN = [
    ("Chicken Sandwich®", "Chicken Sandwich"),
    ('"Chicken"', "Chicken"),
    ('6" Sandwich', '6" Sandwich'),
    ("Spicy Chicken® Sandwich *", "Spicy Chicken Sandwich"),
    ('"6"', '6"'),
    ('"', ""),
    ('""', ""),
    ('Sub 12"', 'Sub 12"'),
    ('Chicken"®', 'Chicken"'),
    (' "Chicken"', '"Chicken'),
    ('6""', '6"'),
    ("A,B ,  C", "AB C"),
    ("*", ""),
    ("a b", "a b"),
    ("x\u001cy", "x y"),
    ('٣"', '٣"'),
    ('6"®', '6"'),
    ('"Foo" ', "Foo"),
    ('Foo" ', 'Foo"'),
    ('""Foo""', '"Foo"'),
]





def _run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn("s")).collect()]


def test_golden_pairs(spark):
    got = _run(spark, [a for a, _ in GOLDEN], clean_item_name)
    assert got == [b for _, b in GOLDEN]


def test_null_stays_null(spark):
    assert _run(spark, [None], clean_item_name) == [None]


def test_whitespace_set_is_complete():
    # The class covers exactly the characters Python's str.isspace() accepts.
    assert len(WS_CHARS) == 29
    assert all(c.isspace() for c in WS_CHARS)
    assert sum(1 for c in map(chr, range(0x3001)) if c.isspace()) == 29


def test_strip_and_collapse_all_whitespace(spark):
    s = WS_CHARS + "a" + WS_CHARS + "b" + WS_CHARS
    assert _run(spark, [s], strip_ws)[0].startswith("a")


def test_split_words(spark):
    df = spark.createDataFrame([(" a  b　c ",), ("",), ("   ",)], "s string")
    got = [r[0] for r in df.select(split_words("s")).collect()]
    assert got == [["a", "b", "c"], [], []]


def test_not_idempotent(spark):
    once = _run(spark, ['""Foo""'], clean_item_name)[0]
    twice = _run(spark, [once], clean_item_name)[0]
    assert (once, twice) == ('"Foo"', "Foo")


alphabet = st.sampled_from(list('ab6 ",*® \t　٣x'))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=12), min_size=1, max_size=20))
def test_properties(spark, values):
    got = _run(spark, values, clean_item_name)
    for v in got:
        assert not re.search("[®*,]", v)
        assert "  " not in v
        assert v == v.strip(WS_CHARS)
        assert not any(c in v for c in WS_CHARS if c != " ")
