"""CSV scan, null drop, typing, file-order ids, table DDL (S1-S10, P6-P8)."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelens.operators.nulls import coerce_features, drop_nulls, null_tokens_to_null
from platelens.plans.jobs import load_items
from platelens.schema import MENU_COLUMNS, MENU_SCHEMA, NULL_TOKENS
from platelens.sources import csv_io, tables


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_drop_nulls_fixture(spark):
    df = spark.createDataFrame([("Chicken Sandwich", 500.0), (None, 600.0), ("Burger", None)],
                               "item string, calories double")
    out = drop_nulls(df).collect()
    assert [tuple(r) for r in out] == [("Chicken Sandwich", 500.0)]


def test_drop_nulls_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "item string, calories double")
    assert [r.item for r in drop_nulls(df).collect()] == ["b"]


def test_csv_edge_rows(spark, tmp_dir):
    p = os.path.join(tmp_dir, "edge", "x.csv")
    _write(p, 'restaurant,item,calories\nSubway,"6"" Sub",100\nSonic,"A, B",NA\nX,None,5\n')
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("restaurant", "item", "calories")])
    rows = [tuple(r) for r in csv_io.read_csv_text(spark, os.path.dirname(p), schema).collect()]
    assert rows == [("Subway", '6" Sub', "100"), ("Sonic", "A, B", None), ("X", None, "5")]


def test_minimal_csv_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "abc", "x.csv")
    _write(p, "item\nA\nB\nC\n")
    schema = T.StructType([T.StructField("item", T.StringType())])
    assert csv_io.read_csv_text(spark, os.path.dirname(p), schema).count() == 3


def test_null_tokens(spark):
    df = spark.createDataFrame([(t,) for t in NULL_TOKENS] + [("None ",), ("x",)], "s string")
    out = [r.s for r in null_tokens_to_null(df).collect()]
    assert out == [None] * len(NULL_TOKENS) + ["None ", "x"]


def test_coerce(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("1d",), ("1f",), ("abc",), ("Infinity",), ("1e3",),
                                (".5",), ("-3",), (None,)], "x string")
    out = [r.x for r in coerce_features(df, ["x"]).collect()]
    assert out == [1.0, 2.5, None, None, None, None, 1000.0, 0.5, -3.0, None]


def _menu_csv(rows):
    header = ",".join(n for n, _ in MENU_COLUMNS)
    body = "\n".join(",".join(r) for r in rows)
    return header + "\n" + body + "\n"


def _row(rest, item, cal="100", calcium="5"):
    vals = [rest, item, cal] + ["1"] * 12 + [calcium, "No"]
    vals[15] = calcium
    return vals


def test_load_items_end_to_end(spark, tmp_dir):
    d = os.path.join(tmp_dir, "menu")
    _write(os.path.join(d, "part-00000.csv"), _menu_csv([
        _row("Subway", '"6"" Sub®"'),
        _row("Sonic", "None"),                 # null token -> dropped
        _row("Sonic", "Tots *", cal="7.5"),    # fraction kept
        _row("Arbys", "Melt", calcium="trace"),  # kept, calcium null
    ]))
    _write(os.path.join(d, "part-00001.csv"), _menu_csv([
        _row("Arbys", "Roast, Beef", cal="NA"),  # dropped
        _row("Arbys", "  Curly   Fries  "),
    ]))
    df = load_items(spark, d)
    assert df.schema == MENU_SCHEMA or [f.name for f in df.schema] == [f.name for f in MENU_SCHEMA]
    rows = sorted((r.id, r.restaurant, r.item, r.calories, r.calcium) for r in df.collect())
    assert rows == [(1, "Subway", '6" Sub', 100.0, 5.0), (2, "Sonic", "Tots", 7.5, 5.0),
                    (3, "Arbys", "Melt", 100.0, None), (4, "Arbys", "Curly Fries", 100.0, 5.0)]


def test_csv_export_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([('6" Sub', None, "Main"), ("  pad ", "", "Side"), ('a,"b"', "x", None)],
                               "item string, item_gr string, category string")
    p = os.path.join(tmp_dir, "export")
    csv_io.write_csv(df, p)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("item", "item_gr", "category")])
    back = sorted(tuple(r) for r in csv_io.read_csv_text(spark, p, schema).collect())
    # null and '' both come back as null (an empty field is a null token)
    assert back == sorted([('6" Sub', None, "Main"), ("  pad ", None, "Side"), ('a,"b"', "x", None)])


def test_table_ddl_reset_append(spark, tmp_dir):
    name = "menu_test_tbl"
    loc = os.path.join(tmp_dir, "tbl")
    tables.reset_table(spark, name, loc)
    tables.create_table(spark, name, loc)          # idempotent
    assert spark.table(name).count() == 0
    df = spark.createDataFrame([(1, "A", "x", 10.0)], "id long, restaurant string, item string, calories double")
    tables.append_table(df, name)
    tables.append_table(df, name)
    assert spark.table(name).count() == 2
    assert spark.table(name).where(F.col("category").isNull()).count() == 2
    tables.drop_table(spark, name)
    tables.drop_table(spark, name)                 # absent: no error


def test_file_order_ids_across_many_splits(spark, tmp_dir):
    """Dense ids in file order when every file is cut into many splits and
    several files are packed per partition."""
    from platelens.sources.keys import tag_file_position, with_file_order_ids
    d = os.path.join(tmp_dir, "split")
    n = 0
    for f in range(3):
        lines = ["k,v"] + [f"{f:02d}-{i:05d},{'x' * (i % 7)}" for i in range(1500)]
        n += 1500
        _write(os.path.join(d, f"part-{f:05d}.csv"), "\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        raw = tag_file_position(spark.read.schema(schema).option("header", "true").csv(d))
        assert raw.rdd.getNumPartitions() > 10
        kept = raw.where(~F.col("k").endswith("3"))          # ids over kept rows only
        got = [r.k for r in with_file_order_ids(kept).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"{f:02d}-{i:05d}" for f in range(3) for i in range(1500) if not f"{i:05d}".endswith("3")]
    assert got == want


def test_load_menu_table_appends_with_continuing_ids(spark, tmp_dir):
    from platelens.plans.jobs import load_menu_table
    d = os.path.join(tmp_dir, "menu2")
    _write(os.path.join(d, "part-00000.csv"), _menu_csv([
        _row("A", "x"), _row("A", "NA"), _row("B", "y *"), _row("C", "z")]))
    name = "menu_load_tbl"
    tables.drop_table(spark, name)
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in MENU_SCHEMA.fields)}) "
              f"USING parquet LOCATION '{os.path.join(tmp_dir, 'tbl2')}'")
    assert load_menu_table(spark, d, name) == 3
    assert load_menu_table(spark, d, name) == 3
    rows = sorted((r.id, r.item) for r in spark.table(name).collect())
    assert rows == [(1, "x"), (2, "y"), (3, "z"), (4, "x"), (5, "y"), (6, "z")]
    tables.drop_table(spark, name)


def _by_name(order, **values):
    return ",".join(str(values.get(c, "x" if c in ("restaurant", "item", "salad") else 1)) for c in order)


NAMES = [n for n, _ in MENU_COLUMNS]


def test_columns_are_matched_by_header_name(spark, tmp_dir):
    order = [c for c in reversed(NAMES) if c != "vit_a"]
    p = os.path.join(tmp_dir, "named", "x.csv")
    _write(p, "\n".join([",".join(order), _by_name(order, item="A", calories=900, sugar=3),
                         _by_name(order, item="NA"), _by_name(order, item="B", vit_c="")]) + "\n")
    rows = load_items(spark, p).collect()
    assert [(r.id, r.item, r.calories, r.sugar, r.vit_a) for r in rows] == [(1, "A", 900.0, 3.0, None)]


def test_unknown_column_wide_row_and_open_quote_are_errors(spark, tmp_dir):
    import pytest
    cases = {"unknown": [",".join(NAMES) + ",zzz", _by_name(NAMES) + ",9"],
             "wide": [",".join(NAMES), _by_name(NAMES), _by_name(NAMES) + ",9"],
             "open": [",".join(NAMES), _by_name(NAMES, item='"A\nB"')]}
    for name, lines in cases.items():
        p = os.path.join(tmp_dir, name, "x.csv")
        _write(p, "\n".join(lines) + "\n")
        with pytest.raises(Exception, match="not in the table|malformed CSV line"):
            load_items(spark, p).collect()


def test_quoted_line_break_short_row_and_other_header(spark, tmp_dir):
    import pytest
    p = os.path.join(tmp_dir, "lines", "x.csv")
    _write(p, "\n".join([",".join(NAMES), _by_name(NAMES, item='"A\nB, C"'), _by_name(NAMES, item="D"),
                         _by_name(NAMES, item="short").rsplit(",", 1)[0]]) + "\n")
    assert sorted(r.item for r in load_items(spark, p, multiline=True).collect()) == ["A B C", "D"]
    for name, order in (("a", NAMES), ("b", NAMES[1:] + NAMES[:1])):
        _write(os.path.join(tmp_dir, "two", name + ".csv"), ",".join(order) + "\n" + _by_name(order) + "\n")
    with pytest.raises(Exception):
        load_items(spark, os.path.join(tmp_dir, "two")).collect()


def test_file_order_past_99999_parts(spark, tmp_dir):
    from platelens.sources.keys import tag_file_position, with_file_order_ids
    for n, items in (("part-100000-x.csv", "c\nd\n"), ("part-99999-x.csv", "a\nb\n")):
        _write(os.path.join(tmp_dir, "parts", n), items)
    df = spark.read.schema("item string").csv(os.path.join(tmp_dir, "parts"))
    got = sorted((r.id, r.item) for r in with_file_order_ids(tag_file_position(df)).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_numbers_beyond_double_are_null_and_labels_are_plain(spark):
    from platelens.functions.text import number_text
    df = spark.createDataFrame([("1e400",), ("-1e400",), ("1e300",)], "x string")
    assert [r.x for r in coerce_features(df, ["x"]).collect()] == [None, None, 1e300]
    df = spark.createDataFrame([(12345678.5,), (0.0005,), (1210.0,), (900.1,), (-0.00025,), (None,), (1e22,), (9.9e18,),
                                (1e20,), (-3e19,), (float("inf"),), (float("nan"),), (0.0,), (1e40,)], "x double")
    assert [r.t for r in df.select(number_text("x").alias("t")).collect()] == [
        "12345678.5", "0.0005", "1210", "900.1", "-0.00025", None, "1" + "0" * 22, "9900000000000000000",
        "1" + "0" * 20, "-30000000000000000000", "Infinity", "NaN", "0", "1" + "0" * 40]


def _plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_the_rows_of_a_load_are_parsed_once(spark, tmp_dir):
    p = os.path.join(tmp_dir, "once", "x.csv")
    _write(p, _menu_csv([_row("A", "x"), _row("B", "y")]))
    text = _plan(load_items(spark, p))
    assert "Scan csv" not in text and "Scan parquet" in text     # the CSV went into the numbered rows


def _ragged_csv(n, seed, end):
    """Lines of every kind: quoted line breaks of both kinds, doubled quotes, blank lines."""
    import random
    r = random.Random(seed)
    out = [",".join(NAMES)]
    for i in range(n):
        words = [r.choice(["a", 'say ""hi""', "x,y", "l1\nl2", "m\r\n\nn", "", " pad "]) for _ in range(r.randint(0, 6))]
        item = '"' + " ".join([f"i{i}", *words]) + '"' if r.random() < .7 else f"plain{i}"
        out.append(_by_name(NAMES, item=item, restaurant=r.choice(["R", '"Q, ""q"""'])))
        if r.random() < .1:
            out.append(r.choice(["", "  "]))
    return end.join(out) + r.choice(["", end])


def test_quoted_line_breaks_in_splits_equal_the_whole_file_reader(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ragged")
    for f in range(2):
        with open(os.path.join(_made(d), f"part-{f:05d}.csv"), "w", newline="", encoding="utf-8") as out:
            out.write(("\ufeff" if f else "") + _ragged_csv(400, f, "\r\n" if f else "\n"))
    # one record longer than several splits
    with open(os.path.join(d, "part-00002.csv"), "w", newline="") as out:
        out.write(",".join(NAMES) + "\n" + _by_name(NAMES, item='"' + "long\n" * 3000 + '"') + "\n" + _by_name(NAMES, item="after"))
    want = [r.asDict() for r in load_items(spark, d, multiline=True).orderBy("id").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(d).rdd.getNumPartitions() > 10
        got = [r.asDict() for r in load_items(spark, d, multiline="split").orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(want) == 802 and got == want


def _made(d):
    os.makedirs(d, exist_ok=True)
    return d


def test_split_records_refuse_what_breaks_the_pairing_of_quotes(spark, tmp_dir):
    import pytest
    cases = {"open": _by_name(NAMES, item='"A\nB'), "bare": _by_name(NAMES, item='6" Sub, 7" Sub'),
             "wide": _by_name(NAMES, item='"A\nB"') + ",9"}
    for name, line in cases.items():
        p = os.path.join(tmp_dir, "bad-" + name, "x.csv")
        _write(p, ",".join(NAMES) + "\n" + line + "\n")
        with pytest.raises(Exception, match="malformed CSV"):
            load_items(spark, p, multiline="split").collect()
    for f, order in (("a", NAMES), ("b", NAMES[1:] + NAMES[:1])):
        _write(os.path.join(tmp_dir, "heads", f + ".csv"), ",".join(order) + "\n" + _by_name(order) + "\n")
    with pytest.raises(Exception, match="another header"):
        load_items(spark, os.path.join(tmp_dir, "heads"), multiline="split").collect()


def test_appends_at_once_get_unique_dense_ids(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor

    from platelens.plans.jobs import load_menu_table
    paths = []
    for f in range(6):
        paths.append(os.path.join(tmp_dir, f"at-once-{f}"))
        _write(os.path.join(paths[-1], "x.csv"), _menu_csv([_row(f"R{f}", f"item {i}") for i in range(20 + f)]))
    name = "menu_at_once"
    tables.reset_table(spark, name, os.path.join(tmp_dir, "at-once"))
    with ThreadPoolExecutor(6) as pool:
        counts = list(pool.map(lambda p: load_menu_table(spark, p, name), paths))
    assert counts == [20 + f for f in range(6)]
    rows = spark.read.schema(MENU_SCHEMA).parquet(tables.table_location(spark, name)).select("id", "restaurant", "item").collect()
    assert sorted(r.id for r in rows) == list(range(1, sum(counts) + 1))
    for f in range(6):                               # file order within each append
        own = [r.item for r in sorted(rows, key=lambda r: r.id) if r.restaurant == f"R{f}"]
        assert own == [f"item {i}" for i in range(20 + f)]
    assert spark.table(name).count() == sum(counts)
    tables.drop_table(spark, name)


def test_one_of_several_creates_an_entry_and_a_failed_append_gives_its_ids_back(spark, tmp_dir):
    import pytest
    from concurrent.futures import ThreadPoolExecutor
    path = os.path.join(tmp_dir, "log", "1")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: tables.create_once(spark, path, f"{i} text"), range(16)))
    assert sum(won) == 1 and open(path).read() == f"{won.index(True)} text"
    assert os.listdir(os.path.dirname(path)) == ["1"]
    name = "menu_given_back"
    tables.reset_table(spark, name, os.path.join(tmp_dir, "given"))
    with pytest.raises(KeyError), tables.reserved_ids(spark, name, 5) as first:
        raise KeyError(first)
    with tables.reserved_ids(spark, name, 3) as first:
        assert first == 1
    with tables.reserved_ids(spark, name, 2) as first:
        assert first == 4
    tables.drop_table(spark, name)


def test_table_loads_and_fits_leave_no_scratch(spark, tmp_dir):
    from platelens.operators.kmeans import classify
    from platelens.plans.jobs import load_menu_table
    from platelens.session import scratch_path
    top = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    os.makedirs(top, exist_ok=True)
    before = set(os.listdir(top))
    p = os.path.join(tmp_dir, "left", "x.csv")
    _write(p, _menu_csv([_row("A", f'"x {i}\ny"', cal=str(i)) for i in range(30)]))
    name = "menu_left"
    tables.reset_table(spark, name, os.path.join(tmp_dir, "left-table"))
    assert load_menu_table(spark, p, name, multiline="split") == 30
    assert classify(spark.table(name)).iterations > 0
    assert set(os.listdir(top)) == before
    tables.drop_table(spark, name)
