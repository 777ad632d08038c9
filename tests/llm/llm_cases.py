"""Small tables that every operator must take: nulls, empty and long texts,
ties, repeated rows, clashing columns, no rows."""

LONG = "lorem ipsum dolor sit amet " * 4000

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "s"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "s"),
    (3, "", None, None), (4, None, "en", "s"), (5, "   \n\t ", "en", "s"),
    (6, LONG, "en", "s"), (7, LONG, "en", "t"), (None, "a text of no id", "en", "s"), (None, None, None, None),
    (8, "Two Words", "en", "s"), (9, "two words", "en", "s"), (10, "é ü 漢字   x", "xx", "s"),
    (11, 'password = "hunter2hunter2X9"', "en", "s"), (12, "one\none\n\none", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
# columns named like the operators' own; they must not matter
CLASH = {"_id": "x", "_text": "y", "_row": "z", "fp": "f", "score": "q", "kept": "k", "digest": "d", "n": "n",
         "component_id": "c", "_sha": "h", "part": "p", "text_sha256": "t"}


def docs(spark, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
