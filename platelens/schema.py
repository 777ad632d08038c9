"""Schemas and fixed values.

The values under "Fixed values" must stay exactly as they are: they define
the results the engine has to reproduce (menu table layout, the null tokens of
the CSV convention, the feature order used for clustering, the default cluster
names and the default restaurant list of the reports).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Menu table columns in table order, with their declared kind.
MENU_COLUMNS = [
    ("restaurant", "text"),
    ("item", "text"),
    ("calories", "integer"),
    ("cal_fat", "integer"),
    ("total_fat", "integer"),
    ("sat_fat", "real"),
    ("trans_fat", "real"),
    ("cholesterol", "integer"),
    ("sodium", "integer"),
    ("total_carb", "integer"),
    ("fiber", "real"),
    ("sugar", "real"),
    ("protein", "real"),
    ("vit_a", "real"),
    ("vit_c", "real"),
    ("calcium", "real"),
    ("salad", "text"),
]

# Tokens a CSV cell may hold that mean "missing" (the common dataframe
# convention): empty, #N/A, #N/A N/A, #NA, -1.#IND, -1.#QNAN, -NaN, -nan,
# 1.#IND, 1.#QNAN, <NA>, N/A, NA, NULL, NaN, None, n/a, nan, null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Clustering / PCA features, in this order.
FEATURES = ["calories", "total_fat", "sugar", "total_carb", "protein", "calcium", "fiber"]

# Default cluster-id -> category names (valid for one seed only; see
# operators.kmeans.name_clusters for the centroid-based naming we use).
CATEGORY_BY_CLUSTER = {0: "Side", 1: "Dessert", 2: "Main"}

# Default restaurant list of the reports.
DEFAULT_RESTAURANTS = ["Subway", "Mcdonalds", "Sonic", "Taco Bell", "Arbys"]

# Characters that count as whitespace for name cleaning and word splitting:
# TAB..CR, 0x1C..0x20, NEL, NBSP, OGHAM SPACE, EN QUAD..HAIR SPACE, LINE SEP,
# PARAGRAPH SEP, NARROW NBSP, MEDIUM MATH SPACE, IDEOGRAPHIC SPACE.
# Written with \x{..} escapes so the same class works in Java regex and RE2.
WS_CLASS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# The same 29 characters as a plain string (for trim / translate).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")

# Symbols removed from item names.
NAME_SYMBOLS = "®*,"

# Export columns.
EXPORT_COLUMNS = ["item", "item_gr", "category"]

# ---------------------------------------------------------------------------


def _spark_type(kind: str) -> T.DataType:
    # INTEGER-declared columns may hold fractions (7.5 stays 7.5), so every
    # numeric column is double; truncating to bigint would lose data.
    return T.StringType() if kind == "text" else T.DoubleType()


# Raw CSV scan: every field read as text, typed after cleaning.
RAW_MENU_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n, _ in MENU_COLUMNS])

# Typed menu table (the analogue of the reference's fact table).
MENU_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(n, _spark_type(k), True) for n, k in MENU_COLUMNS]
    + [T.StructField("item_gr", T.StringType(), True),
       T.StructField("category", T.StringType(), True)]
)

LOOKUP_SCHEMA = T.StructType([
    T.StructField("item", T.StringType(), True),
    T.StructField("item_gr", T.StringType(), True),
])

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType(), True),
    T.StructField("word_tr", T.StringType(), True),
])

NUMERIC_COLUMNS = [n for n, k in MENU_COLUMNS if k != "text"]
