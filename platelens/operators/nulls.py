"""Null handling: the load-time drop and the feature-validity split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import coerce_numeric, finite_or_null
from ..schema import NULL_TOKENS


def null_tokens_to_null(df: DataFrame, columns: list[str] | None = None,
                        tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Turn CSV null tokens ('NA', 'None', '' ...) into real nulls in string
    columns. A name literally spelled 'None' becomes null as well."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[
        (F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) if c in columns else F.col(c))
        for c in df.columns])


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop every row with a null (or NaN) in any of ``subset`` (default: all
    columns)."""
    types = dict(df.dtypes)
    cond = F.lit(True)
    # plain conjuncts: the optimizer pushes them into scans and through joins
    for c in subset or df.columns:
        cond = cond & F.col(f"`{c}`").isNotNull()
        if types[c] in ("double", "float"):
            cond = cond & ~F.isnan(F.col(f"`{c}`"))
    return df.where(cond)


def coerce_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Numeric coercion: text or double -> finite double, else null."""
    types = dict(df.dtypes)
    return df.select(*[
        ((coerce_numeric(c) if types[c] == "string" else finite_or_null(F.col(c).cast("double"))).alias(c)
         if c in features else F.col(c))
        for c in df.columns])


def valid_feature_flag(features: list[str]):
    """True where every feature is a finite number."""
    cond = F.lit(True)
    for f in features:
        cond = cond & F.col(f).isNotNull() & ~F.isnan(F.col(f)) & (F.abs(F.col(f)) < F.lit(float("inf")))
    return cond
