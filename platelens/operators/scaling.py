"""Feature statistics and standardisation.

Standardisation uses the population standard deviation (ddof 0); a constant
feature (sd 0) is divided by 1, so it becomes 0. The statistics are one
distributed aggregate (2 numbers per feature); they are applied as literals so
the scaling stays a native projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_stats(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """{feature: (mean, sd_pop or 1 when 0)} in one pass."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    row = df.agg(*aggs).first()
    out = {}
    for f in features:
        m, s = row[f"m_{f}"], row[f"s_{f}"]
        out[f] = (m, 1.0 if (s is None or s == 0.0) else s)
    return out


def stats_frame(df: DataFrame, features: list[str]) -> DataFrame:
    """The same statistics as a one-row-per-feature DataFrame (for reports)."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{f}', m_{f}, s_{f}" for f in features)
    return one.selectExpr(f"stack({len(features)}, {stack}) AS (feature, mean, sd)").select(
        "feature", "mean",
        F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(F.col("sd")).alias("sd"))


def standardize(df: DataFrame, features: list[str], stats: dict | None = None,
                prefix: str = "z_") -> DataFrame:
    """Add ``z_<feature>`` = (x - mean) / sd for every feature."""
    stats = stats or feature_stats(df, features)
    return df.select("*", *[((F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1])).alias(prefix + f)
                            for f in features])
