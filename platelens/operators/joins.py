"""Join helpers: keyed write-back, and a left join that spreads hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, so fewer than
#: HOT_PARTS keys can be hot, whatever the data.
HOT_PARTS = 1000


def hot_keys(counts: DataFrame, n: str = "n", parts: int = HOT_PARTS) -> DataFrame:
    """The keys of ``counts`` (unique keys, their row counts ``n``) that hold more
    than 1 / ``parts`` of all rows: fewer than ``parts`` rows."""
    total = counts.select(F.sum(n)).scalar()
    return counts.where(F.col(n) * parts > total)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], counts: DataFrame, n: str = "n",
                parts: int = HOT_PARTS) -> DataFrame:
    """``rows`` left joined with ``table`` (unique on ``on``; null keys match) without
    gathering a hot key's rows in a task.

    ``counts`` (``on``, ``n``) tells how often a key comes; it decides only which way
    a row takes. The values of hot keys, fewer than ``parts`` rows by
    construction, are broadcast. Every other row meets its value in a shuffle join
    on the key and a salt, which is the key's hash for these and the hash of the
    whole row for rows that have their value already, so those spread over all
    tasks. Columns of ``table`` that ``rows`` has too are not allowed, but ``on``.
    """
    values = [c for c in table.columns if c not in on]

    def keyed(df: DataFrame, prefix: str, *more: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in on], F.struct(*values).alias(f"{prefix}values_"), *more)

    def same(prefix: str) -> Column:
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return cond

    hot = hot_keys(counts, n, parts).select(*[F.col(c).alias(f"_k_{c}") for c in on])
    hot = keyed(table.join(F.broadcast(hot), same("_k_"), "left_semi"), "_h_", F.lit(True).alias("_hot"))
    x = rows.join(F.broadcast(hot), same("_h_"), "left")
    x = x.withColumn("_salt", F.when(F.col("_hot"), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*on)))
    t = keyed(table, "_t_", F.xxhash64(*on).alias("_t_salt"))
    y = x.join(t, same("_t_") & (F.col("_salt") == F.col("_t_salt")), "left")
    return y.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_h_values_.{c}")).otherwise(F.col(f"_t_values_.{c}")).alias(c)
                                     for c in values])


def write_back(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed update: rows of ``base`` whose ``key`` is in ``updates`` take the
    update's values (a null update sets null); other rows are unchanged.
    ``updates`` must be unique on ``key``."""
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns]).withColumn("_u_hit", F.lit(True))
    j = base.join(u, key, "left")
    out = [F.when(F.col("_u_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
           if c in columns else F.col(c) for c in base.columns]
    return j.select(*out)
