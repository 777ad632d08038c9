"""Principal components of the standardised features.

One aggregate over the items gives everything a fit needs: the mean and variance
of every feature and the covariance of every pair (merged pairwise from running
means, so large means cost no digits). The correlations are the covariance of
the standardised features; their d x d eigenproblem (d = 7) is solved on the
driver. Sign convention: in every component the loading with the largest
magnitude is positive. Scores are native column expressions (sum of loading * z),
so scoring stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from .nulls import valid_feature_flag
from .scaling import standardize


@dataclass
class PCAResult:
    scores: DataFrame
    loadings: list[list[float]]        # n_components x d
    explained_variance: list[float]


def moments(rows: DataFrame, features: list[str]) -> tuple[dict[str, tuple[float, float]], np.ndarray]:
    """({feature: (mean, population sd or 1 when 0)}, covariance of the standardised
    features) in one pass; zeros without rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                   *[F.covar_pop(a, b).alias(f"c_{a}__{b}") for a, b in pairs]).first()
    stats = {}
    for f in features:
        v = row[f"c_{f}__{f}"]
        stats[f] = (row[f"m_{f}"] or 0.0, v ** 0.5 if v else 1.0)
    cov = np.zeros((len(features), len(features)))
    at = {f: i for i, f in enumerate(features)}
    for a, b in pairs:
        c = (row[f"c_{a}__{b}"] or 0.0) / (stats[a][1] * stats[b][1])
        cov[at[a], at[b]] = cov[at[b], at[a]] = c
    return stats, cov


def principal_axes(cov: np.ndarray, n_components: int = 2) -> tuple[list[list[float]], list[float]]:
    """The leading eigenvectors of a covariance matrix, signs by the module's
    convention, and their shares of the variance."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:n_components]
    total = float(values.sum())
    loadings = []
    for j in order:
        v = vectors[:, j]
        big = int(np.argmax(np.abs(v)))
        loadings.append([float(x) for x in (v if v[big] >= 0 else -v)])
    return loadings, [float(values[j]) / total if total else 0.0 for j in order]


def score(zcols: list[str], loading: list[float]) -> Column:
    """sum_j loading_j * z_j as one native expression."""
    return F.expr(" + ".join(f"`{z}` * ({float(w)!r}D)" for z, w in zip(zcols, loading)))


def pca_scores(items: DataFrame, features: list[str] = FEATURES, n_components: int = 2,
               keep: list[str] | None = None) -> PCAResult:
    """Scores PC1..PCn for every item with valid features, plus ``keep``
    columns and the hover label ``item | item_gr`` when those exist."""
    keep = keep if keep is not None else [c for c in ("id", "item", "item_gr", "category") if c in items.columns]
    rows = items.where(valid_feature_flag(features)).select(*features, *keep)
    zcols = ["z_" + f for f in features]
    stats, cov = moments(rows, features)
    loadings, ev = principal_axes(cov, n_components)
    z = standardize(rows, features, stats)
    cols = [score(zcols, l).alias(f"PC{j + 1}") for j, l in enumerate(loadings)]
    out = z.select(*cols, *keep)
    if "item" in keep and "item_gr" in keep:
        out = out.withColumn("label", F.concat(F.col("item"), F.lit(" | "), F.col("item_gr")))
    return PCAResult(out, loadings, ev)


def correlation_matrix(items: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Pearson correlation of every feature pair (the covariance of the
    standardised features), one aggregate pass; rows (f1, f2, corr)."""
    rows = items.where(valid_feature_flag(features))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"c_{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', c_{a}__{b}" for a, b in pairs)
    return one.selectExpr(f"stack({len(pairs)}, {stack}) AS (f1, f2, corr)")
