"""k-means clustering of menu items and naming of the clusters.

Lloyd iterations, stopped as the usual library does: when the squared moves of
all centroids together are at most ``tol`` times the mean variance of the
features (so at once when no row changes its cluster), or after ``max_iter``
steps; the result tells which. The start is drawn from the data alone, so the
result depends neither on partitions nor on cores:

* ``first``: the k rows with the smallest ids;
* ``hash`` (default): the k rows with the smallest md5 of ``seed:id``.

The id and features are written once as a narrow table; each step is one SQL
aggregate over it (cluster -> feature means) that returns k rows. The centroids
are one array literal, and their places in it are counted from a column of
zeros: generated code then refers to the array as an object, so it is the same
in every step and compiled once (a plain number, or an element that the
optimizer can fold into one, becomes part of the code). The steps run in a child
session with k shuffle partitions and without re-planning: k rows per task are
all they shuffle. ``mllib_kmeans``
(k-means|| start) stays available; its result depends on the partition layout.

Naming (``name_clusters``) is by centroid, not by cluster id, so it does not
depend on the start: Dessert = highest mean (standardised) sugar; of the rest,
Main = highest calories + protein; Side = the remaining one. For k != 3 the
names are ``cluster_<r>`` with r the rank by mean calories (1 = most).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORY_BY_CLUSTER, FEATURES
from ..session import scratch_folder, scratch_scope, scratch_table
from .nulls import coerce_features, valid_feature_flag
from .scaling import feature_stats, standardize

MAX_STEPS = 300
TOL = 1e-4
ROUNDING = 1e-18          # squared moves that rounding alone makes
ZERO = "_zero"            # column of zeros in the fit table


@dataclass
class KMeansResult:
    assigned: DataFrame                # input rows + cluster (+ category)
    centroids: list[list[float]]       # k x d, standardised space
    iterations: int
    converged: bool = True             # False: stopped by the step limit
    cost: float | None = None          # sum of squared distances (inertia)
    names: dict[int, str] = field(default_factory=dict)


def _num(v: float) -> str:
    # repr() round-trips a double exactly; the D suffix makes it a double literal.
    return f"({float(v)!r}D)"


def _argmin_sql(dists: list[str]) -> str:
    """Index of the smallest expression (the lowest index on an exact tie)."""
    cands = [f"named_struct('d', {d}, 'c', {i})" for i, d in enumerate(dists)]
    return f"({cands[0] if len(cands) == 1 else f'least({chr(44).join(cands)})'}).c"


def _sq_dist_sql(zcols: list[str], c: list[str]) -> str:
    """Squared Euclidean distance to the coordinates ``c``, SQL terms added left to right."""
    return " + ".join(f"(`{z}` - {v}) * (`{z}` - {v})" for z, v in zip(zcols, c))


def nearest(zcols: list[str], centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid (lowest index on an exact tie)."""
    return F.expr(_argmin_sql([_sq_dist_sql(zcols, [_num(v) for v in c]) for c in centroids]))


def step_sql(view: str, zcols: list[str], centroids: list[list[float]]) -> str:
    """One step over ``view`` (with the column ZERO): (cluster, means of zcols) in
    code that does not change with the centroids. The differences are columns of
    their own, so the planner finds no common parts to take out (their order in
    the code would follow the values)."""
    d, cols = len(zcols), ", ".join(f"`{z}`" for z in zcols)
    flat = f"array({', '.join(_num(v) for c in centroids for v in c)})"
    diffs = ", ".join(f"`{z}` - _cents[{ZERO} + {i * d + j}] AS _d_{i}_{j}"
                      for i in range(len(centroids)) for j, z in enumerate(zcols))
    dists = [" + ".join(f"_d_{i}_{j} * _d_{i}_{j}" for j in range(d)) for i in range(len(centroids))]
    means = ", ".join(f"avg(`{z}`) AS `{z}`" for z in zcols)
    return (f"SELECT cluster, {means} FROM (SELECT {_argmin_sql(dists)} AS cluster, {cols} FROM (SELECT {cols}, {diffs} "
            f"FROM (SELECT *, {flat} AS _cents FROM {view}))) GROUP BY cluster")


@contextmanager
def _points(pts: DataFrame, columns: list[str], k: int) -> Iterator[tuple[SparkSession, str]]:
    """A child session for the steps and its view of ``pts`` (``columns``, ZERO), written once."""
    spark = pts.sparkSession
    with scratch_scope(spark):
        table = pts.select(*columns, F.lit(0).alias(ZERO))
        path = scratch_folder(table, "points")
        child = spark.newSession()
        child.conf.set("spark.sql.adaptive.enabled", "false")
        child.conf.set("spark.sql.shuffle.partitions", str(k))
        view = f"points_{uuid.uuid4().hex[:12]}"
        child.read.schema(table.schema).parquet(path).createOrReplaceTempView(view)
        try:
            yield child, view
        finally:
            child.catalog.dropTempView(view)


def start_rows(pts: DataFrame, zcols: list[str], k: int, start: str, seed: int, id_col: str) -> list[list[float]]:
    """The k starting centroids (see the module docstring)."""
    if start == "first":
        order = [F.col(id_col)]
    else:
        order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]
    return [[float(r[c]) for c in zcols] for r in pts.orderBy(*order).limit(k).collect()]     # k rows


def lloyd(pts: DataFrame, zcols: list[str], k: int = 3, max_iter: int = MAX_STEPS, id_col: str = "id",
          start: str = "hash", seed: int = 0, tol: float = TOL) -> tuple[list[list[float]], int, bool]:
    """Lloyd's algorithm on the narrow table ``pts`` (id and standardised features):
    (centroids, steps, whether it settled). See the module docstring for the stop;
    with ``tol=0`` the centroids stand still but for rounding. An empty cluster
    keeps its centroid; fewer rows than k give fewer clusters, no rows none."""
    with _points(pts, [id_col, *zcols], k) as (spark, view):
        points = spark.table(view)
        cents = start_rows(points, zcols, k, start, seed, id_col)
        if not cents:
            return [], 0, True
        spread = points.agg(*[F.var_pop(c) for c in zcols]).first()
        limit = max(tol * sum(spread) / len(zcols), ROUNDING)
        for it in range(1, max_iter + 1):
            new = [list(c) for c in cents]
            for r in spark.sql(step_sql(view, zcols, cents)).collect():        # k rows
                new[r["cluster"]] = [float(r[c]) for c in zcols]
            moved = sum((a - b) ** 2 for x, y in zip(new, cents) for a, b in zip(x, y))
            cents = new
            if moved <= limit:
                return cents, it, True
        return cents, max_iter, False


def mllib_kmeans(pts: DataFrame, zcols: list[str], k: int = 3, seed: int = 0,
                 max_iter: int = MAX_STEPS, tol: float = TOL) -> tuple[list[list[float]], int, float]:
    """Spark ML k-means on the standardised columns: (centroids, steps, cost)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=zcols, outputCol="_features", handleInvalid="skip").transform(pts.select(*zcols))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="_features",
                   predictionCol="cluster").fit(data)
    summary = model.summary
    return ([[float(v) for v in c] for c in model.clusterCenters()], int(summary.numIter),
            float(summary.trainingCost))


def name_clusters(profile: dict[int, dict[str, float]], k: int) -> dict[int, str]:
    """Cluster index -> category name from per-cluster mean features
    (standardised): see the module docstring."""
    ids = sorted(profile)
    if k == 3 and len(ids) == 3:
        dessert = max(ids, key=lambda c: (profile[c]["sugar"], -c))
        rest = [c for c in ids if c != dessert]
        main = max(rest, key=lambda c: (profile[c]["calories"] + profile[c]["protein"], -c))
        side = [c for c in rest if c != main][0]
        return {dessert: "Dessert", main: "Main", side: "Side"}
    order = sorted(ids, key=lambda c: (-profile[c]["calories"], c))
    return {c: f"cluster_{i + 1}" for i, c in enumerate(order)}


def centroid_profile(centroids: list[list[float]], features: list[str]) -> dict[int, dict[str, float]]:
    return {i: dict(zip(features, c)) for i, c in enumerate(centroids)}


def category_column(names: dict[int, str], cluster: str = "cluster") -> Column:
    m = F.create_map(*[x for kv in sorted(names.items()) for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[F.col(cluster)]


def classify(items: DataFrame, features: list[str] = FEATURES, k: int = 3,
             method: str = "lloyd", max_iter: int = MAX_STEPS, id_col: str = "id",
             seed: int = 0, naming: str = "centroid", start: str = "hash", tol: float = TOL,
             fit_on: DataFrame | None = None) -> KMeansResult:
    """Add ``cluster`` and ``category`` to every item.

    Feature columns may be text or numbers; they are coerced to finite doubles
    first. Rows whose features are not all finite numbers are not clustered;
    they are kept with a null cluster and category.

    ``naming="centroid"`` (default) names clusters from their centroids (see
    ``name_clusters``); ``naming="fixed"`` uses ``CATEGORY_BY_CLUSTER``
    (cluster id -> name; ids outside the map get a null category), which is
    only meaningful for one particular start.

    ``fit_on`` may give the same rows' ids and features more cheaply than ``items``
    itself, e.g. from before a join that adds other columns.

    The fit reads a narrow table (id and features) written once under the
    shared ``spark.checkpoint.dir`` and removed after the fit; the assignment is
    an expression over the items themselves, without a join.
    """
    items = coerce_features(items, features)
    valid = valid_feature_flag(features)
    zcols = ["z_" + f for f in features]
    source = items if fit_on is None else coerce_features(fit_on, features)
    with scratch_table(source.where(valid).select(id_col, *features), "features") as fit_rows:
        stats = feature_stats(fit_rows, features)
        z = standardize(fit_rows, features, stats).select(id_col, *zcols)
        cost, settled = None, True
        if method == "lloyd":
            cents, steps, settled = lloyd(z, zcols, k, max_iter, id_col, start, seed, tol)
        else:
            cents, steps, cost = mllib_kmeans(z, zcols, k, seed, max_iter, tol)
            settled = steps < max_iter
    if naming == "fixed":
        names = {c: n for c, n in CATEGORY_BY_CLUSTER.items() if c < k}
    else:
        names = name_clusters(centroid_profile(cents, features), k)
    if cents:
        out = (standardize(items, features, stats)
               .withColumn("cluster", F.when(valid, nearest(zcols, cents)))
               .withColumn("category", category_column(names)).drop(*zcols))
    else:
        out = items.withColumns({"cluster": F.lit(None).cast("int"), "category": F.lit(None).cast("string")})
    return KMeansResult(out, cents, steps, settled, cost, names)


def inertia(assigned_z: DataFrame, zcols: list[str], centroids: list[list[float]],
            cluster: str = "cluster") -> float:
    """Sum of squared distances to the assigned centroid."""
    d = None
    for i, c in enumerate(centroids):
        term = F.when(F.col(cluster) == i, F.expr(_sq_dist_sql(zcols, [_num(v) for v in c])))
        d = term if d is None else F.coalesce(d, term)
    return float(assigned_z.agg(F.sum(d)).first()[0] or 0.0)
