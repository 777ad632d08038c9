"""Standardisation, k-means and PCA: exactness and properties."""

import math

import numpy as np
from pyspark.sql import functions as F

from platelens.operators.kmeans import classify, name_clusters
from platelens.operators.pca import correlation_matrix, pca_scores
from platelens.operators.scaling import feature_stats, standardize
from platelens.plans import views
from platelens.schema import FEATURES

from conftest import SF001


def test_standardize_population_sd_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "a double, b double")
    st = feature_stats(df, ["a", "b"])
    assert st["b"] == (5.0, 1.0)                      # constant column -> sd 1
    assert math.isclose(st["a"][1], float(np.std([1, 2, 3, 6])))   # ddof 0
    z = [r.z_b for r in standardize(df, ["a", "b"], st).collect()]
    assert z == [0.0] * 4


def test_name_clusters():
    prof = {0: {"sugar": 2.0, "calories": 1.0, "protein": 0.0},
            1: {"sugar": -1.0, "calories": 2.0, "protein": 1.0},
            2: {"sugar": 0.0, "calories": -1.0, "protein": -1.0}}
    assert name_clusters(prof, 3) == {0: "Dessert", 1: "Main", 2: "Side"}
    two = {0: {"calories": 1.0}, 1: {"calories": 3.0}}
    assert name_clusters(two, 2) == {1: "cluster_1", 0: "cluster_2"}


def _assert_nearest(res):
    zc = ["z_" + f for f in FEATURES]
    rows = standardize(res.assigned.where("cluster IS NOT NULL"), FEATURES).select("cluster", *zc).collect()
    C = np.array(res.centroids)
    for r in rows:
        d = ((C - np.array([r[c] for c in zc])) ** 2).sum(axis=1)
        assert d[r.cluster] <= d.min() + 1e-9


def test_lloyd_nearest_centroid_and_invariance(spark):
    items = views.items(spark, SF001).persist()
    res = classify(items, FEATURES, 3, "lloyd")
    _assert_nearest(res)
    base = sorted((r.id, r.category) for r in res.assigned.collect())
    assert {c for _, c in base} == {"Main", "Side", "Dessert"}
    for n in (1, 4, 17):
        again = classify(items.repartition(n), FEATURES, 3, "lloyd")
        assert sorted((r.id, r.category) for r in again.assigned.collect()) == base
    items.unpersist()


def test_invalid_rows_kept_uncategorized(spark):
    items = views.items(spark, SF001)
    bad = items.withColumn("sugar", F.when(F.col("id") == F.lit(3), F.lit(None)).otherwise(F.col("sugar")))
    out = classify(bad, FEATURES, 3, "lloyd").assigned
    assert out.count() == items.count()
    assert out.where("category IS NULL").select("id").collect()[0].id == 3


def test_mllib_kmeans_properties(spark):
    res = classify(views.items(spark, SF001), FEATURES, 3, "mllib")
    _assert_nearest(res)
    assert res.cost is not None and res.cost > 0
    assert sorted(set(res.names.values())) == ["Dessert", "Main", "Side"]


def test_pca_properties(spark):
    items = views.items(spark, SF001)
    res = pca_scores(items, FEATURES, 2)
    pdf = res.scores.toPandas()
    assert len(pdf) == items.count()
    cov = np.cov(pdf["PC1"], pdf["PC2"], ddof=0)
    assert abs(cov[0, 1]) < 1e-6 * max(1.0, cov[0, 0])
    assert cov[0, 0] >= cov[1, 1]
    for l in res.loadings:                      # sign convention
        big = max(range(len(l)), key=lambda i: abs(l[i]))
        assert l[big] > 0
    # same scores as numpy eigen-decomposition of the correlation matrix
    x = items.select(*FEATURES).toPandas().to_numpy()
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    w, v = np.linalg.eigh(np.cov(z.T, ddof=0))
    top = v[:, np.argsort(w)[::-1][:2]]
    for j in range(2):
        col = top[:, j]
        col = col * (1 if col[np.argmax(np.abs(col))] > 0 else -1)
        assert np.allclose(sorted(z @ col), sorted(pdf[f"PC{j + 1}"]), atol=1e-6)


def test_correlation_matrix(spark):
    items = views.items(spark, SF001)
    cm = {(r.f1, r.f2): r.corr for r in correlation_matrix(items, FEATURES).collect()}
    assert len(cm) == 28 and all(math.isclose(cm[(f, f)], 1.0) for f in FEATURES)


def test_fixed_naming_and_inertia(spark):
    from platelens.operators.kmeans import inertia
    items = views.items(spark, SF001)
    res = classify(items, FEATURES, 4, "lloyd", naming="fixed")
    got = {r.cluster: r.category for r in res.assigned.select("cluster", "category").distinct().collect()}
    assert got == {0: "Side", 1: "Dessert", 2: "Main", 3: None}      # id outside the map -> null
    zc = ["z_" + f for f in FEATURES]
    z = standardize(res.assigned, FEATURES)
    cost = inertia(z, zc, res.centroids)
    pts = z.select(*zc, "cluster").toPandas()
    C = np.array(res.centroids)
    brute = sum(((C[int(r.cluster)] - np.array([getattr(r, c) for c in zc])) ** 2).sum() for r in pts.itertuples())
    assert math.isclose(cost, brute, rel_tol=1e-9)


def test_default_start_does_not_depend_on_layout_and_the_step_limit_returns(spark):
    items = views.items(spark, SF001).persist()
    base = None
    for n in (1, 4, 17):
        res = classify(items.repartition(n), FEATURES, 3)
        got = sorted((r.id, r.cluster, r.category) for r in res.assigned.collect())
        base = base or got
        assert got == base and res.converged
    assert 1 < res.iterations < 300
    short = classify(items, FEATURES, 3, max_iter=1)
    assert (short.iterations, short.converged) == (1, False)
    assert short.assigned.where("category IS NULL").count() == 0
    items.unpersist()


def _plain_lloyd(z, k, tol, steps=300):
    cents = z[:k].copy()
    limit = tol * z.var(axis=0).mean()
    for it in range(1, steps + 1):
        near = ((z[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([z[near == c].mean(axis=0) if (near == c).any() else cents[c] for c in range(k)])
        moved, cents = ((new - cents) ** 2).sum(), new
        if moved <= max(limit, 1e-18):
            break
    return cents, it


def test_lloyd_stops_by_the_share_of_the_mean_variance(spark):
    rng = np.random.default_rng(8)
    x = rng.random((2000, 7)) * [1, 5, 9, 1, 2, 3, 0]         # no clusters at all, one constant feature
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "id long, " + ", ".join(f"{f} double" for f in FEATURES))
    sd = np.where(x.std(axis=0) < 1e-12, 1, x.std(axis=0))
    z = (x - x.mean(axis=0)) / sd
    steps = {}
    for tol in (1e-2, 1e-4, 0.0):
        res = classify(df, FEATURES, 3, start="first", tol=tol)
        cents, steps[tol] = _plain_lloyd(z, 3, tol)
        assert res.converged and res.iterations == steps[tol]
        assert np.allclose(res.centroids, cents, atol=1e-9)
    assert steps[1e-2] < steps[1e-4] < steps[0.0]


def test_generated_code_does_not_hold_the_centroids(spark, tmp_dir):
    from platelens.operators.kmeans import ZERO, step_sql
    spark.range(100).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit(0).alias(ZERO)).write.parquet(tmp_dir + "/z")
    spark.read.parquet(tmp_dir + "/z").createOrReplaceTempView("code_points")
    explain = spark._jvm.PythonSQLUtils.explainString
    rng = np.random.default_rng(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = [explain(spark.sql(step_sql("code_points", ["a", "b"], rng.random((3, 2)).tolist()))._jdf.queryExecution(),
                         "codegen") for _ in range(6)]
        codes = {"\n".join(line for line in text.splitlines() if line.startswith("/* ")) for text in texts}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(codes) == 1 and len(codes.pop()) > 1000


def test_infinite_and_text_features_are_kept_without_category(spark):
    items = views.items(spark, SF001)
    odd = items.withColumn("sugar", F.when(F.col("id") == 3, "1e400").when(F.col("id") == 4, "trace")
                           .otherwise(F.col("sugar").cast("string")))
    odd = odd.withColumn("fiber", F.when(F.col("id") == 5, float("inf")).otherwise(F.col("fiber")))
    out = classify(odd, FEATURES, 3).assigned
    assert out.count() == items.count()
    assert sorted(r.id for r in out.where("category IS NULL").collect()) == [3, 4, 5]


def test_no_rows_give_no_clusters(spark):
    res = classify(views.items(spark, SF001).limit(0), FEATURES, 3)
    assert res.centroids == [] and res.assigned.collect() == []


def test_moments_in_one_pass_keep_their_digits(spark):
    from platelens.operators.pca import moments, principal_axes
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)) * [1, 1e-3, 0] + [1e9, 5, 7]
    x[:, 1] += x[:, 0] - 1e9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(7)
    stats, cov = moments(df, ["a", "b", "c"])
    assert stats["c"][1] == 1.0 and np.allclose([stats[f][0] for f in "abc"], x.mean(axis=0))
    z = (x - x.mean(axis=0)) / np.array([stats[f][1] for f in "abc"])
    assert np.allclose(cov, np.cov(z.T, ddof=0), atol=1e-6)
    axes, share = principal_axes(cov)
    assert np.allclose(np.abs(axes[0]), [0.5 ** 0.5, 0.5 ** 0.5, 0], atol=1e-3) and abs(sum(share) - 1) < 1e-6
    stats, cov = moments(df.limit(0), ["a", "b"])
    assert stats == {"a": (0.0, 1.0), "b": (0.0, 1.0)} and not cov.any()
