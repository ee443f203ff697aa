"""Steps whose time or memory grew faster than their tables."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomframe.operators import explain, metrics, models, neighbours, treeparts


def brute_nearest(a, b, bound, keep):
    gaps = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), 9)
    return [(i, j, gaps[i, j]) for i in range(len(a)) for j in np.argsort(gaps[i], kind="stable")[:keep] if gaps[i, j] <= bound[i] + neighbours.SLACK]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_wide_pairs_are_ruled_out_by_a_product(monkeypatch, shift):
    """F3 to F6: every pair of wide vectors got its distance from explicit differences."""
    rng = np.random.default_rng(5)
    b = np.repeat(rng.integers(-3, 4, size=(150, 24)).astype(float), 2, axis=0) + shift  # ties
    a, bound = b[::7] + 0.5, np.where(np.arange(43) % 2, np.inf, 9.0)
    want, taken = brute_nearest(a, b, bound, 5), []
    monkeypatch.setattr(neighbours, "_distances", lambda *x: pytest.fail("all pairs"))
    paired = neighbours._paired
    monkeypatch.setattr(neighbours, "_paired", lambda x, y: (taken.append(len(x)), paired(x, y))[1])
    got = list(zip(*neighbours._nearest(a, b, bound, 5, "euclidean", 2.0)))
    assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-9)
    assert sum(taken) < len(a) * len(b) / 4


def test_vectors_that_are_not_finite_keep_their_distances():
    a = np.zeros((2, 16))
    b = np.vstack([np.full(16, np.inf), np.full(16, np.nan), np.ones(16)])
    q, c, found = neighbours._nearest(a, b, np.full(2, np.inf), 3, "euclidean", 2.0)
    assert list(zip(q, c, found)) == [(0, 2, 4.0), (0, 0, np.inf), (1, 2, 4.0), (1, 0, np.inf)]


def test_wide_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 20))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id bigint, v array<double>")
    found = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.knn_join(df, "id", "v", 4, block_points=50, block_queries=70, pivots=6).collect()}
    gaps = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(gaps, np.inf)
    order = np.argsort(gaps, axis=1, kind="stable")
    assert found == {(i, k + 1): order[i, k] for i in range(400) for k in range(4)}


def wide_table(spark, points, kind="array<float>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], f"id bigint, v {kind}").repartition(6)


def nearest_of(points, k):
    gaps = np.round(np.sqrt(((points[:, None].astype(float) - points[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(gaps, np.inf)
    order = np.argsort(gaps, axis=1, kind="stable")
    return {(i, j + 1): (order[i, j], gaps[i, order[i, j]]) for i in range(len(points)) for j in range(k)}


def found_by(df, k, **more):
    return {(r["id"], r["rank"]): (r["neighbour"], pytest.approx(r["distance"], abs=1e-9)) for r in neighbours.knn_join(df, "id", "v", k, **more).collect()}


def test_wide_vectors_are_not_copied_for_every_block(spark, monkeypatch):
    """F1 to F4: each query was written and shuffled once for nearly every block of points."""
    rng, written, keep = np.random.default_rng(8), [], neighbours.materialize
    points = rng.normal(size=(900, 24)).astype(np.float32)
    monkeypatch.setattr(neighbours, "materialize", lambda df, *x, **y: (written.append((out := keep(df, *x, **y)).count()), out)[1])
    searched, search = [], neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda asked, *x: (searched.append(asked.count()), search(asked, *x))[1])
    assert found_by(wide_table(spark, points), 4, block_points=30, block_queries=30) == nearest_of(points, 4)
    assert sum(written) + sum(searched) < 3 * 900


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_packets_and_parts_give_the_nearest(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "PACKET_BYTES", 2_000)
    monkeypatch.setattr(neighbours, "PART_BYTES", 6_000)
    packets, sizes = neighbours._packets, []
    monkeypatch.setattr(neighbours, "_packets", lambda *x: (sizes.append((out := packets(*x).repartition(5)).count()), out)[1])
    points = np.random.default_rng(9).integers(-2, 3, size=(300, 18)).astype(np.float32)
    points[::3] = points[0]  # a third of the rows are copies, distances are often equal
    df = wide_table(spark, points, kind)
    assert found_by(df, 4) == nearest_of(points, 4) and sizes[0] > 7
    few = df.where("id % 7 = 1")
    gaps = np.round(np.sqrt(((points[1::7, None].astype(float) - points[None]) ** 2).sum(2)), 9)
    order = np.argsort(gaps, axis=1, kind="stable")[:, :4]
    assert {k: v[0] for k, v in found_by(few, 4, points=df).items()} == {(7 * i + 1, j + 1): order[i, j] for i in range(len(gaps)) for j in range(4)}


def test_vectors_are_shuffled_once_to_find_copies(spark):
    """the vectors were shuffled to rank their keys and again to group them."""
    df = wide_table(spark, np.random.default_rng(12).normal(size=(60, 18)).repeat(2, axis=0)).localCheckpoint()
    found = neighbours._distinct_vectors(df, "id", "v", 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["gid"], r["ids"]) for r in found.collect()) == [(2 * i, [2 * i]) for i in range(60)]


def predicted(spark, monkeypatch, weights, task):
    """(predictions over wide vectors, labels, the nearest by brute force); no query may be sent to blocks of the tree."""
    monkeypatch.setattr(neighbours, "_search", lambda *x: pytest.fail("sent to blocks"))
    points = np.random.default_rng(13).normal(size=(300, 20)).astype(np.float32)
    near = neighbours.knn_join(wide_table(spark, points), "id", "v", 5, block_points=30, block_queries=30)
    labels = spark.range(300).selectExpr("id as k", "cast(id * 7 % 4 as int) as y")
    rows = neighbours.knn_predict(near, "id", labels, "k", "y", weights, task).collect()
    return {r["id"]: r["prediction"] for r in rows}, [i * 7 % 4 for i in range(300)], nearest_of(points, 5)


def test_votes_of_wide_neighbours(spark, monkeypatch):
    """the votes came from a join whose disk grew with the square of the table."""
    found, y, near = predicted(spark, monkeypatch, "uniform", "classification")
    votes = [[y[near[i, j][0]] for j in range(1, 6)] for i in range(300)]
    assert found == {i: min(v, key=lambda c: (-v.count(c), c)) for i, v in enumerate(votes)}


def test_means_of_wide_neighbours(spark, monkeypatch):
    """as F3, for the mean weighted by distance."""
    found, y, near = predicted(spark, monkeypatch, "distance", "regression")
    near = [[near[i, j] for j in range(1, 6)] for i in range(300)]
    assert found == {i: pytest.approx(sum(y[n] / d for n, d in x) / sum(1 / d for _, d in x), abs=1e-6) for i, x in enumerate(near)}


def test_tight_clusters_of_wide_vectors_go_down_the_tree(spark):
    rng = np.random.default_rng(10)
    loose, tight = rng.normal(size=(800, 20)), np.repeat(rng.normal(size=(40, 20)) * 50, 20, axis=0) + rng.normal(size=(800, 20))
    lists = lambda points: neighbours._lists_of_all(*[neighbours._distinct_vectors(wide_table(spark, points, "array<double>"), "id", "v", 5)] * 2, 20, 5, "euclidean", 2.0, 40, 256)
    assert lists(tight) is None and lists(loose) is not None
    assert found_by(wide_table(spark, tight, "array<double>"), 4, block_points=40, block_queries=60) == nearest_of(tight, 4)


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-20), (0.0, 1e20)])
def test_best_of_packets_equals_brute_force(monkeypatch, shift, scale):
    monkeypatch.setattr(neighbours, "FIRST", 16)
    monkeypatch.setattr(neighbours, "TILE", (32, 64))
    rng = np.random.default_rng(11)
    points, asked = (rng.normal(size=(n, 16)) * scale + shift for n in (400, 70))
    points[5], points[300, 2], asked[3, 1], asked[9] = np.nan, np.inf, np.nan, -np.inf
    best, sizes = neighbours._Best(asked, 5, "euclidean", 2.0), [1, 100, 250, 49]
    for at in np.split(np.arange(400), np.cumsum(sizes)[:-1]):
        several = np.empty(len(at), dtype=object)
        several[:] = [np.array([2 * i, 2 * i + 1]) for i in at]
        best.meet(points[at], 2 * at, several)
    with np.errstate(invalid="ignore"):
        gaps = np.round(np.sqrt(((asked[:, None] - points[None]) ** 2).sum(2)), 9)
    want = [(i, 2 * j + k) for i in range(70) for j in np.argsort(gaps[i], kind="stable")[:3] if not np.isnan(gaps[i, j]) for k in (0, 1)]
    rows, _, keys = best.merge()
    assert list(zip(rows, keys)) == [x for i in range(70) for x in [y for y in want if y[0] == i][:5]]


def table_of(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 6, n), rng.integers(0, 4, n), np.round(rng.normal(size=n), 6)
    y = 3.0 * a - 2.0 * (b == 2) + 4.0 * (c > 0.3) + rng.normal(size=n)
    return spark.createDataFrame(list(zip(map(float, a), map(float, b), map(float, c), map(float, y))), "a double, b double, c double, y double")


def fit(df, family, features, monkeypatch, grouped, params=None):
    monkeypatch.setattr(models, "GROUPED_ROWS", 1_000 if grouped else 10**9)
    return models.fit_model(df, features, "y", family, "regression", params)


def test_boosting_on_groups_gives_the_trees_of_all_rows(spark, monkeypatch):
    """a boosted model went through all rows at every level of every tree."""
    df, names = table_of(spark, 4_000), ["a", "b"]
    sizes, groups = [], models.tree_groups
    monkeypatch.setattr(models, "tree_groups", lambda *x: (sizes.append((found := groups(*x))[1].count()), found)[1])
    few = {"n_estimators": 6}
    small, whole = (fit(df, "gradient_boosting", names, monkeypatch, g, few) for g in (True, False))
    assert sizes == [24]
    near = [[round(r["pred"], 9) for r in models.predict(df, m, names).orderBy(*names).collect()] for m in (small, whole)]
    assert near[0] == near[1] and len(set(near[0])) > 6
    assert "weightCol" not in {p.name for p in small.stages[-1].extractParamMap()}


@pytest.mark.parametrize("family,params", [("random_forest", {"n_estimators": 20}), ("boosted_preset", {"n_estimators": 20, "max_depth": 3}), ("gradient_boosting", {"n_estimators": 20})])
def test_groups_with_bins_and_draws_fit_as_well(spark, monkeypatch, family, params):
    """F2, F9 to F11, F14, F15: rows that are drawn are held by groups; many-valued features are binned."""
    df, names = table_of(spark, 6_000), ["a", "b", "c"]
    monkeypatch.setattr(models, "GROUPS", 3_000)
    one, same, whole = (fit(d, family, names, monkeypatch, g, params) for d, g in ((df, True), (df.repartition(7), True), (df, False)))
    assert len(one.stages) == 3 and len(whole.stages) == 2
    errors = [metrics.regression_errors(models.predict(df, m, ["y"]), "y").first() for m in (one, same, whole)]
    assert errors[0]["rmse"] == pytest.approx(errors[1]["rmse"], rel=1e-9)
    assert errors[0]["rmse"] == pytest.approx(errors[2]["rmse"], rel=0.06)
    importance = [m.stages[-1].featureImportances.toArray() for m in (one, whole)]
    assert np.allclose(*importance, atol=0.08)
    # attributions add up and follow the rows, not the groups
    keyed = df.limit(200).withColumn("id", F.monotonically_increasing_id())
    found = treeparts.tree_attributions(keyed, "id", names, one).groupBy("id").agg(F.sum("contribution").alias("s"), F.first("base").alias("base"), F.first("output").alias("output"))
    joined = found.join(models.predict(keyed, one, ["id"]), "id").collect()
    assert all(r["base"] + r["s"] == pytest.approx(r["output"]) == pytest.approx(r["pred"]) for r in joined)
    mean = df.agg(F.avg("y")).first()[0]
    assert joined[0]["base"] == pytest.approx(mean, abs=0.15)


def test_what_cannot_be_grouped_is_fitted_on_its_rows(spark, monkeypatch):
    df = table_of(spark, 3_000)
    monkeypatch.setattr(models, "GROUPS", 10)
    assert models.tree_groups(df, ["a", "b"], "y", 3_000, False, 1) is None
    monkeypatch.undo()
    assert models.tree_groups(df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), ["a", "b"], "y", 3_000, False, 1) is None


def test_rows_of_a_table_do_not_pass_through_the_driver(spark, monkeypatch):
    """F16, F17: small files of many rows were broadcast."""
    df = table_of(spark, 500).withColumn("id", F.monotonically_increasing_id())
    model = fit(df, "knn", ["a", "b"], monkeypatch, False)
    scored = model.transform(df)
    assert scored.count() == 500
    joins = [x for x in scored._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [" in x]
    wide = [x for x in joins if "gvec" in x or "neighbour" in x or x.lstrip(" :+-").startswith("SortMergeJoin [__row")]
    assert len(wide) >= 3 and all("SortMergeJoin" in x for x in wide), joins
    found = explain.permutation_importance(df, "id", ["a"], "y", lambda d: d.withColumn("pred", 3 * F.col("a")), repeats=2)
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [place" in x]
    assert joins and all("SortMergeJoin" in x for x in joins), joins
