"""The paths that only large or skewed tables take, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.functions.ordering import global_row_number, order_index, permutation_keys, permuted, seeded_rank
from loomframe.functions.quantiles import exact_quantiles
from loomframe.operators import encode, explain, features, metrics, models, neighbours, perceptron, quality, split, textfeatures
from loomframe.streaming import jobs

HOT = "cast(case when id % 3 = 0 then 7 else (id * 7919) % 10007 end as double)"


def test_quantiles_narrowing_equals_sorting(spark):
    df = spark.range(20000).selectExpr(f"{HOT} as a", "case when id % 50 = 0 then null else rand(3) end as b", "cast('nan' as double) as c")
    probs = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1]
    got = exact_quantiles(df, ["a", "b", "c"], probs, small=100)
    want = df.toPandas()
    for c in "ab":
        assert got[c] == pytest.approx(list(want[c].quantile(probs)), abs=1e-12)
    assert got["c"] == [None] * len(probs)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_bucketed_rank_equals_window(spark, direction):
    df = spark.range(6000).selectExpr("id", f"case when id % 97 = 0 then null else {HOT} end as s")
    got = global_row_number(df, [("s", direction), ("id", "asc")], rows_per_bucket=200)
    want = global_row_number(df, [("s", direction), ("id", "asc")])
    assert got.exceptAll(want).count() == 0 and got.count() == 6000


def test_dictionary_in_buckets(spark):
    df = spark.range(5000).selectExpr("cast(id * 31 % 977 as string) as v")
    rows = order_index(df, "v", rows_per_bucket=50).collect()
    assert [r["value"] for r in sorted(rows, key=lambda r: r["code"])] == sorted({r["value"] for r in rows})
    assert sorted(r["code"] for r in rows) == list(range(977))


def test_seeded_order_ignores_partitions(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 = 0 or id % 3 = 0 as y")
    a = seeded_rank(df, 42, "id", by=["y"])
    b = seeded_rank(df.repartition(13), 42, "id", by=["y"], width=1)
    assert a.exceptAll(b).count() == 0
    for fn in (lambda d: split.split_stratified(d, "id", "y"), lambda d: split.folds_stratified(d, "id", "y"), lambda d: split.folds_plain(d, "id")):
        assert fn(df).exceptAll(fn(df.repartition(7))).count() == 0


def test_folds_are_balanced(spark):
    df = spark.range(1003).selectExpr("id", "id % 7 = 0 as y")
    counts = split.folds_stratified(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    for y in (True, False):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_auc_in_ranges(spark):
    df = spark.range(4000).selectExpr("id", "cast(id * 7919 % 3 = 0 as int) as y", "case when id % 3 = 1 then 0.5 else round((id * 37 % 1009) / 1009, 2) end as p")
    got = metrics.auc_binary(df, rows_per_bucket=100).first()["auc"]
    rows = df.toPandas()
    pos, neg = rows.p[rows.y == 1].to_numpy(), rows.p[rows.y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want, abs=1e-12)


def brute(points: np.ndarray, k: int, metric: str, p: float):
    gap = np.abs(points[:, None, :] - points[None, :, :])
    d = {"euclidean": np.sqrt((gap**2).sum(2)), "manhattan": gap.sum(2), "minkowski": (gap**p).sum(2) ** (1 / p)}[metric]
    d = np.round(d, 9)
    out = {}
    for i in range(len(points)):
        order = sorted((d[i, j], j) for j in range(len(points)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0)])
def test_knn_blocks_copies_and_pruning(spark, metric, p):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 4)) * 20
    points = np.round(centres[rng.integers(0, 8, 300)] + rng.normal(size=(300, 4)), 1)
    points[::3] = points[0]  # a third of the rows are copies of one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    found = neighbours.knn_join(df, "id", "v", 4, metric=metric, p=p, block_points=16, block_queries=24, pivots=9)
    got: dict = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(points, 4, metric, p)


def test_knn_between_tables(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(90, 3))
    make = lambda x: spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    found = neighbours.knn_join(make(a), "id", "v", 3, points=make(b), pivots=5, block_points=10).collect()
    want = np.argsort(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), axis=1)[:, :3]
    assert {(r["id"], r["rank"]): r["neighbour"] for r in found} == {(i, j + 1): want[i, j] for i in range(40) for j in range(3)}


def clustered(spark, n):
    """Ten points around each of n / 10 centres."""
    rng = np.random.default_rng(4)
    points = np.repeat(rng.uniform(0, 1000, size=(n // 10, 3)), 10, axis=0) + rng.normal(size=(n, 3))
    return points, spark.createDataFrame([(i, [float(c) for c in v], [i]) for i, v in enumerate(points)], "gid bigint, vec array<double>, ids array<bigint>")


def visited_pairs(spark, n, leaf=40, fan=8):
    points, df = clustered(spark, n)
    tree = neighbours.PivotTree(df, 4, leaf, fan, "euclidean", 2.0)
    home = tree.home(df).withColumnRenamed("node", "home").withColumn("bound", F.lit(6.0))
    sizes = tree.placed.groupBy("node").count()
    assert tree.placed.count() == n and sizes.agg(F.max("count")).first()[0] < n / 4
    both = tree.visits(home).select("gid", "node").unionByName(home.select("gid", F.col("home").alias("node")))
    assert both.count() == both.distinct().count()
    return len(tree.levels), both.join(sizes, "node").agg(F.sum("count")).first()[0]


def test_tree_grows_and_pairs_do_not_square(spark):
    (low, few), (high, many) = visited_pairs(spark, 1_000), visited_pairs(spark, 8_000)
    assert low < high
    assert many / few < 8**1.3 and many < 8_000**2 / 50


def test_deep_tree_equals_brute_force(spark):
    points, df = clustered(spark, 1_000)
    found = neighbours.knn_join(df.select(F.col("gid").alias("id"), F.col("vec").alias("v")), "id", "v", 3, block_points=12, block_queries=50, pivots=4)
    got: dict = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(points, 3, "euclidean", 2.0)


def test_knn_odd_tables(spark):
    kind = "id bigint, v array<double>"
    join = lambda rows, **more: sorted((r["id"], r["rank"], r["neighbour"], r["distance"]) for r in neighbours.knn_join(spark.createDataFrame(rows, kind), "id", "v", 2, **more).collect())
    assert join([]) == join([(1, [0.0])]) == join([(1, None)]) == []
    assert join([(1, [0.0]), (2, None), (3, [4.0])]) == [(1, 1, 3, 4.0), (3, 1, 1, 4.0)]
    none = spark.createDataFrame([], kind)
    assert join([(1, [0.0])], points=none) == []


def replay(rows, limit: int, span: int):
    held: dict = {}
    out = {}
    for row, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        kept = [x for x in held.get(key, []) if x > t - span]
        out[row] = len(kept) < limit
        held[key] = kept + [t] if out[row] else kept
    return out


def limiter_input(spark):
    """One busy key with a third of the rows and quiet gaps."""
    return spark.range(1500).selectExpr(
        "id", "if(id % 3 = 0, 0, id % 11 + 1) as k", "timestamp_seconds(1700000000 + id * 40 + (id * 7919 % 300) + (id div 500) * 9000) as ts"
    )


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_rate_limit_equals_replay(spark, limit):
    df = limiter_input(spark)
    rows = [(r["id"], r["k"], r["t"]) for r in df.selectExpr("id", "k", "unix_micros(ts) as t").collect()]
    got = {r["id"]: r["accepted"] for r in jobs.rate_limit(df, "id", "k", "ts", limit, 60).collect()}
    assert got == replay(rows, limit, 3600_000_000)


def busy_key(spark, every):
    """Half of all requests are of one key that never rests; times of some are equal."""
    return spark.range(6_000).selectExpr(
        "id", "if(id % 2 = 0, 0, id % 7 + 1) as k", f"timestamp_micros((1700000000 + id * {every} + (id * 7919 % {4 * every}) - id % 3 * {every}) * 1000000) as ts"
    )


@pytest.mark.parametrize("limit,every", [(1, 40), (2, 600), (3, 40), (5, 1_300), (40, 40)])
def test_busy_key_is_walked_in_packs(spark, limit, every):
    df = busy_key(spark, every)
    rows = [(r["id"], r["k"], r["t"]) for r in df.selectExpr("id", "k", "unix_micros(ts) as t").collect()]
    got = jobs.rate_limit(df, "id", "k", "ts", limit, 60, pack_rows=150).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["accepted"] for r in got} == replay(rows, limit, 3600_000_000)


def test_packs_are_bounded(spark):
    df = busy_key(spark, 40).selectExpr("id", "k", "unix_micros(ts) as __t").withColumn("slice", F.floor(F.col("__t") / 60_000_000)).withColumn("part", F.lit(1).cast("long"))
    packs = jobs._packs(df, "id", "k", 60, 150)
    sizes = [(r["k"], r["n"]) for r in packs.select("k", F.size("times").alias("n")).collect()]
    assert max(n for _, n in sizes) <= 300 and sum(n for _, n in sizes) == 6_000
    assert sum(k == 0 for k, _ in sizes) >= 15
    first = jobs._entries(packs, "k", 3, 3600_000_000)
    assert first[0].count() == len(sizes) and first[1] <= sum(k == 0 for k, _ in sizes) + 1


def test_window_count_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (2, 3600), (3, 3601), (4, 7000)], "id int, s bigint").selectExpr("id", "1 as k", "timestamp_seconds(s) as ts")
    got = {r["id"]: r["window_count"] for r in jobs.window_counts(df, "k", "ts", 60).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}


def test_no_row_is_lost_in_ranks(spark):
    df = spark.range(2000).select("id", F.lit(1.0).alias("s"))
    got = global_row_number(df, [("s", "desc"), ("id", "asc")], rows_per_bucket=100)
    assert got.where("rn <> id + 1").count() == 0


def test_quantiles_with_infinite_and_missing_values(spark):
    values = [float("-inf")] * 40 + [float("inf")] * 60 + [float("nan")] * 30 + [float(k % 97) for k in range(900)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 20, "a double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.97, 1.0]
    assert exact_quantiles(df, ["a"], probs, small=100) == exact_quantiles(df, ["a"], probs)


@pytest.mark.parametrize("rows_per_bucket", [100, 10**6])
def test_ranks_with_text_and_mixed_tie_breakers(spark, rows_per_bucket):
    df = spark.range(900).selectExpr("id", "if(id % 3 = 0, 7.5, cast(id % 11 as double)) as s", "concat('name ', id % 13) as t", "if(id % 50 = 0, null, id % 5) as u").repartition(5)
    got = global_row_number(df, [("s", "desc"), ("t", "asc"), ("u", "desc"), ("id", "asc")], rows_per_bucket=rows_per_bucket)
    want = sorted(df.collect(), key=lambda r: (-r["s"], r["t"], r["u"] is None, -(r["u"] or 0), r["id"]))
    assert [r["id"] for r in got.orderBy("rn").collect()] == [r["id"] for r in want]
    text = global_row_number(df.select("t"), [("t", "desc")], rows_per_bucket=rows_per_bucket)
    assert sorted(r["rn"] for r in text.collect()) == list(range(1, 901))


def test_fingerprint_tells_cells_apart(spark):
    def print_of(rows, kinds="a string, b string"):
        return quality.dataset_fingerprint(spark.createDataFrame(rows, kinds)).first()["fingerprint"]

    texts = [[("a|b", "c")], [("a", "b|c")], [("a", None)], [("a", "~")], [("a", "-")], [("a", "")]]
    assert len({print_of(r) for r in texts}) == len(texts)
    numbers = [[(x, "t")] for x in (1e13, 1e300, float("inf"), float("-inf"), None, 1e-7, 2e-7, 0.0)]
    assert len({print_of(r, "a double, b string") for r in numbers}) == len(numbers)
    assert print_of([(float("nan"), "t")], "a double, b string") == print_of([(None, "t")], "a double, b string")
    odd = spark.createDataFrame([(float("nan"), "x"), (1e13, "y"), (None, "z")], "a double, b string")
    assert quality.dataset_profile(odd).first()["n_rows"] == 3


def test_correlation_of_many_columns(spark):
    """Against a plain pairwise calculation, with gaps, constant columns and large offsets; one scan for any width."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 130))
    base[:, 1] = base[:, 0] * -2 + 1e6
    base[:, 2] += 1e9
    base[:, 3] = 0.1
    base[rng.random(base.shape) < 0.1] = np.nan
    base[:, 4] = np.nan
    names = [f"a b{i}" if i == 7 else f"x{i}" for i in range(130)]
    df = spark.createDataFrame(pd.DataFrame(base, columns=names)).repartition(5)
    got = {(r["earlier"], r["later"]): r["corr"] for r in features.correlation_pairs(df, names).collect()}
    assert len(got) == 130 * 129 // 2
    want = pd.DataFrame(base, columns=names).corr()
    for (a, b), value in got.items():
        assert (value is None) == (bool(np.isnan(want.loc[a, b])) or "x3" in (a, b)), (a, b)
        assert value is None or value == pytest.approx(want.loc[a, b], abs=1e-7)
    assert features.select_correlation(df, ["x0", "x1", "x2"]) == ["x0", "x2"]
    assert features.correlation_pairs(df, names[:1]).collect() == []
    none = features.correlation_pairs(df.where("false"), ["x0", "x2"]).collect()
    assert [tuple(r) for r in none] == [("x0", "x2", None)]


def wide_table(spark):
    """300 text columns: dates, few values, many values, long text, and some empty for the first thousand rows."""
    shapes = ["concat('2024-01-', lpad(id % 28 + 1, 2, '0'))", "concat('k', id % 7)", "concat('u', id)", "concat('long and longer text ', id)", "if(id < 1000, null, concat('late text of some words ', id))", "concat('v', id % 200)"]
    return spark.range(2_000).select("id", *[F.expr(shapes[i % 6]).alias(f"c{i}") for i in range(300)]).repartition(4)


def test_profile_of_a_wide_table_takes_few_jobs(spark):
    df = wide_table(spark)
    context = spark.sparkContext
    context.setJobGroup("wide", "profile of many columns")
    try:
        kinds = quality.type_map(df, "id")
        jobs_run = len(context.statusTracker().getJobIdsForGroup("wide"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert [kinds[f"c{i}"] for i in range(6)] == ["datetime", "categorical", "categorical", "text", "text", "categorical"]
    assert all(kinds[f"c{i}"] == kinds[f"c{i % 6}"] for i in range(300))
    assert jobs_run < 40


def test_distinct_counts_are_exact_on_both_paths(spark, monkeypatch):
    df = wide_table(spark).withColumn("x", F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") % 90))
    names = ["c0", "c1", "c2", "c4", "c5", "x"]
    want = {"c0": 28, "c1": 7, "c2": 2_000, "c4": 1_000, "c5": 200, "x": 60}
    assert quality.distinct_counts(df, names) == want
    monkeypatch.setattr(quality, "SET_VALUES", 100)
    assert quality.distinct_counts(df, names) == want
    # at the border of a tenth the sketch does not decide
    for n, kind in ((200, "text"), (199, "categorical")):
        rows = spark.range(2_000).selectExpr("id", f"concat('a value of more than twenty ', id % {n}) as c")
        assert quality.type_map(rows, "id")["c"] == kind
    assert quality.type_map(df.where("false"), "id")["c3"] == "categorical" and quality.task_types(df.where("false"), ["x"]).first()["n_unique"] == 0


def test_first_values_skip_missing_cells(spark):
    df = wide_table(spark).select("id", "c3", "c4")
    got: dict = {}
    for r in quality.first_values(df, "id", ["c3", "c4"]).collect():
        got.setdefault(r["column_name"], set()).add(r["value"])
    assert got == {"c3": {f"long and longer text {i}" for i in range(10)}, "c4": {f"late text of some words {i}" for i in range(1000, 1010)}}


def test_permuted_places_are_a_bijection(spark):
    seen = set()
    for n in [*range(1, 40), 99, 100, 101, 1_000, 9_973]:
        got = [r["to"] for r in spark.range(n).select(permuted(F.col("id"), n, permutation_keys(n)).alias("to")).collect()]
        assert sorted(got) == list(range(n))
        if n > 900:
            assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1 and sum(i == g for i, g in enumerate(got)) < 12
    for seed in range(5):
        seen.add(tuple(r["to"] for r in spark.range(50).select(permuted(F.col("id"), 50, permutation_keys(seed)).alias("to")).collect()))
    assert len(seen) == 5


def test_permutation_importance_moves_every_value(spark):
    """Each repeat holds every value of the feature once, and other features stay."""
    df = spark.range(300).selectExpr("id", "cast(id as double) as a", "if(id % 5 = 0, null, id * 2.0) as b", "id * 3.0 as y")
    seen = []

    def predict(rows):
        if "repeat" in rows.columns:
            seen.append(rows.groupBy("feature", "repeat").agg(F.sort_array(F.collect_list("a")).alias("a"), F.sort_array(F.collect_list("b")).alias("b"), F.sum(F.when(F.col("a") == F.col("id"), 1)).alias("own")).collect())
        return rows.withColumn("pred", F.col("a") * 3)

    got = {r["feature"]: r for r in explain.permutation_importance(df, "id", ["a", "b"], "y", predict, repeats=3).collect()}
    assert got["b"]["importance"] == 0 and got["a"]["importance"] > 1
    assert len(seen[0]) == 6
    for r in seen[0]:
        assert r["a"] == [float(i) for i in range(300)] and sorted(x for x in r["b"] if x is not None) == [2.0 * i for i in range(300) if i % 5]
        assert r["own"] == 300 if r["feature"] == "b" else (r["own"] or 0) < 20


def test_vocabulary_as_a_table_gives_the_same_weights(spark):
    rows = spark.range(300).selectExpr("id", "if(id % 50 = 0, null, concat('café term', id % 7, ' word', id % 40, ' ', 'same same \u65e5\u672c t', id)) as t")
    some = textfeatures.fit_tfidf(rows, [F.col("t")], 10_000, 1, bigrams=True)
    table = textfeatures.fit_tfidf(rows, [F.col("t")], None, 1, bigrams=True)
    assert isinstance(table, textfeatures.TermTable) and table.rows.count() == len(some.terms) > 500
    both = [{(r["id"], r["feature"], r["term"]): r["weight"] for r in textfeatures.apply_tfidf(rows, "id", F.col("t"), v).collect()} for v in (some, table)]
    assert both[0].keys() == both[1].keys() and all(both[1][k] == pytest.approx(w) for k, w in both[0].items())
    with pytest.raises(ValueError):
        textfeatures.tfidf_columns(rows, "id", F.col("t"), table, "t_")


def test_a_million_values_are_not_collected(spark):
    df = spark.range(1_000_000).selectExpr("id", "concat('v', id) as c", "id % 3 as d")
    with pytest.raises(ValueError, match="c"):
        encode.fit_onehot(df, ["d", "c"])
    assert encode.onehot_cells(df, "id", ["c", "d"]).count() == 2_000_000
    assert encode.fit_onehot(df, ["d"])["d"]["columns"] == ["0", "1", "2"]
    table = textfeatures.fit_tfidf(df.where("id < 200000"), [F.col("c")], None, 1)
    assert isinstance(table, textfeatures.TermTable) and table.rows.agg(F.max("feature")).first()[0] == 199_999


def test_only_pairs_of_frequent_words_are_counted(spark, monkeypatch):
    """The vocabulary is that of all pairs, though pairs with a word below the last place are not counted."""
    rows = [(k, " ".join(f"w{(k * k + j * j * 7) % (3 + j % 40)}x" for j in range(k % 50))) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, text string")
    counted = []
    plain_counts = textfeatures._counts
    monkeypatch.setattr(textfeatures, "_counts", lambda corpus: counted.append(plain_counts(corpus)) or counted[-1])
    fit = lambda n: textfeatures.fit_tfidf(df, [F.col("text")], n, 2, 0.9, bigrams=True)
    few = {n: fit(n) for n in (5, 20, 10_000)}
    assert counted[1].count() < counted[-1].count() / 4
    monkeypatch.setattr(textfeatures, "LISTED", 0)
    assert few == {n: fit(n) for n in few}
    assert any(" " in t for t in few[20].terms)


def test_perceptron_gradient_is_that_of_its_loss():
    rng, sizes = np.random.default_rng(5), [3, 4, 2, 3]
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 3, 20), rng.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 2 * 3 + 3)
    steps = 1e-6 * np.eye(len(w))
    slopes = [(perceptron.loss_and_gradient(w + s, sizes, x, y)[0] - perceptron.loss_and_gradient(w - s, sizes, x, y)[0]) / 2e-6 for s in steps]
    assert perceptron.loss_and_gradient(w, sizes, x, y)[1] == pytest.approx(np.array(slopes), abs=1e-5)


def test_perceptron_on_blocks_equals_sparks(spark, monkeypatch):
    df = spark.range(900).selectExpr("cast((id * 37) % 101 as double) / 50 - 1 as a", "cast((id * 53) % 89 as double) / 44 - 1 as x")
    df = df.withColumn("y", F.when(F.col("a") * F.col("a") + F.col("x") * F.col("x") < 0.5, 0).when(F.col("a") > 0, 1).otherwise(2))
    fit = lambda rows: models.fit_model(rows, ["a", "x"], "y", "mlp", "classification", {"hidden_layer_sizes": "6,4", "max_iter": 60})
    rows = df.cache()
    want = fit(rows)
    taken = []
    monkeypatch.setattr(models, "BLOCKED_ROWS", 100)
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 16)
    weights = perceptron.fit_weights
    monkeypatch.setattr(perceptron, "fit_weights", lambda *a: taken.append(weights(*a)) or taken[-1])
    got = fit(rows)
    assert len(taken) == 1 and got.stages[-1].weights.toArray() == pytest.approx(taken[0])
    share = [models.predict(rows, m, ["y"]).agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0] for m in (want, got)]
    assert share[1] > 0.8 and share[1] > share[0] - 0.05
    # Spark's value of its own weights, and of those fitted on blocks
    value = [m.stages[-1].summary().objectiveHistory[-1] for m in (want, got)]
    assert value[1] < value[0] + 0.05
    # missing values stay with Spark's fit
    assert models.fit_perceptron(models.make_estimator("mlp", "classification", "y", n_inputs=2, n_classes=3), rows.withColumn("x", F.when(F.col("y") != 2, F.col("x"))), ["a", "x"], "y", 900) is None
