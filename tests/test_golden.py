"""Hand-worked values on very small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomframe.operators import encode, ensemble, history, impute, metrics, models, outliers, preprocess, quality


def test_column_types(spark):
    rows = [(i, float(i), "ABABC"[i], datetime(2023, 1, 1 + i), f"this is a fairly long text number {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "id int, numeric double, categorical string, at timestamp, text string")
    assert quality.type_map(df, "id") == {"id": "numeric", "numeric": "numeric", "categorical": "categorical", "at": "datetime", "text": "text"}


def test_text_dates_count_as_datetime(spark):
    df = spark.createDataFrame([(i, f"on 0{i + 1}/02/2023") for i in range(5)], "id int, d string")
    assert quality.type_map(df, "id")["d"] == "datetime"


def test_missing(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (2.0, None, 2), (None, "c", 3), (4.0, "d", 4), (5.0, "e", 5)], "col1 double, col2 string, col3 bigint")
    got = {r["column_name"]: (r["missing"], r["ratio"]) for r in quality.missing_summary(df).collect()}
    assert got["(all)"] == (2, pytest.approx(2 / 15))
    assert got["col1"][0] == got["col2"][0] == 1 and got["col3"][0] == 0
    assert [r["column_name"] for r in quality.missing_ranking(df).collect()] == ["col1", "col2"]


def test_iqr(spark):
    df = spark.createDataFrame([(i, float(i), float(i) if i < 10 else 100.0) for i in range(1, 11)], "id int, normal double, with_outliers double")
    assert outliers.iqr_fences(df, ["normal"])["normal"] == (-3.5, 14.5)
    got = {r["column_name"]: r["n_outliers"] for r in outliers.iqr_counts(df, ["normal", "with_outliers"]).collect()}
    assert got == {"normal": 0, "with_outliers": 1}
    rows = outliers.iqr_rows(df, "id", ["normal", "with_outliers"]).collect()
    assert [(r["id"], r["column_name"]) for r in rows] == [(10, "with_outliers")]
    assert outliers.drop_rows(df, outliers.iqr_rows(df, "id", ["with_outliers"]), "id").count() == 9


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (None, None), (4.0, "A"), (5.0, "C")], "n double, c string")
    assert impute.fit_imputer(df, ["n"], ["c"]) == {"n": 3.0, "c": "A"}
    filled = impute.apply_imputer(df, {"n": 3.0, "c": "A"})
    assert filled.where("n is null or c is null").count() == 0


def test_onehot(spark):
    df = spark.createDataFrame(list(zip("ABACB", "XYXZY")), "cat1 string, cat2 string")
    hot = encode.apply_onehot(df, encode.fit_onehot(df, ["cat1", "cat2"]))
    assert hot.columns == ["cat1_A", "cat1_B", "cat1_C", "cat2_X", "cat2_Y", "cat2_Z"]
    assert all(sum(r) == 2 for r in hot.collect())


def test_default_steps(spark):
    rows = [("a", 1, 1.1, "A", 0), ("b", 2, None, "B", 1), ("c", 3, 3.3, None, 0), ("d", 4, 4.4, "A", 1), ("e", 5, 4.4, "B", 1)]
    df = spark.createDataFrame(rows, "key string, numeric1 bigint, numeric2 double, categorical string, target int")
    state = preprocess.fit_preprocessor(df, "key", "target", impute_strategy="mean")
    assert state.fills["numeric2"] == pytest.approx(3.3)
    out = preprocess.apply_preprocessor(df, state)
    assert out.columns == ["key", "target", *state.output_names()]
    assert sorted(r["key"] for r in out.collect()) == ["a", "b", "c", "d", "e"]
    assert not any(v is None for r in out.collect() for v in r)


def preds(spark):
    rows = list(zip(range(5), [0, 1, 0, 1, 1], [0, 1, 0, 1, 0], [0.2, 0.8, 0.1, 0.9, 0.7]))
    return spark.createDataFrame(rows, "id int, y int, pred int, p double")


def test_classification_metrics(spark):
    df = preds(spark)
    assert metrics.accuracy(df).first()[0] == pytest.approx(0.8)
    assert metrics.balanced_accuracy(df).first()[0] == pytest.approx(0.833333, abs=1e-6)
    assert tuple(metrics.prf_weighted(df).first()) == pytest.approx((0.866667, 0.8, 0.8), abs=1e-6)
    assert metrics.f1_macro(df).first()[0] == pytest.approx(0.8)
    assert tuple(metrics.prf_binary(df).first()) == pytest.approx((1, 0.666667, 0.8), abs=1e-6)
    assert metrics.auc_binary(df).first()[0] == 1.0


def test_regression_metrics(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 1.9, 3.1, 3.9, 5.1])), "y double, pred double")
    assert tuple(metrics.regression_errors(df).first()) == pytest.approx((0.1, 0.01, 0.1, 0.995))
    r = metrics.residual_statistics(df).first()
    assert (r["residual_mean"], r["residual_std"]) == pytest.approx((-0.02, 0.109545), abs=1e-6)
    assert (r["prediction_mean"], r["prediction_std"]) == pytest.approx((3.02, 1.584929), abs=1e-6)


def test_cv_and_weights(spark):
    row = models.cv_summary(models.cv_table(spark, [0.9, 0.85, 0.95]), []).first()
    assert (row["cv_mean"], row["cv_std_log"]) == pytest.approx((0.9, 0.05))
    scores = spark.createDataFrame([("logistic", 0.85), ("forest", 0.82)], "model string, score double")
    got = ensemble.score_weights(scores)
    assert (got["logistic"], got["forest"]) == pytest.approx((0.508982, 0.491018), abs=1e-6)
    zero = ensemble.score_weights(scores.withColumn("score", F.lit(0.0)))
    assert sum(zero.values()) == pytest.approx(1.0)


def test_similarity(spark):
    run = spark.createDataFrame(
        [("r", "classification", 100, 5, 5, 0, 0.0, 1.0)],
        "run_id string, task_type string, n_rows int, n_features int, n_numeric int, n_categorical int, missing_ratio double, class_balance double",
    )
    profile = {"task_type": "classification", "n_rows": 100, "n_features": 6, "n_numeric": 5, "n_categorical": 0, "missing_ratio": 0.0, "class_balance": 1.0}
    assert history.similar_runs(run, profile, 1).first()["similarity"] == pytest.approx(0.962963, abs=1e-6)


def test_leaderboard(spark):
    df = spark.createDataFrame([(0, "rf", 0.82, "completed"), (1, "lr", 0.85, "completed"), (2, "x", 0.99, "failed")], "trial_id int, model_type string, score double, status string")
    got = history.leaderboard_rank(df).orderBy("rank").collect()
    assert [(r["rank"], r["score"]) for r in got] == [(1, 0.85), (2, 0.82)]


def test_warm_start_bounds():
    base = {"C": 0.0005, "penalty": "l1", "max_iter": 1500, "note": "kept"}
    trials = models.warmstart_trials(base, "logistic_regression", 8)
    assert len(trials) == 8 and trials[0] == base
    assert all(0.001 <= t["C"] <= 1000 and 100 <= t["max_iter"] <= 2000 and isinstance(t["max_iter"], int) for t in trials[1:])
    assert all(t["penalty"] == "l1" and t["note"] == "kept" for t in trials)
    assert abs(trials[1]["max_iter"] - 1500) <= 0.1 * 1900 + 1
    assert models.warmstart_trials(None, "knn") == []


def test_declared_ranges():
    whole, log = models.Span(1, 5, whole=True), models.Span(0.01, 100, log=True)
    assert [whole.at(s) for s in (0, 0.5, 1)] == [1, 3, 5] and whole.share(9) == 1
    assert abs(log.at(0.5) - 1) < 1e-12 and abs(log.share(0.1) - 0.25) < 1e-12
    draws = models.sample_trials("knn", 30, space={"a": whole, "b": models.Choice(("x", None))})
    assert {d["a"] for d in draws} <= {1, 2, 3, 4, 5} and {d["b"] for d in draws} == {"x", None}
