"""Randomised and model-based operators: properties instead of values."""

import pytest
from pyspark.sql import functions as F

from loomframe.operators import encode, ensemble, explain, features, iforest, impute, metrics, models, outliers, preprocess, quality, scale, scoring, split, textfeatures, validate
from loomframe.session import scratch_path, table
from loomframe.sources import catalog, tables


@pytest.fixture(scope="module")
def parts(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("size"), F.char_length("p_name").cast("double").alias("length"))


def test_forest_flags_the_contamination_share(spark, parts):
    a = iforest.isolation_forest(parts, "p_partkey", ["size", "y"], trees=20)
    b = iforest.isolation_forest(parts.repartition(7), "p_partkey", ["size", "y"], trees=20)
    assert abs(a.where("outlier").count() - parts.count() * 0.1) <= 1
    assert a.select("p_partkey", F.round("score", 9)).exceptAll(b.select("p_partkey", F.round("score", 9))).count() == 0


def test_forest_finds_the_far_point(spark):
    df = spark.range(500).selectExpr("id", "if(id = 7, 1000.0, id % 10) as x")
    assert iforest.isolation_forest(df, "id", ["x"], trees=30).orderBy(F.desc("score")).first()["id"] == 7


def test_reloaded_model_predicts_the_same(spark, parts):
    model = models.fit_model(parts, ["size", "length"], "y", "random_forest", "regression", {"n_estimators": 3})
    path = scratch_path(spark, "m")
    catalog.save_model(model, path)
    again = catalog.load_model(path)
    assert models.predict(parts, model, ["p_partkey"]).exceptAll(models.predict(parts, again, ["p_partkey"])).count() == 0
    assert any(name == "numTrees" for _, name, _ in models.step_listing(again))


@pytest.mark.parametrize("family", ["logistic_regression", "random_forest", "gradient_boosting", "mlp", "boosted_preset"])
def test_classifiers_give_probabilities(spark, parts, family):
    rows = parts.withColumn("label", (F.col("size") > 25).cast("int"))
    small = {"n_estimators": 3, "max_iter": 10, "hidden_layer_sizes": "4"}
    out = models.predict(rows, models.fit_model(rows, ["size", "length"], "label", family, "classification", small), ["label"])
    assert out.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    assert metrics.accuracy(out, "label").first()[0] > 0.5


def test_search_keeps_failures_and_order(spark, parts):
    trials = {"linear_regression": models.sample_trials("linear_regression", 2), "mlp": [{}]}
    got = models.random_search(parts, "p_partkey", ["size", "length"], "y", "regression", trials, k=2).collect()
    status = {r["trial_id"]: r["status"] for r in got}
    assert status[0] == status[1] == "completed" and status[2].startswith("failed")
    assert all(len(r["cv_scores"]) == 2 for r in got if r["status"] == "completed")
    assert [r["score"] for r in got if r["trial_id"] == 2] == [None] and "classifier only" in status[2]
    late = models.random_search(parts, "p_partkey", ["size"], "y", "regression", trials, k=2, deadline_seconds=-1).collect()
    assert len(late) == 3 and all(r["status"].startswith("skipped") and r["score"] is None for r in late)


CLASS_METRICS = ["accuracy", "precision", "recall", "f1", "f1_macro", "f1_weighted", "auc", "balanced_accuracy", "auto"]


@pytest.mark.parametrize("family", ["logistic_regression", "random_forest", "gradient_boosting", "knn", "mlp"])
def test_search_on_text_targets(spark, parts, family):
    """Every family searches a text label, with a ranking metric and, where it can, class weights."""
    rows = parts.withColumn("label", F.when(F.col("size") > 25, "large").otherwise("small"))
    small = {"n_estimators": 3, "max_iter": 10, "hidden_layer_sizes": "4"}
    balance = family in ("logistic_regression", "random_forest")
    got = models.random_search(rows, "p_partkey", ["size", "length"], "label", "classification", {family: [small]}, "auc", k=2, balance_classes=balance).first()
    assert got["status"] == "completed" and got["score"] > 0.7


def test_search_with_every_metric(spark, parts):
    rows = parts.withColumn("label", F.when(F.col("size") > 35, 2).when(F.col("size") > 15, 1).otherwise(0)).cache()
    for metric in CLASS_METRICS:
        got = models.random_search(rows, "p_partkey", ["size", "length"], "label", "classification", {"knn": [{}]}, metric, k=2).first()
        assert got["status"] == "completed" and got["score"] > 0.5, metric
    for metric in ("mae", "mse", "rmse", "r2", "auto"):
        got = models.random_search(parts, "p_partkey", ["size", "length"], "y", "regression", {"linear_regression": [{}]}, metric, k=2).first()
        assert got["status"] == "completed" and got["metric"] == ("r2" if metric == "auto" else metric)


def test_labels_must_be_class_numbers(spark, parts):
    with pytest.raises(ValueError, match="not class numbers"):
        models.fit_model(parts.withColumn("label", F.lit(1.5)), ["size"], "label", "random_forest", "classification")


@pytest.mark.parametrize("family", ["random_forest", "gradient_boosting"])
def test_models_do_not_depend_on_the_layout(spark, parts, family):
    params = {"n_estimators": 4, "subsample": 0.5, "max_depth": 4}
    made = []
    for layout in (parts.coalesce(1), parts.repartition(4), parts.repartition(8, "length")):
        model = models.fit_model(layout, ["size", "length"], "y", family, "regression", params)
        made.append([round(r["pred"], 9) for r in models.predict(parts, model, ["p_partkey"]).orderBy("p_partkey").collect()])
    assert made[0] == made[1] == made[2]


def test_trials_are_seeded_and_in_range():
    a, b = models.sample_trials("random_forest", 20, 7), models.sample_trials("random_forest", 20, 7)
    assert a == b and all(10 <= t["n_estimators"] <= 500 and 3 <= t["max_depth"] <= 30 for t in a)


def test_stack_and_blend(spark, parts):
    bases = {"a": ("linear_regression", {}), "b": ("random_forest", {"n_estimators": 2})}
    stacked = ensemble.stack(parts, "p_partkey", ["size", "length"], "y", "regression", bases, k=2)
    assert stacked.count() == parts.count() and stacked.select("p_partkey").distinct().count() == parts.count()


def test_sampled_attributions_add_up(spark, parts):
    """Contributions sum to the prediction minus the mean background score."""
    model = models.fit_model(parts, ["size", "length"], "y", "linear_regression", "regression")
    got = explain.sampled_attributions(parts, "p_partkey", ["size", "length"], model, lambda d: F.col("prediction"), samples=4)
    sums = got.groupBy("p_partkey").agg(F.sum("contribution").alias("s"))
    scored = model.transform(parts).select("p_partkey", "prediction").join(sums, "p_partkey")
    gap = scored.agg(F.max(F.col("prediction") - F.col("s")).alias("a"), F.min(F.col("prediction") - F.col("s")).alias("b")).first()
    assert gap["a"] == pytest.approx(gap["b"], abs=1e-6)


def test_importance_sums_to_one(spark, parts):
    model = models.fit_model(parts, ["size", "length"], "y", "random_forest", "regression", {"n_estimators": 3})
    assert explain.builtin_importance(spark, model, ["size", "length"]).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_stored_state_scores_the_same(spark, sf):
    orders = table(spark, sf, "orders")
    state = preprocess.fit_preprocessor(orders, "o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "state")
    catalog.save_preprocessor(spark, state, path)
    again = catalog.load_preprocessor(spark, path)
    assert preprocess.apply_preprocessor(orders, state).exceptAll(preprocess.apply_preprocessor(orders, again)).count() == 0


def test_scoring_applies_the_preprocessor(spark, sf):
    orders = table(spark, sf, "orders").withColumn("label", (F.col("o_totalprice") > 250000).cast("int")).drop("o_orderstatus")
    state = preprocess.fit_preprocessor(orders, "o_orderkey", "label")
    model = models.fit_model(preprocess.apply_preprocessor(orders, state), state.output_names(), "label", "logistic_regression", "classification", {"max_iter": 10})
    unseen = orders.drop("label").withColumn("o_orderpriority", F.lit("never seen"))
    out = scoring.score(unseen, model, "o_orderkey", state, 2)
    assert out.count() == orders.count() and out.where("probability_class_0 is null").count() == 0


# edge cases


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, x double, s string")
    assert quality.missing_summary(df).where("column_name = '(all)'").first()["ratio"] == 0
    assert quality.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert outliers.iqr_counts(df, ["x"]).first()["n_outliers"] == 0
    assert impute.fit_imputer(df, ["x"], ["s"]) == {"x": None, "s": None}
    assert quality.dataset_profile(df).first()["n_rows"] == 0


def test_nan_and_null_are_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)], "id int, x double")
    got = {r["column_name"]: r["missing"] for r in quality.missing_summary(df).collect()}
    assert got["x"] == 2
    assert impute.fit_imputer(df, ["x"], [], "mean")["x"] == 2.0
    assert [r["x"] for r in impute.apply_imputer(df, {"x": 2.0}).orderBy("id").collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r["x"] for r in validate.coerce_fill(df, ["x"]).orderBy("id").collect()] == [1.0, 0.0, 0.0, 3.0]


def test_flat_columns(spark):
    df = spark.range(10).selectExpr("id", "5.0D as x")
    assert scale.fit_scaler(df, ["x"], "standard")["x"] == (5.0, 1.0)
    assert {r["x"] for r in scale.apply_scaler(df, scale.fit_scaler(df, ["x"], "minmax")).collect()} == {0.0}
    assert outliers.iqr_fences(df, ["x"]) == {} and outliers.zscore_tests(df, ["x"]) == {}
    assert not features.select_variance(df, ["x"]).first()["selected"]


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    hot = encode.apply_onehot(new, encode.fit_onehot(train, ["c"])).collect()
    assert sorted(map(tuple, hot)) == [(0, 0), (1, 0)]
    with pytest.raises(Exception, match="unknown category"):
        encode.apply_onehot(new, encode.fit_onehot(train, ["c"]), unknown="error").collect()
    with pytest.raises(Exception, match="unknown category"):
        encode.apply_ordinal(new, "c", encode.fit_ordinal(train, "c")).collect()


def test_single_class(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (1, 1, 0.4)], "y int, pred int, p double")
    assert metrics.auc_binary(df).count() == 0
    assert metrics.prf_binary(df).count() == 0
    assert split.class_weights(df, "y").first()["weight"] == 1.0


def test_polynomial_cap_keeps_the_widest_terms(spark):
    df = spark.range(50).selectExpr("id", "cast(id as double) as a", "id / 100.0D as b")
    out = features.polynomial_features(df, ["a", "b"], max_features=2)
    assert "a^2" in out.columns and "b^2" not in out.columns


def test_vocabulary_counts_words_once_per_document(spark):
    df = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum"), (3, None), (4, "")], "id int, t string")
    v = textfeatures.fit_tfidf(df, [F.col("t")], 10, 1)
    rows = {(r["id"], r["term"]): r["weight"] for r in textfeatures.apply_tfidf(df, "id", F.col("t"), v).collect()}
    assert set(rows) == {(1, "apple"), (1, "pear"), (2, "apple"), (2, "plum")}
    assert sum(w * w for (i, _), w in rows.items() if i == 1) == pytest.approx(1.0)
    wide = textfeatures.tfidf_columns(df, "id", F.col("t"), v, "t_").where("id = 1").first()
    assert wide[f"t_{v.terms.index('apple')}"] == pytest.approx(rows[(1, "apple")])


def test_parsed_text_dates(spark):
    df = spark.createDataFrame([("due 2024-03-05",), ("03/05/2024",), ("none",)], "d string")
    got = [tuple(r)[:3] for r in features.expand_datetime(df, ["d"]).collect()]
    assert got == [(2024, 3, 5), (2024, 3, 5), (None, None, None)]


def test_unique_names():
    assert tables.unique_names(["a", "b", "a", "a", "a_1"]) == ["a", "b", "a_2", "a_3", "a_1"]


def test_formats(spark, sf):
    nation = table(spark, sf, "nation")
    base = scratch_path(spark, "formats")
    for suffix in ("csv", "json", "parquet", "feather"):
        tables.write_table(nation, f"{base}/n.{suffix}")
        assert tables.infer_format(spark, f"{base}/n.{suffix}") == {"feather": "arrow"}.get(suffix, suffix)
        assert tables.read_table(spark, f"{base}/n.{suffix}").count() == 25
    tables.write_table(nation, f"{base}/bare", "arrow")
    assert tables.infer_format(spark, f"{base}/bare") == "arrow"
    odd = spark.createDataFrame([(1, 'a "quoted", text\nwith lines'), (2, ""), (3, None)], "id int, s string")
    tables.write_table(odd, f"{base}/odd.csv")
    back = {r["id"]: r["s"] for r in tables.read_table(spark, f"{base}/odd.csv", schema=odd.schema, multi_line=True).collect()}
    assert back == {1: 'a "quoted", text\nwith lines', 2: "", 3: None}


def test_explains_single_rows_of_a_fitted_classifier(spark, parts):
    rows = parts.withColumn("label", (F.col("size") > 25).cast("int"))
    model = models.fit_model(rows, ["size", "length"], "label", "random_forest", "classification", {"n_estimators": 5})
    got = explain.explain_fitted(rows, "p_partkey", F.col("p_partkey") < 3, ["size", "length"], model, "classification").collect()
    assert len(got) == 6 and {r["feature"] for r in got} == {"size", "length"}
    for r in got:
        if r["feature"] == "size":
            assert (r["contribution"] > 0) == (r["value"] > 25) and abs(sum(r["probability"]) - 1) < 1e-9
    named = {(r["section"], r["name"]) for r in explain.explain_model(rows, model, ["size", "length"], "label", "classification").collect()}
    assert ("probability", "mean_probability") in named
