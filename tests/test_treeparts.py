"""Attributions of tree models against all coalitions of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomframe.operators import models, treeparts

NAMES = ["a", "b", "c", "d"]


def table(spark):
    return spark.range(600).selectExpr(
        "id", "cast(id * 7919 % 101 as double) as a", "if(id % 11 = 0, double('nan'), cast(id * 31 % 17 as double)) as b", "if(id % 13 = 0, null, cast(id % 5 as double)) as c",
        "cast(id * 104729 % 1009 as double) / 100 as d",
    ).selectExpr("*", "coalesce(nanvl(a * 2 + b * c + if(d > 5, 30, 0), 7.0), 11.0) as y", "cast(id * 7919 % 101 > 40 as double) as two", "cast(id * 31 % 17 % 3 as double) as three")


def game(nodes, x, coalition, value):
    """Output of one tree where features outside the coalition follow both sides."""

    def at(i):
        node = nodes[i]
        if node["leftChild"] < 0:
            return value(node)
        f, threshold = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        left, right = node["leftChild"], node["rightChild"]
        if f in coalition:
            return at(left) if x[f] <= threshold else at(right)
        n, m = nodes[left]["rawCount"], nodes[right]["rawCount"]
        return (at(left) * n + at(right) * m) / (n + m)

    return at(0)


def brute(spark, fitted, x, weights, value):
    trees: dict = {}
    for row in treeparts.node_table(spark, fitted).collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row.asDict(recursive=True)
    n, out = len(x), np.zeros(len(x))
    total = lambda s: sum(weights[k] * game(nodes, x, s, value) for k, nodes in trees.items())
    for j in range(n):
        others = [i for i in range(n) if i != j]
        for size in range(n):
            for s in combinations(others, size):
                out[j] += factorial(size) * factorial(n - 1 - size) / factorial(n) * (total({*s, j}) - total(set(s)))
    return total(set()), out


CASES = [
    ("random_forest", "regression", "y", {"n_estimators": 3, "max_depth": 4}),
    ("random_forest", "classification", "three", {"n_estimators": 4, "max_depth": 3}),
    ("gradient_boosting", "regression", "y", {"n_estimators": 4, "max_depth": 2}),
    ("gradient_boosting", "classification", "two", {"n_estimators": 3, "max_depth": 3}),
]


@pytest.mark.parametrize("family,task,label,params", CASES)
@pytest.mark.parametrize("tabled", [8, 0])
def test_against_all_coalitions(spark, monkeypatch, family, task, label, params, tabled):
    monkeypatch.setattr(treeparts, "TABLE_FEATURES", tabled)
    df = table(spark)
    model = models.fit_model(df.na.drop(subset=NAMES), NAMES, label, family, task, params)
    fitted, target = model.stages[-1], 1
    got = treeparts.tree_attributions(df, "id", NAMES, model, target).collect()
    assert len(got) == 600 * len(NAMES)
    rows = {r["id"]: r for r in df.collect()}
    parts: dict = {}
    for r in got:
        parts.setdefault(r["id"], {})[r["feature"]] = r
    classes = family == "random_forest" and task == "classification"
    value = (lambda n: n["impurityStats"][target] / sum(n["impurityStats"])) if classes else (lambda n: n["prediction"])
    weights = [1 / params["n_estimators"]] * params["n_estimators"] if family == "random_forest" else [w * (2 if task == "classification" else 1) for w in fitted.treeWeights]
    for i in (0, 1, 11, 13, 143, 400):
        x = [float("nan") if rows[i][c] is None else rows[i][c] for c in NAMES]
        base, want = brute(spark, fitted, x, weights, value)
        assert [parts[i][c]["contribution"] for c in NAMES] == pytest.approx(want, abs=1e-9)
        assert parts[i]["a"]["base"] == pytest.approx(base)
    scored = model.transform(df)
    output = vector_to_array("probability")[target] if task == "classification" else F.col("prediction")
    for r in scored.select("id", output.alias("out")).collect():
        own = parts[r["id"]]
        total = own["a"]["base"] + sum(own[c]["contribution"] for c in NAMES)
        assert total == pytest.approx(own["a"]["output"])
        assert (1 / (1 + np.exp(-total)) if family == "gradient_boosting" and task == "classification" else total) == pytest.approx(r["out"], abs=1e-9)


def test_chosen_rows_single_nodes_and_other_models(spark):
    df = table(spark)
    flat = models.fit_model(df.na.drop(subset=NAMES).withColumn("y", F.lit(3.0)), NAMES, "y", "random_forest", "regression", {"n_estimators": 2, "max_depth": 3})
    got = treeparts.tree_attributions(df, "id", NAMES, flat, wanted=F.col("id") < 3).collect()
    assert len(got) == 12 and all((r["base"], r["output"], r["contribution"]) == (3.0, 3.0, 0.0) for r in got)
    assert treeparts.tree_attributions(df.where("false"), "id", NAMES, flat).collect() == []
    with pytest.raises(ValueError):
        treeparts.tree_attributions(df, "id", NAMES, models.fit_model(df.na.fill(0.0), NAMES, "y", "linear_regression", "regression"))
