"""Model families on Spark ML, search spaces, cross-validation and trials."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from loomframe.operators import encode, metrics, neighbours, perceptron, quality, split
from loomframe.session import materialize

# Search ranges per model family.
# (kind, low, high) for numbers, ("choice", values) for the rest.
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "logistic_regression": {
        "C": ("log", 0.001, 1000.0),
        "penalty": ("choice", ["l1", "l2"]),
        "max_iter": ("int", 100, 2000),
    },
    "linear_regression": {"fit_intercept": ("choice", [True, False])},
    "random_forest": {
        "n_estimators": ("int", 10, 500),
        "max_depth": ("int", 3, 30),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", ["sqrt", "log2", None]),
        "bootstrap": ("choice", [True, False]),
    },
    "gradient_boosting": {
        "n_estimators": ("int", 10, 500),
        "learning_rate": ("log", 0.01, 0.3),
        "max_depth": ("int", 3, 15),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
        "subsample": ("float", 0.5, 1.0),
        "max_features": ("choice", ["sqrt", "log2", None]),
    },
    "knn": {
        "n_neighbors": ("int", 3, 50),
        "weights": ("choice", ["uniform", "distance"]),
        "metric": ("choice", ["euclidean", "manhattan", "minkowski"]),
        "p": ("int", 1, 3),
    },
    "mlp": {
        "hidden_layer_sizes": ("choice", ["50", "100", "50,50", "100,50", "100,100", "50,50,50", "100,50,25", "200,100"]),
        "learning_rate_init": ("log", 0.0001, 0.1),
        "max_iter": ("int", 200, 2000),
    },
    "boosted_preset": {
        "n_estimators": ("int", 10, 1000),
        "max_depth": ("int", 3, 15),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.5, 1.0),
    },
}

# Defaults of the families.
DEFAULTS: dict[str, dict] = {
    "logistic_regression": {"max_iter": 5000},
    "linear_regression": {},
    "random_forest": {"n_estimators": 100},
    "gradient_boosting": {"n_estimators": 100},
    "knn": {"n_neighbors": 5},
    "mlp": {"max_iter": 1000, "hidden_layer_sizes": "100"},
    "boosted_preset": {"max_depth": 6, "learning_rate": 0.1, "n_estimators": 100, "subsample": 0.8, "max_features": "0.8"},
}


def _leaf_rows(p: dict) -> int:
    """Rows of a leaf; no node below the least size of a split can give two such leaves."""
    return max(int(p.get("min_samples_leaf", 1)), math.ceil(int(p.get("min_samples_split", 2)) / 2))


def make_estimator(family: str, task: str, label: str, params: dict | None = None, n_rows: int = 1, n_inputs: int = 1, n_classes: int = 2, seed: int = 42):
    """Spark ML estimator for a family with the family's parameter names."""
    p = {**DEFAULTS[family], **(params or {})}
    common = {"featuresCol": "features", "labelCol": label}
    classify = task == "classification"
    if family == "logistic_regression":
        return MC.LogisticRegression(
            **common,
            maxIter=int(p["max_iter"]),
            regParam=1.0 / (float(p.get("C", 1.0)) * max(n_rows, 1)),
            elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0,
            standardization=False,
        )
    if family == "linear_regression":
        return MR.LinearRegression(**common, solver="normal", fitIntercept=bool(p.get("fit_intercept", True)), standardization=False)
    subsets = {"sqrt": "sqrt", "log2": "log2", None: "all"}
    subset = subsets.get(p.get("max_features"), p.get("max_features"))
    if family == "random_forest":
        cls = MC.RandomForestClassifier if classify else MR.RandomForestRegressor
        return cls(
            **common,
            numTrees=int(p["n_estimators"]),
            maxDepth=min(30, int(p.get("max_depth", 5))),
            minInstancesPerNode=_leaf_rows(p),
            featureSubsetStrategy=subset if "max_features" in p else "auto",
            bootstrap=bool(p.get("bootstrap", True)),
            seed=seed,
        )
    if family in ("gradient_boosting", "boosted_preset"):
        options = dict(
            **common,
            maxIter=int(p["n_estimators"]),
            stepSize=float(p.get("learning_rate", 0.1)),
            maxDepth=int(p.get("max_depth", 3)),
            minInstancesPerNode=_leaf_rows(p),
            subsamplingRate=float(p.get("subsample", 1.0)),
            featureSubsetStrategy=subset,
            seed=seed,
        )
        if not classify:
            return MR.GBTRegressor(**options)
        boosted = MC.GBTClassifier(**options)
        return boosted if n_classes <= 2 else MC.OneVsRest(classifier=boosted, featuresCol="features", labelCol=label)
    if family == "mlp":
        if not classify:
            raise ValueError("the perceptron is a classifier only")
        hidden = [int(h) for h in str(p["hidden_layer_sizes"]).split(",")]
        # a learning rate asks for the solver that has one
        step = {"solver": "gd", "stepSize": float(p["learning_rate_init"])} if "learning_rate_init" in p else {}
        return MC.MultilayerPerceptronClassifier(**common, layers=[n_inputs, *hidden, n_classes], maxIter=int(p["max_iter"]), seed=seed, **step)
    raise ValueError(f"{family!r} has no Spark ML estimator")


@dataclass(frozen=True)
class Shape:
    """What a fit needs to know of its table."""

    rows: int
    classes: int


def table_shape(df: DataFrame, label: str, task: str) -> Shape:
    """Rows, and classes of a label that must be coded 0..k-1, from one aggregate."""
    value = F.col(label).cast("double")
    odd = F.count_if(value.isNull() | F.isnan(value) | (value < 0) | (value != F.floor(value)))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"), odd.alias("odd")).first()
    if task != "classification":
        return Shape(row["n"], 0)
    if row["odd"]:
        raise ValueError(f"{row['odd']} labels of {label!r} are not class numbers from 0; encode them first")
    return Shape(row["n"], int(row["top"] or 0) + 1)


#: Rows of a part when a table is laid out for fitting.
FIT_PART_ROWS = 250_000


def steady(df: DataFrame, rows: int) -> DataFrame:
    """The table in parts and an order that follow from its values and size alone.

    Trees and boosting draw their samples part by part; with this layout the same
    seed gives the same model however the table was stored, on any number of cores.
    """
    parts = max(8, -(-rows // FIT_PART_ROWS))
    return df.repartition(parts, F.xxhash64(*df.columns)).sortWithinPartitions(*df.columns)


#: Rows from which trees of a regression are fitted on groups of rows, and about how many groups there are then.
GROUPED_ROWS, GROUPS = 2_000_000, 1_000_000
#: Values up to which a feature is left to the trees' own bins; one with more is cut into as many bins as they take.
PLAIN_VALUES, TREE_BINS = 256, 32


def tree_groups(df: DataFrame, features: list[str], label: str, rows: int, draws: bool, seed: int) -> tuple[list[Bucketizer], DataFrame] | None:
    """Binning stages, and groups of rows with equal bins: their mean label and, in ``__rows``, how many they are.

    Trees see a feature by its bin, and rows with equal bins go the same way at every
    split. So the spread of their labels cancels from all gains and a group weighs as its
    rows do. Where the fit draws rows, those of equal bins are dealt into many groups at
    random, which are drawn as wholes. None where missing values or too many different
    bins leave nothing to group.
    """
    number = lambda c: F.col(f"`{c}`").cast("double")
    odd = reduce(lambda a, b: a | b, [number(c).isNull() | F.isnan(number(c)) for c in [*features, label]])
    facts = df.agg(F.count_if(odd).alias("odd"), *[F.approx_count_distinct(number(c)).alias(f"d{i}") for i, c in enumerate(features)]).first()
    if facts["odd"]:
        return None
    many = [c for i, c in enumerate(features) if facts[f"d{i}"] > PLAIN_VALUES]
    stages = []
    if many:
        shares = [i / TREE_BINS for i in range(1, TREE_BINS)]
        cuts = df.agg(*[F.percentile_approx(number(c), shares).alias(f"q{i}") for i, c in enumerate(many)]).first()
        edges = [[-math.inf, *sorted(set(q)), math.inf] for q in cuts]
        stages = [Bucketizer(splits=e, inputCol=c, outputCol=f"__bin_{c}", handleInvalid="keep") for c, e in zip(many, edges)]
    binned = [f"`__bin_{c}`" if c in many else f"`{c}`" for c in features]
    # the layout fixes which rows are drawn together
    found = PipelineModel(stages).transform(steady(df, rows) if draws else df)
    cells = PipelineModel(stages).transform(df).agg(F.approx_count_distinct(F.xxhash64(*binned))).first()[0]
    if cells > GROUPS:
        return None
    parts = max(1, GROUPS // cells) if draws else 1
    dealt = found.withColumn("__part", F.floor(F.rand(seed) * parts) if parts > 1 else F.lit(0))
    # a sum, so that trees read a bin as a number: the binning stage marks it as a category
    keys = [(F.col(b).cast("double") + F.lit(0.0)).alias(b.strip("`")) for b in binned]
    groups = dealt.groupBy(*keys, "__part").agg(F.avg(number(label)).alias(label), F.count(F.lit(1)).cast("double").alias("__rows")).drop("__part")
    return stages, materialize(groups, "fit-groups")


#: Rows from which a perceptron's gradients are summed by ``perceptron.fit_weights``.
BLOCKED_ROWS = 100_000


def fit_perceptron(estimator: MC.MultilayerPerceptronClassifier, df: DataFrame, features: list[str], label: str, rows: int) -> PipelineModel | None:
    """Spark's perceptron with weights fitted on blocks of rows, from the weights it starts with itself.

    None where missing values would pass into the weights.
    """
    odd = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) for c in features])
    if df.where(odd).limit(1).count():
        return None
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    max_iter, ready = estimator.getMaxIter(), assembler.transform(df)
    unfitted = estimator.copy().setMaxIter(0)
    start = unfitted.fit(ready.limit(1)).weights
    weights = perceptron.fit_weights(df, features, label, estimator.getLayers(), start.toArray(), rows, max_iter, estimator.getTol())
    return PipelineModel([assembler, unfitted.setInitialWeights(Vectors.dense(weights)).fit(ready)])


def fit_model(
    df: DataFrame, features: list[str], label: str, family: str, task: str, params: dict | None = None, seed: int = 42, weight: str | None = None, shape: Shape | None = None
):
    """Assemble the features and fit one model; ``weight`` names a column of row weights."""
    df = df.select(*[F.col(f"`{c}`") for c in features], label, *([weight] if weight else []))
    shape = shape or table_shape(df, label, task)
    if family == "knn":
        if weight:
            raise ValueError("k-NN takes no row weights")
        return NeighbourModel(df, features, label, task, {**DEFAULTS["knn"], **(params or {})}, shape.classes)
    n_classes = max(2, shape.classes)
    estimator = make_estimator(family, task, label, params, shape.rows, len(features), n_classes, seed)
    if weight:
        if not estimator.hasParam("weightCol"):
            raise ValueError(f"{family} takes no row weights")
        estimator = estimator.setWeightCol(weight)
    if task == "regression" and family in ("random_forest", "gradient_boosting", "boosted_preset") and not weight and shape.rows > GROUPED_ROWS and estimator.getMinInstancesPerNode() == 1:
        draws = estimator.getSubsamplingRate() < 1 or (family == "random_forest" and estimator.getBootstrap())
        grouped = tree_groups(df, features, label, shape.rows, draws, seed)
        if grouped:
            bins, groups = grouped
            named = {b.getInputCol(): b.getOutputCol() for b in bins}
            assembler = VectorAssembler(inputCols=[named.get(c, c) for c in features], outputCol="features", handleInvalid="keep")
            fitted = estimator.setWeightCol("__rows").fit(assembler.transform(steady(groups, groups.count())))
            fitted.clear(fitted.weightCol)
            return PipelineModel([*bins, assembler, fitted])
    if family == "mlp" and shape.rows > BLOCKED_ROWS and estimator.getSolver() == "l-bfgs":
        fitted = fit_perceptron(estimator, df, features, label, shape.rows)
        if fitted:
            return fitted
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), estimator]
    return Pipeline(stages=stages).fit(steady(df, shape.rows))


class NeighbourModel:
    """k-NN as a model: the training rows are kept as a table and joined when rows are scored."""

    def __init__(self, df: DataFrame, features: list[str], label: str, task: str, params: dict, n_classes: int):
        self.features, self.task, self.params, self.n_classes = features, task, params, n_classes
        rows = df.where(F.col(label).isNotNull()).select(self._vector(), F.col(label).cast("double").alias("__y"))
        self.points = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "knn-model")

    def _vector(self):
        return F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(0.0)) for c in self.features]).alias("__vec")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its prediction and, for classes, their vote shares."""
        p = self.params
        asked = materialize(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__vec", self._vector()), "knn-asked")
        near = neighbours.knn_join(asked.select("__row", "__vec"), "__row", "__vec", int(p["n_neighbors"]), self.points.select("__row", "__vec"), p.get("metric", "euclidean"), float(p.get("p", 2)))
        # tables as large as these are merged: their files are small, and their rows would pass through the driver
        voted = near.join(self.points.select(F.col("__row").alias("neighbour"), "__y").hint("merge"), "neighbour")
        if p.get("weights") == "distance":
            # equal points decide alone
            least = near.groupBy("__row").agg(F.min("distance").alias("__least"))
            voted = voted.join(least, "__row").withColumn("__w", F.when(F.col("__least") == 0, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))
        else:
            voted = voted.withColumn("__w", F.lit(1.0))
        total = F.sum("__w")
        if self.task == "regression":
            return asked.hint("merge").join(voted.groupBy("__row").agg((F.sum(F.col("__w") * F.col("__y")) / total).alias("prediction")), "__row", "left").drop("__row", "__vec")
        shares = F.array(*[F.round(F.sum(F.when(F.col("__y") == i, F.col("__w")).otherwise(0.0)) / total, 9) for i in range(self.n_classes)])
        votes = voted.groupBy("__row").agg(shares.alias("probability"))
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return asked.hint("merge").join(votes, "__row", "left").withColumn("prediction", best).drop("__row", "__vec")


def predict(df: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns, the prediction and, for classifiers, probabilities (or raw scores in their place)."""
    scored = model.transform(df)
    columns = [F.col("prediction").alias("pred")]
    kinds = dict(scored.dtypes)
    for name in ("probability", "rawPrediction"):
        if name in kinds:
            values = F.col(name) if kinds[name].startswith("array") else vector_to_array(name)
            columns.append(values.alias("probability" if name == "probability" else "scores"))
            break
    return scored.select(*keep, *columns)


def run_parallel(tasks: list[Callable], parallelism: int) -> list:
    """Submit independent fits from a few driver threads; each is a Spark job."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]]


def default_metric(df: DataFrame, label: str, task: str) -> str:
    """The metric recommended for the target: by class balance, or r2."""
    return "r2" if task == "regression" else quality.recommended_metric(df.select(F.col(label).cast("string").alias(label)), label).first()["metric"]


def held_out_value(held: DataFrame, metric: str, label: str, n_classes: int) -> float:
    """One metric of predictions; ranking metrics read the class scores."""
    if not metric.startswith("auc"):
        return metrics.metric_value(held, metric, label, "pred")
    values = next((c for c in ("probability", "scores") if c in held.columns), None)
    if values is None:
        raise ValueError(f"{metric} needs class scores, which this family does not give")
    if metric == "auc" and n_classes <= 2:
        return metrics.metric_value(held.withColumn("__p", F.get(values, F.lit(1))), "auc", label, "pred", "__p")
    long = held.select(F.col(label).cast("bigint").alias("y"), F.posexplode(values).alias("class", "p"))
    return metrics.class_auc(long, "auc_ovo" if metric == "auc_ovo" else "auc_ovr")


def cross_validate(
    df: DataFrame,
    features: list[str],
    label: str,
    family: str,
    task: str,
    params: dict | None = None,
    metric: str | None = None,
    fold: str = "fold",
    k: int = 5,
    parallelism: int = 3,
    seed: int = 42,
    weight: str | None = None,
    shape: Shape | None = None,
) -> list[float]:
    """Held-out score of each fold; ``df`` carries the fold column."""
    shape = shape or table_shape(df, label, task)
    metric = default_metric(df, label, task) if metric in (None, "auto") else metric

    def run(i: int) -> float:
        model = fit_model(df.where(F.col(fold) != i), features, label, family, task, params, seed, weight, shape)
        held = predict(df.where(F.col(fold) == i), model, [label])
        return held_out_value(held, metric, label, shape.classes)

    return run_parallel([lambda i=i: run(i) for i in range(k)], parallelism)


def cv_table(spark, scores: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fold int, score double")


def cv_summary(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(score).alias("n_folds"),
        F.avg(score).alias("cv_mean"),
        F.stddev_pop(score).alias("cv_std"),
        F.stddev_samp(score).alias("cv_std_log"),
    )


@dataclass(frozen=True)
class Span:
    """A declared range of numbers: whole ones or not, even on a linear or a log scale."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def at(self, share: float) -> float | int:
        """The value at a share of the way from low to high."""
        if self.log:
            value = math.exp(math.log(self.low) + share * (math.log(self.high) - math.log(self.low)))
        else:
            value = self.low + share * (self.high - self.low)
        return min(int(self.high), max(int(self.low), round(value))) if self.whole else min(self.high, max(self.low, value))

    def share(self, value: float) -> float:
        """Where a value lies, 0 at low and 1 at high; values outside count as the nearer end."""
        value = min(self.high, max(self.low, float(value)))
        if self.high == self.low:
            return 0.0
        place = math.log if self.log else float
        return (place(value) - place(self.low)) / (place(self.high) - place(self.low))


@dataclass(frozen=True)
class Choice:
    """A declared list of values."""

    values: tuple


def family_space(family: str) -> dict[str, Span | Choice]:
    """The fixed ranges of a family as declared ranges."""
    made = {"int": lambda a, b: Span(a, b, whole=True), "log": lambda a, b: Span(a, b, log=True), "float": Span, "choice": lambda v: Choice(tuple(v))}
    return {name: made[kind](*bounds) for name, (kind, *bounds) in SEARCH_SPACES[family].items()}


def sample_trials(family: str, count: int, seed: int = 42, space: dict[str, Span | Choice] | None = None, first: list[dict] | None = None) -> list[dict]:
    """Seeded random draws from a space, warm-start trials first."""
    space = space or family_space(family)
    rng = random.Random(f"{seed}:{family}")
    trials = list(first or [])
    while len(trials) < count:
        trials.append({name: rng.choice(r.values) if isinstance(r, Choice) else r.at(rng.random()) for name, r in space.items()})
    return trials[:count]


TRIAL_SCHEMA = (
    "trial_id bigint, model_type string, params map<string,string>, metric string, value double, score double, "
    "cv_scores array<double>, fit_time double, status string"
)


def random_search(
    df: DataFrame,
    key: str,
    features: list[str],
    label: str,
    task: str,
    families: dict[str, list[dict]],
    metric: str | None = None,
    k: int = 5,
    seed: int = 42,
    parallelism: int = 2,
    deadline_seconds: float | None = None,
    balance_classes: bool = False,
) -> DataFrame:
    """One row per trial: cross-validated value, sortable score and status.

    ``families`` maps a family to its trials (see ``sample_trials``).  A text label
    is coded through its dictionary; without a metric the one recommended for the
    target is used; ``balance_classes`` weighs rows by their class.  The training
    table is written once with its folds; every fit is a Spark job over it.  A
    failing trial, and one that the deadline leaves out, stays in the table with
    its reason; neither has a score.
    """
    metric = default_metric(df, label, task) if metric in (None, "auto") else metric
    needed = df.select(key, *features, label)
    if dict(needed.dtypes)[label] == "string":
        coded = encode.apply_ordinal(needed, label, encode.fit_ordinal(needed, label), "__code")
        needed = coded.withColumn(label, F.col("__code").cast("double")).drop("__code")
    weight = "__weight" if balance_classes and task == "classification" else None
    if weight:
        needed = split.weight_column(needed, label, weight)
    folded = split.folds_stratified(needed, key, label, k, seed) if task == "classification" else split.folds_plain(needed, key, k, seed)
    folded = materialize(folded, "search")
    shape = table_shape(folded, label, task)
    started = time.monotonic()
    jobs = []

    def run(number: int, family: str, params: dict) -> tuple:
        shown = {n: str(v) for n, v in params.items()}
        begin = time.monotonic()

        def row(value: float | None, scores: list[float], status: str) -> tuple:
            score = None if value is None else metrics.sortable_score(metric, value)
            return (number, family, shown, metric, value, score, scores, time.monotonic() - begin, status)

        if deadline_seconds is not None and begin - started > deadline_seconds:
            return row(None, [], "skipped: deadline")
        try:
            scores = cross_validate(folded, features, label, family, task, params, metric, "fold", k, 1, seed, weight, shape)
            return row(sum(scores) / len(scores), scores, "completed")
        except Exception as error:  # a bad parameter set must not end the search
            return row(None, [], f"failed: {type(error).__name__}: {error}"[:500])

    for family, trials in families.items():
        for params in trials:
            jobs.append(lambda n=len(jobs), f=family, p=params: run(n, f, p))
    return df.sparkSession.createDataFrame(run_parallel(jobs, parallelism), TRIAL_SCHEMA)


def warmstart_trials(base: dict[str, Any] | None, family: str, n_trials: int = 3, seed: int = 42, step: float = 0.1) -> list[dict]:
    """The stored best parameters, then copies drawn ever further around them.

    Trial ``i`` moves each number by at most ``i * step`` of the family's own search
    range, measured on the scale of that range, and stays inside it.  What the
    family has no range of numbers for is kept.
    """
    if not base:
        return []
    space = family_space(family)
    trials = [dict(base)]
    for i in range(1, n_trials):
        rng = random.Random(f"{seed}:{family}:{i}")
        reach = min(1.0, i * step)
        moved = {n: space[n].at(min(1.0, max(0.0, space[n].share(v) + rng.uniform(-reach, reach)))) for n, v in base.items() if isinstance(space.get(n), Span)}
        trials.append({**base, **moved})
    return trials


def out_of_fold(
    df: DataFrame, key: str, features: list[str], label: str, task: str, bases: dict[str, tuple[str, dict]], k: int = 5, fold: str = "fold"
) -> DataFrame:
    """Held-out predictions of each base model: (key, label, fold, model, pred)."""

    shape = table_shape(df, label, task)

    def run(name: str, i: int) -> DataFrame:
        family, params = bases[name]
        model = fit_model(df.where(F.col(fold) != i), features, label, family, task, params, shape=shape)
        return predict(df.where(F.col(fold) == i), model, [key, label, fold]).select(key, label, fold, F.lit(name).alias("model"), "pred")

    jobs = [lambda n=n, i=i: run(n, i) for n in bases for i in range(k)]
    return reduce(DataFrame.unionByName, run_parallel(jobs, 3))


def step_listing(model: PipelineModel) -> list[tuple[str, str, str]]:
    """(step, parameter, value) rows of a fitted pipeline."""
    rows = []
    for stage in model.stages:
        for param, value in stage.extractParamMap().items():
            rows.append((type(stage).__name__, param.name, str(value)))
    return rows
