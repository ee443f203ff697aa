"""Evaluation over a predictions table (key, y, pred, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.functions import columns as C
from loomframe.functions.ordering import cut_by_edges, score_edges


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Non-empty cells; one map-side combined count over the predictions."""
    return df.groupBy(*(by or []), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """All (true, predicted) cells, zero where none.

    The class list comes from the counted cells and travels as an array, so
    the grid costs classes squared rows and no product of data rows.
    """
    by = list(by or [])
    cells = confusion_counts(df, y, pred, by)
    classes = cells.select(F.explode(F.array("y", "pred")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("all"))
    listed = classes.first()["all"]
    kind = df.schema[y].dataType
    every = F.array(*[F.lit(c).cast(kind) for c in listed])
    groups = cells.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(every).alias("y")).select(*by, "y", F.explode(every).alias("pred"))
    return grid.join(cells, [*by, "y", "pred"], "left").select(*by, "y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class of the true/predicted union."""
    by = list(by or [])
    cells = confusion_counts(df, y, pred, by)
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
            )
        ),
    )
    sums = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    return sums.select(
        *by,
        "class",
        "tp",
        "support",
        "predicted",
        C.safe_divide(F.col("tp"), F.col("predicted")).alias("precision"),
        C.safe_divide(F.col("tp"), F.col("support")).alias("recall"),
        C.safe_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def balanced_accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    scores = class_scores(df, y, pred, by).where("support > 0")
    return scores.groupBy(*(by or [])).agg(F.avg("recall").alias("balanced_accuracy"))


def prf_weighted(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    def mean(name: str) -> Column:
        return C.safe_divide(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"{name}_weighted")

    return class_scores(df, y, pred, by).groupBy(*(by or [])).agg(mean("precision"), mean("recall"), mean("f1"))


def f1_macro(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    return class_scores(df, y, pred, by).groupBy(*(by or [])).agg(F.avg("f1").alias("f1_macro"))


def prf_binary(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None, positive=1) -> DataFrame:
    """Scores of the positive class, only where there are two true classes."""
    hit, said, real = F.col(y) == F.lit(positive), F.col(pred) == F.lit(positive), F.col(y) == F.lit(positive)
    tp, p, r = F.count_if(hit & said), F.count_if(said), F.count_if(real)
    sums = df.groupBy(*(by or [])).agg(tp.alias("tp"), p.alias("p"), r.alias("r"), F.count_distinct(F.col(y)).alias("classes"))
    return sums.where("classes = 2").select(
        *(by or []),
        C.safe_divide(F.col("tp"), F.col("p")).alias("precision"),
        C.safe_divide(F.col("tp"), F.col("r")).alias("recall"),
        C.safe_divide(2 * F.col("tp"), F.col("p") + F.col("r")).alias("f1"),
    )


def auc_cells(df: DataFrame, by: list[str], score: str, positive: Column, against: Column, rows_per_bucket: int | None = None) -> DataFrame:
    """AUC of the positives of each group against each negative class.

    Equal scores are counted together before the shuffle.  The running count
    of positives is taken inside score ranges and shifted by the ranges
    before, so the ordering is spread over tasks.  One pass per group gives
    the statistic against every negative class; no pair of rows is formed.
    """
    options = {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}
    rows = df.select(*by, F.col(score).cast("double").alias("__s"), positive.alias("__p"), F.when(~positive, against).alias("__a"))
    edges = score_edges(rows, "__s", **options)
    counted = rows.groupBy(*by, "__s", "__a").agg(F.count_if("__p").alias("pos"), F.count_if(~F.col("__p")).alias("neg"))
    cut = cut_by_edges(counted, "__s", edges)
    ranges = cut.groupBy(*by, "__cut").agg(F.sum("pos").alias("__range_pos"))
    before = Window.partitionBy(*by).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    shifts = ranges.select(
        *by, "__cut", F.coalesce(F.sum("__range_pos").over(before), F.lit(0)).alias("__before"), F.sum("__range_pos").over(whole).alias("n_pos")
    )
    inside = Window.partitionBy(*by, "__cut").orderBy("__s").rangeBetween(Window.unboundedPreceding, 0)
    tied = Window.partitionBy(*by, "__cut", "__s")
    running = cut.withColumn("__upto", F.sum("pos").over(inside)).withColumn("__tied", F.sum("pos").over(tied))
    joined = running.where("neg > 0").join(shifts, [*by, "__cut"])
    above = F.col("n_pos") - F.col("__before") - F.col("__upto")
    wins = F.col("neg") * (above + F.col("__tied") * F.lit(0.5))
    return (
        joined.groupBy(*by, F.col("__a").alias("against"))
        .agg(F.first("n_pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("wins"))
        .withColumn("auc", F.try_divide(F.col("wins"), (F.col("n_pos") * F.col("n_neg")).cast("double")))
    )


def auc_binary(df: DataFrame, y: str = "y", score: str = "p", by: list[str] | None = None, positive=1, rows_per_bucket: int | None = None) -> DataFrame:
    by = list(by or [])
    cells = auc_cells(df, by, score, F.col(y) == F.lit(positive), F.lit("rest"), rows_per_bucket)
    return cells.select(*by, F.col("auc"))


def auc_ovr(probs: DataFrame, y: str = "y", label: str = "class", score: str = "p") -> DataFrame:
    """Class-frequency weighted mean of the one-against-the-rest AUC."""
    cells = auc_cells(probs, [label], score, F.col(y) == F.col(label), F.lit("rest"))
    return cells.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc_ovr"))


def auc_ovo(probs: DataFrame, y: str = "y", label: str = "class", score: str = "p") -> DataFrame:
    """Mean AUC over pairs of classes, weighted by the rows of the pair."""
    cells = auc_cells(probs, [label], score, F.col(y) == F.col(label), F.col(y))
    weight = F.col("n_pos") + F.col("n_neg")
    return cells.agg((F.sum(F.col("auc") * weight) / F.sum(weight)).alias("auc_ovo"))


def regression_errors(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    gap = F.col(y) - F.col(pred)
    sums = df.groupBy(*(by or [])).agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.var_pop(F.col(y)).alias("__v")
    )
    return sums.select(*(by or []), "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("mse"), F.col("__v"))).alias("r2"))


def residual_statistics(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    gap = F.col(y) - F.col(pred)
    exprs = []
    for name, value in (("residual", gap), ("prediction", F.col(pred))):
        exprs += [F.avg(value).alias(f"{name}_mean"), F.stddev_samp(value).alias(f"{name}_std"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]
    return df.groupBy(*(by or [])).agg(*exprs)


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages."""
    by = list(by or [])
    scores = class_scores(df, y, pred, by)
    per_class = scores.select(*by, F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    share = C.safe_divide(F.sum("tp"), F.sum("support"))
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return C.safe_divide(F.sum(F.col(name) * F.col("support")), total)

    means = scores.groupBy(*by).agg(
        share.alias("acc"),
        total.alias("support"),
        *[F.avg(n).alias(f"m_{n}") for n in ("precision", "recall", "f1")],
        *[weighted(n).alias(f"w_{n}") for n in ("precision", "recall", "f1")],
    )

    def row(label: str, p: str, r: str, f: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"), F.col("support"))

    averages = means.select(
        *by,
        F.inline(
            F.array(
                row("accuracy", "acc", "acc", "acc"),
                row("macro avg", "m_precision", "m_recall", "m_f1"),
                row("weighted avg", "w_precision", "w_recall", "w_f1"),
            )
        ),
    )
    return per_class.unionByName(averages)


def class_totals(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count_distinct(F.col(y)).alias("n_true_classes"), F.count_distinct(F.col(pred)).alias("n_predicted_classes"))


def probability_summary(probs: DataFrame, label: str = "class", score: str = "p") -> DataFrame:
    per_class = probs.groupBy(label).agg(F.avg(score).alias("m"), F.stddev_samp(score).alias("s"))
    return per_class.agg(F.avg("m").alias("mean_probability"), F.avg("s").alias("mean_std"))


def label_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, weighted scores, macro F1 and sample count from one count of the cells."""
    support = F.sum("support")

    def weighted(name: str) -> Column:
        return C.safe_divide(F.sum(F.col(name) * F.col("support")), support).alias(f"{name}_weighted")

    return class_scores(df, y, pred, by).groupBy(*(by or [])).agg(
        C.safe_divide(F.sum("tp"), support).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
        F.avg("f1").alias("f1_macro"),
        support.cast("double").alias("n_samples"),
    )


def evaluation_record(
    df: DataFrame, model: str, run: str, y: str = "y", pred: str = "pred", score: str | None = "p", task: str = "classification", probs: DataFrame | None = None, timestamp=None
) -> DataFrame:
    """Long (model, run, task, timestamp, metric, value) rows, the shape the metric log keeps.

    Classification: label metrics, class counts, confusion cells, the binary AUC of
    ``score`` and, from long class probabilities (y, class, p), both multi-class AUCs
    and the probability summary.  Regression: errors and residual statistics.
    ``timestamp`` defaults to the time of the run.
    """

    def listed(frame: DataFrame) -> DataFrame:
        return C.inline_rows(frame, [{"metric": F.lit(c), "value": F.col(c).cast("double")} for c in frame.columns])

    if task == "regression":
        frames = [listed(regression_errors(df, y, pred)), listed(residual_statistics(df, y, pred))]
    else:
        cells = confusion_counts(df, y, pred)
        frames = [listed(label_metrics(df, y, pred)), listed(class_totals(df, y, pred))]
        name = F.concat_ws(":", F.lit("confusion"), F.col("y").cast("string"), F.col("pred").cast("string"))
        frames.append(cells.select(name.alias("metric"), F.col("n").cast("double").alias("value")))
        if score:
            frames.append(listed(auc_binary(df, y, score)))
        if probs is not None:
            frames += [listed(auc_ovr(probs)), listed(auc_ovo(probs)), listed(probability_summary(probs))]
    rows = reduce(DataFrame.unionByName, frames)
    when = F.current_timestamp() if timestamp is None else F.lit(timestamp).cast("timestamp")
    return rows.select(F.lit(model).alias("model_name"), F.lit(run).alias("run_id"), F.lit(task).alias("task_type"), when.alias("ts"), "metric", "value")


def metric_value(df: DataFrame, metric: str, y: str = "y", pred: str = "pred", score: str | None = None) -> float:
    """One metric as a number; error metrics keep their natural sign."""
    if metric in ("mae", "mse", "rmse", "r2"):
        return regression_errors(df, y, pred).first()[metric]
    named = {"f1": "f1_weighted", "precision": "precision_weighted", "recall": "recall_weighted"}.get(metric, metric)
    if named in ("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "precision_weighted", "recall_weighted"):
        return label_metrics(df, y, pred).first()[named]
    if metric == "auc" and score:
        return auc_binary(df, y, score).first()["auc"]
    raise ValueError(f"unknown metric {metric!r}")


def class_auc(probs: DataFrame, kind: str) -> float:
    """One-vs-rest or one-vs-one AUC of long rows (y, class, p) as a number."""
    return (auc_ovo if kind == "auc_ovo" else auc_ovr)(probs).first()[0]


def sortable_score(metric: str, value: float) -> float:
    """Larger is better: error metrics change sign."""
    return -value if metric in ("mae", "mse", "rmse") else value
