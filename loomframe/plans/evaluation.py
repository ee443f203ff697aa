"""Metrics and ensembles over the fixed prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomframe.operators import ensemble, metrics
from loomframe.plans import views
from loomframe.plans.registry import Tables, num, query, union, whole
from loomframe.plans.views import with_views

BY = ["model"]


@query("metric_accuracy", with_views("preds", f"select model, {num('avg(cast(y = pred as int))', 'accuracy')} from preds group by 1"))
def metric_accuracy(t: Tables) -> DataFrame:
    return metrics.accuracy(views.preds(t), by=BY)


@query(
    "metric_balanced_accuracy",
    with_views("preds", f"select model, {num('avg(r)', 'balanced_accuracy')} from (select model, y, avg(cast(y = pred as int)) as r from preds group by 1, 2) x group by 1"),
)
def metric_balanced_accuracy(t: Tables) -> DataFrame:
    return metrics.balanced_accuracy(views.preds(t), by=BY)


CLASS_SQL = """CTE k as (select distinct model, c from (select model, y as c from preds union all select model, pred from preds) u),
s as (select k.model, k.c, count(*) filter (where p.y = k.c and p.pred = k.c) as tp, count(*) filter (where p.y = k.c) as support, count(*) filter (where p.pred = k.c) as predicted
 from k join preds p on k.model = p.model group by 1, 2),
f as (select model, c, tp, support, predicted, case when predicted > 0 then tp / cast(predicted as double) else 0 end as p,
 case when support > 0 then tp / cast(support as double) else 0 end as r, 2.0 * tp / (predicted + support) as f1 from s)
"""


@query(
    "metric_prf_weighted",
    with_views(
        "preds",
        CLASS_SQL + f"select model, {num('sum(p * support) / sum(support)', 'precision_weighted')}, {num('sum(r * support) / sum(support)', 'recall_weighted')}, {num('sum(f1 * support) / sum(support)', 'f1_weighted')} from f group by 1",
    ),
)
def metric_prf_weighted(t: Tables) -> DataFrame:
    return metrics.prf_weighted(views.preds(t), by=BY)


@query("metric_f1_macro", with_views("preds", CLASS_SQL + f"select model, {num('avg(f1)', 'f1_macro')} from f group by 1"))
def metric_f1_macro(t: Tables) -> DataFrame:
    return metrics.f1_macro(views.preds(t), by=BY)


@query("metric_prf_binary", with_views("preds", CLASS_SQL + f"select model, {num('p', 'precision')}, {num('r', 'recall')}, {num('f1', 'f1')} from f where c = 1"))
def metric_prf_binary(t: Tables) -> DataFrame:
    return metrics.prf_binary(views.preds(t), by=BY)


def _rank_sql(by: str, positive: str, source: str) -> str:
    return f"""select {by}, (sum(case when {positive} then rk end) - np * (np + 1) / 2.0) / (np * (n - np)) as auc, np as n_pos, n from (
 select *, rank() over (partition by {by} order by p) + count(*) over (partition by {by}, p) / 2.0 - 0.5 as rk,
  count(*) filter (where {positive}) over (partition by {by}) as np, count(*) over (partition by {by}) as n from {source}) r group by {by}, np, n"""


@query("metric_auc_binary", with_views("preds", f"select model, {num('auc', 'auc')} from ({_rank_sql('model', 'y = 1', 'preds')}) a"))
def metric_auc_binary(t: Tables) -> DataFrame:
    return metrics.auc_binary(views.preds(t), by=BY)


@query("metric_auc_ovr", with_views("probs", f"select {num('sum(auc * n_pos) / sum(n_pos)', 'auc_ovr')} from ({_rank_sql('class', 'y = class', 'probs')}) a"))
def metric_auc_ovr(t: Tables) -> DataFrame:
    return metrics.auc_ovr(views.probs(t))


@query(
    "metric_auc_ovo",
    with_views(
        "probs",
        f"""CTE c as (select distinct y as other from probs),
q as (select p.row_id, p.y, p.class, p.p, c.other from probs p join c on c.other <> p.class where p.y = p.class or p.y = c.other)
select {num('sum(auc * n) / sum(n)', 'auc_ovo')} from ({_rank_sql('class, other', 'y = class', 'q')}) a""",
    ),
)
def metric_auc_ovo(t: Tables) -> DataFrame:
    return metrics.auc_ovo(views.probs(t))


@query(
    "metric_regression",
    with_views(
        "preds_reg",
        f"""select model, {num('avg(abs(y - pred))', 'mae')}, {num('avg(power(y - pred, 2))', 'mse')}, {num('sqrt(avg(power(y - pred, 2)))', 'rmse')},
{num('1 - avg(power(y - pred, 2)) / var_pop(y)', 'r2')} from preds_reg group by 1""",
    ),
)
def metric_regression(t: Tables) -> DataFrame:
    return metrics.regression_errors(views.preds_reg(t), by=BY)


def _residual_sql() -> str:
    parts = []
    for name, e in (("residual", "y - pred"), ("prediction", "pred")):
        for stat, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(num(f"{fn}({e})", f"{name}_{stat}"))
    return f"select model, {', '.join(parts)} from preds_reg group by 1"


@query("metric_residuals", with_views("preds_reg", _residual_sql()))
def metric_residuals(t: Tables) -> DataFrame:
    return metrics.residual_statistics(views.preds_reg(t), by=BY)


@query(
    "confusion_matrix",
    with_views(
        "preds",
        """CTE c as (select distinct y as c from preds union select distinct pred from preds), m as (select distinct model from preds),
g as (select m.model, a.c as y, b.c as pred from m, c a, c b)
select g.model, cast(g.y as bigint) as y, cast(g.pred as bigint) as pred, count(p.model) as n from g left join preds p on g.model = p.model and g.y = p.y and g.pred = p.pred group by 1, 2, 3""",
    ),
)
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(views.preds(t), by=BY)


@query(
    "classification_report",
    with_views(
        "preds",
        CLASS_SQL
        + union(
            [
                f"select model, cast(c as varchar) as label, {num('p', 'precision')}, {num('r', 'recall')}, {num('f1', 'f1')}, {whole('support', 'support')} from f",
                f"select model, 'accuracy', {num('sum(tp) / sum(support)', 'a')}, {num('sum(tp) / sum(support)', 'b')}, {num('sum(tp) / sum(support)', 'c')}, cast(sum(support) as bigint) from f group by 1",
                f"select model, 'macro avg', {num('avg(p)', 'a')}, {num('avg(r)', 'b')}, {num('avg(f1)', 'c')}, cast(sum(support) as bigint) from f group by 1",
                f"select model, 'weighted avg', {num('sum(p * support) / sum(support)', 'a')}, {num('sum(r * support) / sum(support)', 'b')}, {num('sum(f1 * support) / sum(support)', 'c')}, cast(sum(support) as bigint) from f group by 1",
            ]
        ),
    ),
)
def classification_report(t: Tables) -> DataFrame:
    return metrics.classification_report(views.preds(t), by=BY)


@query("metric_class_counts", with_views("preds", "select model, count(distinct y) as n_true_classes, count(distinct pred) as n_predicted_classes from preds group by 1"))
def metric_class_counts(t: Tables) -> DataFrame:
    return metrics.class_totals(views.preds(t), by=BY)


@query(
    "probability_summary",
    with_views("probs", f"select {num('avg(m)', 'mean_probability')}, {num('avg(s)', 'mean_std')} from (select class, avg(p) as m, stddev_samp(p) as s from probs group by 1) x"),
)
def probability_summary(t: Tables) -> DataFrame:
    return metrics.probability_summary(views.probs(t))


def _record_sql() -> str:
    one = "'m2' as model_name, 'run-1' as run_id, 'classification' as task_type, '2024-01-01 00:00:00.000000' as ts"
    parts = [
        f"select {one}, 'accuracy' as metric, {num('avg(cast(y = pred as int))', 'value')} from preds where model = 'm2'",
        f"select {one}, 'balanced_accuracy', {num('avg(r)', 'v')} from f where model = 'm2' and support > 0",
        f"select {one}, 'precision_weighted', {num('sum(p * support) / sum(support)', 'v')} from f where model = 'm2'",
        f"select {one}, 'recall_weighted', {num('sum(r * support) / sum(support)', 'v')} from f where model = 'm2'",
        f"select {one}, 'f1_weighted', {num('sum(f1 * support) / sum(support)', 'v')} from f where model = 'm2'",
        f"select {one}, 'f1_macro', {num('avg(f1)', 'v')} from f where model = 'm2'",
        f"select {one}, 'n_samples', cast(count(*) as double) from preds where model = 'm2'",
        f"select {one}, 'n_true_classes', cast(count(distinct y) as double) from preds where model = 'm2'",
        f"select {one}, 'n_predicted_classes', cast(count(distinct pred) as double) from preds where model = 'm2'",
        f"select {one}, 'confusion:' || y || ':' || pred, cast(count(*) as double) from preds where model = 'm2' group by y, pred",
        f"select {one}, 'auc', {num('auc', 'v')} from ({_rank_sql('model', 'y = 1', 'preds')}) a where model = 'm2'",
    ]
    return CLASS_SQL + union(parts)


@query("evaluation_record", with_views("preds", _record_sql()))
def evaluation_record(t: Tables) -> DataFrame:
    """The record of one scorer."""
    return metrics.evaluation_record(views.preds(t).where(F.col("model") == "m2"), "m2", "run-1", timestamp="2024-01-01 00:00:00")


@query(
    "ensemble_topk",
    with_views("trials", f"select {whole('trial_id', 'trial_id')}, model_type, {num('score', 'score')} from (select *, row_number() over (order by score desc, trial_id) as rn from trials where status = 'completed') x where rn <= 3"),
)
def ensemble_topk(t: Tables) -> DataFrame:
    return ensemble.top_trials(views.trials(t), 3).select("trial_id", "model_type", "score")


@query("vote_soft", with_views("preds", f"select {whole('row_id', 'row_id')}, {whole('case when round(avg(p), 12) > round(avg(1 - p), 12) then 1 else 0 end', 'pred')} from preds group by 1"))
def vote_soft(t: Tables) -> DataFrame:
    return ensemble.vote_soft(_binary_probs(t), "row_id")


def _binary_probs(t: Tables) -> DataFrame:
    cells = F.array(F.struct(F.lit(0).alias("class"), (1 - F.col("p")).alias("p")), F.struct(F.lit(1).alias("class"), F.col("p").alias("p")))
    return views.preds(t).withColumn("cells", cells).select("row_id", "model", F.inline("cells"))


@query("vote_hard", with_views("preds", f"select {whole('row_id', 'row_id')}, {whole('case when 2 * sum(pred) > count(*) then 1 else 0 end', 'pred')} from preds group by 1"))
def vote_hard(t: Tables) -> DataFrame:
    return ensemble.vote_hard(views.preds(t), "row_id")


@query("vote_mean", with_views("preds_reg", f"select {whole('row_id', 'row_id')}, {num('avg(pred)', 'pred')} from preds_reg group by 1"))
def vote_mean(t: Tables) -> DataFrame:
    return ensemble.vote_mean(views.preds_reg(t), "row_id")


SCORES = {"m0": 0.85, "m1": 0.82, "m2": 0.95}
SCORE_SQL = "(select * from (values ('m0', 0.85::double), ('m1', 0.82::double), ('m2', 0.95::double)) v(m, w)) w"


def _weights(t: Tables) -> dict[str, float]:
    return ensemble.score_weights(t.spark.createDataFrame(list(SCORES.items()), "model string, score double"))


@query(
    "blend_weighted",
    with_views(
        "preds_reg preds",
        f"""CTE r as (select row_id, sum(w * pred) / sum(w) as v from preds_reg join {SCORE_SQL} on model = m group by 1),
c as (select row_id, sum(w * pred) / sum(w) as v from preds join {SCORE_SQL} on model = m group by 1)
select 'regression' as task, {whole('row_id', 'row_id')}, {num('v', 'pred')} from r
union all select 'classification', row_id, {num('round_even(v, 0)', 'pred')} from c""",
    ),
)
def blend_weighted(t: Tables) -> DataFrame:
    weights = _weights(t)
    a = ensemble.blend_weighted(views.preds_reg(t), "row_id", weights).select(F.lit("regression").alias("task"), "row_id", "pred")
    b = ensemble.blend_weighted(views.preds(t), "row_id", weights, classes=True)
    return a.unionByName(b.select(F.lit("classification").alias("task"), "row_id", F.col("pred").cast("double")))


@query(
    "blend_proba",
    with_views(
        "preds",
        f"""CTE b as (select row_id, sum(w * p) / sum(w) as v from preds join {SCORE_SQL} on model = m group by 1)
select {whole('row_id', 'row_id')}, cast(1 as bigint) as class, {num('v', 'p')} from b union all select row_id, 0, {num('1 - v', 'p')} from b""",
    ),
)
def blend_proba(t: Tables) -> DataFrame:
    return ensemble.blend_proba(_binary_probs(t), "row_id", _weights(t))


def _diversity_sql() -> str:
    parts = []
    for task, view, measure in (
        ("classification", "preds", "1 - avg(cast(a.pred = b.pred as int))"),
        ("regression", "preds_reg", "avg(power(a.pred - b.pred, 2)) / nullif(var_pop(a.pred), 0)"),
    ):
        parts.append(
            f"""select '{task}' as task, model, coalesce(sum(d), 0) as diversity from (
 select a.model, b.model as other, {measure} as d from {view} a join {view} b on a.row_id = b.row_id and a.model <> b.model group by 1, 2) x group by 2"""
        )
    return f"CTE d as ({union(parts)}) select task, model, {num('diversity', 'diversity')}, {num('diversity / sum(diversity) over (partition by task)', 'weight')} from d"


@query("diversity_weights", with_views("preds preds_reg", _diversity_sql()))
def diversity_weights(t: Tables) -> DataFrame:
    a = ensemble.diversity_weights(views.preds(t), "row_id", "classification").withColumn("task", F.lit("classification"))
    b = ensemble.diversity_weights(views.preds_reg(t), "row_id", "regression").withColumn("task", F.lit("regression"))
    return reduce(DataFrame.unionByName, [a, b])
