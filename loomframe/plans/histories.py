"""Leaderboards, run history and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.operators import explain, history, quality
from loomframe.plans import views
from loomframe.plans.registry import Tables, num, query, stamp, union, whole
from loomframe.plans.views import with_views

TRIAL = f"{whole('trial_id', 'trial_id')}, model_type, {num('score', 'score')}"
DONE = "trials where status = 'completed'"


@query("leaderboard_rank", with_views("trials", f"select {whole('row_number() over (order by score desc, trial_id)', 'rank')}, {TRIAL} from {DONE}"))
def leaderboard_rank(t: Tables) -> DataFrame:
    return history.leaderboard_rank(views.trials(t)).select("rank", "trial_id", "model_type", "score")


@query("leaderboard_top", with_views("trials", f"select {TRIAL} from {DONE} order by score desc, trial_id limit 10"))
def leaderboard_top(t: Tables) -> DataFrame:
    return history.leaderboard_top(views.trials(t), 10).select("trial_id", "model_type", "score")


@query("leaderboard_by_model", with_views("trials", f"select {TRIAL} from {DONE} and model_type = 'SMALL'"))
def leaderboard_by_model(t: Tables) -> DataFrame:
    return history.leaderboard_by_model(views.trials(t), "SMALL").select("trial_id", "model_type", "score")


STATS = f"count(*) as n_trials, {num('max(score)', 'best_score')}, {{0}}{num('avg(score)', 'mean_score')}, {num('stddev_pop(score)', 'std_score')}, {num('avg(fit_time)', 'mean_fit_time')}"


@query(
    "leaderboard_stats",
    with_views(
        "trials",
        f"select {STATS.format(num('min(score)', 'worst_score') + ', ')}, {num('avg(predict_time)', 'mean_predict_time')}, string_agg(distinct model_type, ',' order by model_type) as models from {DONE}",
    ),
)
def leaderboard_stats(t: Tables) -> DataFrame:
    return history.leaderboard_stats(views.trials(t))


@query("leaderboard_model_stats", with_views("trials", f"select model_type, {STATS.format('')} from {DONE} group by 1"))
def leaderboard_model_stats(t: Tables) -> DataFrame:
    return history.leaderboard_model_stats(views.trials(t))


@query("leaderboard_compare", with_views("trials", f"select model_type, {STATS.format('')} from {DONE} and model_type in ('SMALL', 'ECONOMY') group by 1"))
def leaderboard_compare(t: Tables) -> DataFrame:
    return history.leaderboard_model_stats(views.trials(t), ["SMALL", "ECONOMY"])


CHANGES = "select o_custkey as run_id, o_orderkey as version, o_orderpriority as best_model, o_totalprice / 1000000 as best_score from orders"


def run_versions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("best_model"), (F.col("o_totalprice") / 1000000).alias("best_score")
    )


LATEST = f"""select {whole('run_id', 'run_id')}, {whole('version', 'version')}, best_model, {num('best_score', 'best_score')} from (
 select *, row_number() over (partition by run_id order by version desc) as rn from ({{0}}) c) x where rn = 1"""


@query("runs_upsert", LATEST.format(union([CHANGES, "select c_custkey, -1, 'none', c_acctbal / 1000000 from customer"])))
def runs_upsert(t: Tables) -> DataFrame:
    """Stored runs from customer, changes from orders."""
    stored = t.customer.select(
        F.col("c_custkey").alias("run_id"), F.lit(-1).cast("bigint").alias("version"), F.lit("none").alias("best_model"), (F.col("c_acctbal") / 1000000).alias("best_score")
    )
    return history.upsert_runs(stored, run_versions(t))


def _similar_sql(limit: int) -> str:
    """Profile of customer: five columns, target the market segment."""

    def count_term(mine: str, name: str, weight: float) -> tuple[str, str]:
        usable = f"{mine} <> 0 and {name} is not null and {name} <> 0"
        return (
            f"case when {usable} then {weight} * (1 - abs({mine} - {name}) / cast(greatest({mine}, {name}) as double)) else 0 end",
            f"case when {usable} then {weight} else 0 end",
        )

    terms = [("case when task_type = 'classification' then 0.3 else 0 end", "0.3")]
    terms += [count_term(m, n, w) for m, n, w in (("5", "n_features", 0.2), ("p.n_rows", "runs.n_rows", 0.1), ("3", "n_numeric", 0.1), ("2", "n_categorical", 0.1))]
    terms.append(("0.1 * (1 - abs(0.0 - missing_ratio))", "0.1"))
    terms.append(("case when class_balance is not null then 0.1 * (1 - abs(p.balance - class_balance)) else 0 end", "case when class_balance is not null then 0.1 else 0 end"))
    gained, possible = " + ".join(f"cast({g} as double)" for g, _ in terms), " + ".join(f"cast({w} as double)" for _, w in terms)
    return f"""CTE b as (select count(*) as n from customer group by c_mktsegment),
p as (select (select count(*) from customer) as n_rows, min(n) / cast(max(n) as double) as balance from b),
s as (select runs.*, round(({gained}) / ({possible}), 9) as similarity from runs, p),
r as (select *, row_number() over (order by similarity desc, run_id) as rn from s)
select * from r where rn <= {limit}"""


def customer_profile(t: Tables) -> dict:
    return history.profile_record(quality.dataset_profile(t.customer, "c_mktsegment").first())


@query("runs_similar", f"select run_id, task_type, {num('similarity', 'similarity')} from ({with_views('runs', _similar_sql(5))}) x")
def runs_similar(t: Tables) -> DataFrame:
    return history.similar_runs(views.runs(t), customer_profile(t), 5).select("run_id", "task_type", "similarity")


@query(
    "runs_best_params",
    f"""with s as ({with_views('runs', _similar_sql(10))})
select best_model, best_params as params, {num('best_score', 'score')} from (select *, row_number() over (partition by best_model order by best_score desc, run_id desc) as pos from s) x where pos = 1""",
)
def runs_best_params(t: Tables) -> DataFrame:
    return history.best_params_by_model(history.similar_runs(views.runs(t), customer_profile(t), 10))


@query(
    "runs_stats",
    with_views(
        "runs",
        f"select count(*) as total_runs, string_agg(distinct task_type, ',' order by task_type) as task_types, string_agg(distinct best_model, ',' order by best_model) as model_types, {num('sum(best_score) / count(*)', 'avg_score')} from runs",
    ),
)
def runs_stats(t: Tables) -> DataFrame:
    return history.run_statistics(views.runs(t))


def _summary_sql(scope: str, source: str) -> str:
    return f"select '{scope}' as scope, count(*) as total_metrics, {stamp('min(ts)', 'first_ts')}, {stamp('max(ts)', 'last_ts')}, count(distinct model_name) as n_models, count(distinct run_id) as n_runs from {source}"


@query("history_summary", with_views("metric_log", union([_summary_sql("all", "metric_log"), _summary_sql("last 100", "(select * from metric_log order by ts desc, event_id desc limit 100) x")])))
def history_summary(t: Tables) -> DataFrame:
    log = views.metric_log(t)
    return history.history_summary(log).withColumn("scope", F.lit("all")).unionByName(history.history_summary(log, 100).withColumn("scope", F.lit("last 100")))


@query(
    "history_averages",
    with_views("metric_log", union([f"select '{c}' as metric, count({c}) as n, {num(f'avg({c})', 'mean')}, {num(f'stddev_samp({c})', 'std')} from metric_log" for c in ("accuracy", "f1_weighted")])),
)
def history_averages(t: Tables) -> DataFrame:
    return history.history_averages(views.metric_log(t), ["accuracy", "f1_weighted"])


@query(
    "history_trend",
    with_views(
        "metric_log",
        f"select {whole('event_id', 'event_id')}, {stamp('ts', 'ts')}, {num('accuracy', 'accuracy')}, {num('f1_weighted', 'f1_weighted')}, {whole('row_number() over (order by ts, event_id)', 'seq')} from metric_log where model_name = 'click'",
    ),
)
def history_trend(t: Tables) -> DataFrame:
    return history.history_trend(views.metric_log(t), "click", ["accuracy", "f1_weighted"])


PERFORMANCE = f"count(value) as n, {num('avg(value)', 'mean')}, {num('min(value)', 'min')}, {num('max(value)', 'max')}"


@query("performance_summary", f"select event_type as name, {PERFORMANCE} from events group by 1")
def performance_summary(t: Tables) -> DataFrame:
    return history.performance_summary(t.events, "event_type", "value")


@query(
    "key_usage_audit",
    f"select {whole('user_id', 'user_id')}, count(*) as n_requests, count(*) filter (where event_type in ('view', 'click')) as usage_count, {stamp('max(case when event_type in ($$view$$, $$click$$) then ts end)', 'last_used')} from events group by 1",
)
def key_usage_audit(t: Tables) -> DataFrame:
    return history.key_usage_audit(t.events, "user_id", F.col("event_type").isin("view", "click"), "ts")


@query(
    "summary_card",
    """select '# Model summary' || chr(10) || chr(10) || '- model: linear' || chr(10) || '- task: regression' || chr(10) || '- score: ' ||
 printf('%.4f', (select max((p_retailprice - 900) / 100) from part where p_partkey % 17 <> 0)) || chr(10) || '- features: 2' || chr(10) || '- rows: ' || format('{:,}', count(*)) as card from part""",
)
def summary_card(t: Tables) -> DataFrame:
    """Short card with the best score of the leaderboard."""
    best = history.leaderboard_top(views.trials(t), 1).first()["score"]
    return explain.summary_card(t.part, "linear", "regression", best, 2)


IMPORTANCES = "(select p_type as feature, avg(p_size) as importance from part group by 1) i"


def _importances(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("feature")).agg(F.avg("p_size").alias("importance"))


@query("importance_topk", f"select feature, {num('importance', 'importance')} from {IMPORTANCES} order by importance desc, feature limit 3")
def importance_topk(t: Tables) -> DataFrame:
    return explain.top_features(_importances(t), 3)


@query(
    "importance_plot",
    f"select string_agg(feature, ',' order by importance desc, feature) as features, {num('sum(importance)', 'total')}, 'Feature importance' as title from {IMPORTANCES}",
)
def importance_plot(t: Tables) -> DataFrame:
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return explain.plot_data(_importances(t)).select(F.array_join("features", ",").alias("features"), total.alias("total"), "title")
