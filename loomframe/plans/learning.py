"""Splits, cross-validation, models, explanations and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.functions import ordering
from loomframe.operators import ensemble, explain, history, metrics, models, neighbours, preprocess, scoring, split, treeparts
from loomframe.plans import views
from loomframe.plans.profiles import knn_sql
from loomframe.plans.registry import Tables, num, query, union, whole
from loomframe.session import materialize, scratch_path
from loomframe.sources import tables

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
SEEDED = "md5('42:' || cast(doc_id as varchar))"


@query(
    "split_stratified",
    f"""select {whole('doc_id', 'doc_id')}, {whole('quality', 'quality')}, rn <= round(n * 0.2) as is_test from (
 select doc_id, quality, row_number() over (partition by quality order by {SEEDED}, doc_id) as rn, count(*) over (partition by quality) as n from labels) x""",
)
def split_stratified(t: Tables) -> DataFrame:
    return split.split_stratified(t.labels, "doc_id", "quality").select("doc_id", "quality", "is_test")


@query(
    "folds_stratified",
    f"""select {whole('doc_id', 'doc_id')}, {whole('quality', 'quality')}, {whole('(rn - 1) % 5', 'fold')} from (
 select doc_id, quality, row_number() over (partition by quality order by {SEEDED}, doc_id) as rn from labels) x""",
)
def folds_stratified(t: Tables) -> DataFrame:
    return split.folds_stratified(t.labels, "doc_id", "quality", 5).select("doc_id", "quality", "fold")


def fold_sql(key: str, k: int) -> str:
    return f"cast('0x' || substr(md5('42:' || cast({key} as varchar)), 1, 8) as bigint) % {k}"


@query("folds_plain", f"select {whole('o_orderkey', 'o_orderkey')}, {whole(fold_sql('o_orderkey', 5), 'fold')} from orders")
def folds_plain(t: Tables) -> DataFrame:
    return split.folds_plain(t.orders, "o_orderkey", 5).select("o_orderkey", "fold")


def _cv_sql(k: int) -> str:
    fits = union(
        [
            f"select {i} as fold, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from f where fold <> {i}"
            for i in range(k)
        ]
    )
    return f"""with f as (select {fold_sql('l_orderkey', k)} as fold, l_quantity, l_extendedprice from lineitem), m as ({fits})
select {whole('f.fold', 'fold')}, {num('1 - avg(power(l_extendedprice - a - b * l_quantity, 2)) / var_pop(l_extendedprice)', 'score')} from f join m on f.fold = m.fold group by f.fold"""


@query("cv_scores", _cv_sql(5))
def cv_scores(t: Tables) -> DataFrame:
    rows = split.folds_plain(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), "l_orderkey", 5)
    rows = materialize(rows.select("fold", "l_quantity", "l_extendedprice"), "cv")
    scores = models.cross_validate(rows, ["l_quantity"], "l_extendedprice", "linear_regression", "regression", metric="r2", k=5)
    return models.cv_table(t.spark, scores)


@query(
    "cv_summary",
    f"""select event_type as trial, count(*) as n_folds, {num('avg(value)', 'cv_mean')}, {num('stddev_pop(value)', 'cv_std')}, {num('stddev_samp(value)', 'cv_std_log')} from events group by 1""",
)
def cv_summary(t: Tables) -> DataFrame:
    return models.cv_summary(t.events.withColumnRenamed("event_type", "trial"), ["trial"], "value")


@query("search_random")
def search_random(t: Tables) -> DataFrame:
    """Random trials of three families, the warm-start trials of the forest first."""
    near = {"n_estimators": models.Span(80, 120, whole=True), "max_depth": models.Span(3, 6, whole=True), "max_features": models.Choice(("sqrt", "log2"))}
    warm = models.warmstart_trials({"n_estimators": 100, "max_depth": 4}, "random_forest", 1)
    families = {
        "linear_regression": models.sample_trials("linear_regression", 2),
        "random_forest": models.sample_trials("random_forest", 2, space=near, first=warm),
        "knn": models.sample_trials("knn", 2),
    }
    found = models.random_search(part_rows(t), "p_partkey", list(WEIGHTS), "y", "regression", families)
    return found.withColumn("params", F.to_json("params")).withColumn("cv_scores", F.to_json("cv_scores"))


def _search_sql(k: int = 5) -> str:
    return f"""with f as materialized (select c_custkey, c_acctbal as x, cast(c_nationkey as double) as y, {fold_sql('c_custkey', k)} as fold from customer),
s as (select fold, var_pop(y) as v from f group by fold),
b as (select h.fold, regr_slope(t.y, t.x) as b, regr_intercept(t.y, t.x) as a from f t join (select distinct fold from f) h on t.fold <> h.fold group by h.fold),
n as (select h.c_custkey, h.fold, h.y, t.y as ty, row_number() over (partition by h.c_custkey order by round(abs(h.x - t.x), 9), t.c_custkey) as rn from f h join f t on h.fold <> t.fold),
p as (select c_custkey, fold, any_value(y) as y, avg(ty) as pred from n where rn <= 5 group by 1, 2)
select 'linear_regression' as model_type, {whole('f.fold', 'fold')}, {num('1 - avg(power(f.y - b.a - b.b * f.x, 2)) / any_value(s.v)', 'score')} from f join b on f.fold = b.fold join s on f.fold = s.fold group by f.fold
union all select 'knn', {whole('p.fold', 'fold')}, {num('1 - avg(power(p.y - p.pred, 2)) / any_value(s.v)', 'score')} from p join s on p.fold = s.fold group by p.fold"""


@query("search_linear_knn", _search_sql())
def search_linear_knn(t: Tables) -> DataFrame:
    """Fold scores of a linear and a nearest-neighbour trial."""
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    found = models.random_search(rows, "c_custkey", ["x"], "y", "regression", {"linear_regression": [{}], "knn": [{"n_neighbors": 5}]})
    return found.select("model_type", F.posexplode("cv_scores").alias("fold", "score"))


@query("warmstart_trials")
def warmstart_trials(t: Tables) -> DataFrame:
    """Best parameters of runs like the customer table, then jittered copies."""
    from loomframe.operators import quality

    profile = history.profile_record(quality.dataset_profile(t.customer, "c_mktsegment").first())
    params = F.to_json(F.struct(F.col("n_rows").alias("n_estimators"), (F.col("n_features") % 10 + 3).alias("max_depth"), F.col("missing_ratio").alias("learning_rate")))
    runs = views.runs(t).withColumn("best_params", params)
    similar = history.similar_runs(runs, profile, 5)
    model = similar.orderBy(F.desc("similarity"), "run_id").first()["best_model"]
    trials = models.warmstart_trials(history.stored_params(similar, model), "gradient_boosting", 5)
    rows = [(i, model, {k: str(v) for k, v in p.items()}) for i, p in enumerate(trials)]
    made = t.spark.createDataFrame(rows, "trial bigint, model_type string, params map<string,string>")
    return made.select("trial", "model_type", F.explode("params").alias("name", "value"))


@query(
    "class_weights",
    f"""select {whole('quality', 'class')}, {whole('n', 'n')}, {num('t / cast(k * n as double)', 'weight')} from (
 select quality, n, sum(n) over () as t, count(*) over () as k from (select quality, count(*) as n from labels group by 1) c) x""",
)
def class_weights(t: Tables) -> DataFrame:
    return split.class_weights(t.labels, "quality")


def labelled(t: Tables) -> DataFrame:
    """Labelled documents with cheap numeric features."""
    length = F.char_length("text")
    doc = t.documents.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_count("text", F.lit(r"\s+")).cast("double").alias("n_spaces"),
        (F.regexp_count("text", F.lit(r"[^\p{L}\s]")) / F.greatest(length, F.lit(1))).alias("odd_share"),
    )
    return doc.join(t.labels, "doc_id")


DOC_FEATURES = ["n_chars", "n_spaces", "odd_share"]


def vectors(t: Tables, width: int = 64) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(width)]
    return t.embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


def _fit_rows(rows: DataFrame, key: str, features: list[str], label: str, family: str, params: dict | None = None, task: str = "classification") -> DataFrame:
    model = models.fit_model(rows, features, label, family, task, params)
    return models.predict(rows, model, [key, label])


@query("fit_logistic")
def fit_logistic(t: Tables) -> DataFrame:
    out = _fit_rows(labelled(t), "doc_id", DOC_FEATURES, "quality", "logistic_regression")
    return out.withColumn("probability", F.get("probability", F.lit(1)))


@query(
    "fit_linear",
    f"""select {num('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {num('regr_intercept(l_extendedprice, l_quantity)', 'intercept')}, {num('regr_r2(l_extendedprice, l_quantity)', 'r2')} from lineitem""",
)
def fit_linear(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_extendedprice")
    model = models.fit_model(rows, ["l_quantity"], "l_extendedprice", "linear_regression", "regression")
    fitted = model.stages[-1]
    scored = models.predict(rows, model, ["l_extendedprice"])
    error = metrics.regression_errors(scored, "l_extendedprice")
    return error.select(F.lit(float(fitted.coefficients[0])).alias("slope"), F.lit(float(fitted.intercept)).alias("intercept"), "r2")


def _line_errors(t: Tables, family: str, params: dict | None = None) -> DataFrame:
    rows = t.lineitem.select("l_extendedprice", *LINE_FEATURES)
    model = models.fit_model(rows, LINE_FEATURES, "l_extendedprice", family, "regression", params)
    return metrics.regression_errors(models.predict(rows, model, ["l_extendedprice"]), "l_extendedprice")


@query("fit_forest_c")
def fit_forest_c(t: Tables) -> DataFrame:
    rows, names = vectors(t)
    return _fit_rows(rows, "vec_id", names, "label", "random_forest").drop("probability")


@query("fit_forest_r")
def fit_forest_r(t: Tables) -> DataFrame:
    return _line_errors(t, "random_forest")


@query("fit_gbt_c")
def fit_gbt_c(t: Tables) -> DataFrame:
    return _fit_rows(labelled(t), "doc_id", DOC_FEATURES, "quality", "gradient_boosting").drop("probability")


@query("fit_gbt_r")
def fit_gbt_r(t: Tables) -> DataFrame:
    return _line_errors(t, "gradient_boosting")


@query("fit_gbt_preset")
def fit_gbt_preset(t: Tables) -> DataFrame:
    return _line_errors(t, "boosted_preset")


@query("fit_mlp")
def fit_mlp(t: Tables) -> DataFrame:
    rows, names = vectors(t)
    return _fit_rows(rows, "vec_id", names, "label", "mlp").drop("probability")


@query(
    "knn_classify",
    f"""with n as ({knn_sql(5)}), v as (select n.vec_id, e.label, count(*) as c from n join embeddings e on n.other = e.vec_id group by 1, 2)
select {whole('vec_id', 'vec_id')}, {whole('label', 'prediction')} from (select vec_id, label, row_number() over (partition by vec_id order by c desc, label) as rn from v) x where rn = 1""",
)
def knn_classify(t: Tables) -> DataFrame:
    near = neighbours.knn_join(t.embeddings, "vec_id", "embedding", 5)
    return neighbours.knn_predict(near, "vec_id", t.embeddings, "vec_id", "label")


@query(
    "knn_regress",
    f"""with n as ({knn_sql(5)}) select {whole('n.vec_id', 'vec_id')}, {num('sum(label / d) / sum(1 / d)', 'prediction')} from n join embeddings e on n.other = e.vec_id group by 1""",
)
def knn_regress(t: Tables) -> DataFrame:
    """Distance-weighted mean of the label."""
    near = neighbours.knn_join(t.embeddings, "vec_id", "embedding", 5)
    return neighbours.knn_predict(near, "vec_id", t.embeddings, "vec_id", "label", "distance", "regression")


# a fixed linear scorer over part
WEIGHTS = {"p_size": 0.4, "name_length": 1.5}
INTERCEPT = 880.0
PART_SQL = "(select p_partkey, p_retailprice as y, cast(p_size as double) as p_size, cast(length(p_name) as double) as name_length from part)"


def part_rows(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("p_size"), F.char_length("p_name").cast("double").alias("name_length")
    )


def linear_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", F.lit(INTERCEPT) + F.lit(0.4) * F.col("p_size") + F.lit(1.5) * F.col("name_length"))


BASES = {"linear": ("linear_regression", {}), "forest": ("random_forest", {})}


@query("stack")
def stack(t: Tables) -> DataFrame:
    return ensemble.stack(part_rows(t), "p_partkey", list(WEIGHTS), "y", "regression", BASES)


@query("ensemble_cv")
def ensemble_cv(t: Tables) -> DataFrame:
    return ensemble.ensemble_cv(part_rows(t), "p_partkey", list(WEIGHTS), "y", "regression", BASES)


def _forest(t: Tables):
    rows = t.lineitem.select("l_extendedprice", *LINE_FEATURES)
    return rows, models.fit_model(rows, LINE_FEATURES, "l_extendedprice", "random_forest", "regression")


@query("importance_builtin")
def importance_builtin(t: Tables) -> DataFrame:
    _, model = _forest(t)
    return explain.builtin_importance(t.spark, model, LINE_FEATURES)


def _permutation_sql() -> str:
    """The keyed bijection of ranks as ``permuted`` describes it, walked until it stays below n."""
    pred = "880 + 0.4 * {0} + 1.5 * {1}"
    one, two = ordering.MIX_PRIMES
    keys = [(f, r, *[k for part in ordering.permutation_keys(f"42:{r}:{f}") for k in part]) for f in WEIGHTS for r in range(5)]
    turns = ", ".join(f"('{row[0]}', {', '.join(map(str, row[1:]))})" for row in keys)
    names = "feature, rep, " + ", ".join(f"k{i}{j}" for i in range(ordering.MIX_ROUNDS) for j in range(3))

    def mixed(i: int, source: str) -> str:
        return f"((({source} * k{i}0 + k{i}1) % {one} * k{i}2 + k{i}1) % {two})"

    def rounds(x: str, source: str) -> str:
        """Four nested selects, a round each, over (row, column) of the place ``x``."""
        inner = f"select *, {x} // b as s0, {x} % b as s1 from {source}"
        for i in range(ordering.MIX_ROUNDS):
            own, other, width = f"s{i % 2}", f"s{1 - i % 2}", "b" if i % 2 else "a"
            inner = f"select * replace (({own} + {mixed(i, other)}) % {width} as {own}) from ({inner}) q{i}"
        return inner

    cells = f"place, n, a, b, {names}"
    size = "case when d.feature = 'p_size' then d.v else b.p_size end"
    name = "case when d.feature = 'name_length' then d.v else b.name_length end"
    return f"""with recursive p as materialized {PART_SQL},
b as materialized (select *, row_number() over (order by md5('42:' || cast(p_partkey as varchar)), p_partkey) - 1 as place from p),
z as (select n, a, cast(ceil(n / cast(a as double)) as bigint) as b from (select n, cast(floor(sqrt(n - 1)) as bigint) + 1 as a from (select count(*) as n from p) x) y),
t as (select * from (values {turns}) v({names})),
w as (
 select {cells}, s0 * b + s1 as goal from ({rounds('place', '(select b.place, z.*, t.* from b, z, t)')}) first
 union all
 select {cells}, s0 * b + s1 from ({rounds('goal', '(select * from w where goal >= n)')}) again
),
d as (select w.feature, w.rep, w.goal, case w.feature when 'p_size' then b.p_size else b.name_length end as v from w join b using (place) where w.goal < w.n),
r as (select 1 - avg(power(y - ({pred.format('p_size', 'name_length')}), 2)) / var_pop(y) as s from p),
s as (select feature, rep, 1 - avg(power(y - ({pred.format(size, name)}), 2)) / var_pop(y) as s from d join b on d.goal = b.place group by 1, 2)
select feature, {num('avg(r.s - s.s)', 'importance')}, {num('stddev_pop(r.s - s.s)', 'std')} from s, r group by 1"""


@query("importance_permutation", _permutation_sql())
def importance_permutation(t: Tables) -> DataFrame:
    return explain.permutation_importance(part_rows(t), "p_partkey", list(WEIGHTS), "y", linear_scorer)


@query("importance_compare")
def importance_compare(t: Tables) -> DataFrame:
    rows, forest = _forest(t)
    linear = models.fit_model(rows, LINE_FEATURES, "l_extendedprice", "linear_regression", "regression")
    named = {"forest": explain.builtin_importance(t.spark, forest, LINE_FEATURES), "linear": explain.builtin_importance(t.spark, linear, LINE_FEATURES)}
    return explain.compare_importances(named)


def _attribution_sql() -> str:
    base = "880 + 0.4 * avg(p_size) + 1.5 * avg(name_length)"
    return union(
        [
            f"""select '{f}' as feature, {num(f'avg(abs({w} * ({f} - m)))', 'mean_abs')}, {num(f'stddev_pop({w} * ({f} - m))', 'std')}, {num(base, 'base_value')}
 from {PART_SQL} p, (select avg({f}) as m from {PART_SQL} q) c"""
            for f, w in WEIGHTS.items()
        ]
    )


@query("attribution_summary", _attribution_sql())
def attribution_summary(t: Tables) -> DataFrame:
    return explain.attribution_summary(part_rows(t), WEIGHTS, INTERCEPT)


@query("attribution_sampled")
def attribution_sampled(t: Tables) -> DataFrame:
    """Sampled Shapley values of a forest over all parts."""
    rows = part_rows(t)
    model = models.fit_model(rows, list(WEIGHTS), "y", "random_forest", "regression")
    return explain.sampled_attributions(rows, "p_partkey", list(WEIGHTS), model, lambda d: F.col("prediction"), samples=4)


def _instance_sql() -> str:
    return union(
        [
            f"""select {whole('p_partkey', 'p_partkey')}, {num('880 + 0.4 * p_size + 1.5 * name_length', 'prediction')}, '{f}' as feature, {num(f, 'value')}, {num(f'{w} * ({f} - m)', 'contribution')}
 from {PART_SQL} p, (select avg({f}) as m from {PART_SQL} q) c where p_partkey = 7"""
            for f, w in WEIGHTS.items()
        ]
    )


@query("explain_instance", _instance_sql())
def explain_instance(t: Tables) -> DataFrame:
    return explain.explain_instances(part_rows(t), "p_partkey", F.col("p_partkey") == 7, WEIGHTS, INTERCEPT)


@query("explain_model")
def explain_model(t: Tables) -> DataFrame:
    rows, model = _forest(t)
    return explain.explain_model(rows, model, LINE_FEATURES, "l_extendedprice", "regression")


@query("model_card")
def model_card(t: Tables) -> DataFrame:
    rows = labelled(t)
    model = models.fit_model(rows, DOC_FEATURES, "quality", "logistic_regression", "classification")
    shown = explain.builtin_importance(t.spark, model, DOC_FEATURES)
    return explain.model_card(rows, models.predict(rows, model, ["quality"]), "logistic_regression", "quality", shown)


def order_model(t: Tables):
    """Preprocessor and classifier over orders, label = order status code."""
    codes = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)
    rows = t.orders.withColumn("label", codes).drop("o_orderstatus")
    state = preprocess.fit_preprocessor(rows, "o_orderkey", "label")
    ready = preprocess.apply_preprocessor(rows, state)
    return state, models.fit_model(ready, state.output_names(), "label", "logistic_regression", "classification")


@query("score_batch")
def score_batch(t: Tables) -> DataFrame:
    """New rows go through the stored preprocessor, then the model."""
    state, model = order_model(t)
    return scoring.score(t.orders.drop("o_orderstatus"), model, "o_orderkey", state, 3, "run-1", "logistic_regression")


def plane_sql(run: str, name: str) -> str:
    """Predictions of the least-squares plane over the two part features, in closed form."""
    return f"""with p as {PART_SQL},
s as (select avg(y) as my, avg(p_size) as m1, avg(name_length) as m2, var_pop(p_size) as v1, var_pop(name_length) as v2, covar_pop(p_size, name_length) as c, covar_pop(p_size, y) as c1, covar_pop(name_length, y) as c2 from p),
b as (select *, (v2 * c1 - c * c2) / (v1 * v2 - c * c) as b1, (v1 * c2 - c * c1) / (v1 * v2 - c * c) as b2 from s)
select {whole('p_partkey', 'p_partkey')}, {num('my + b1 * (p_size - m1) + b2 * (name_length - m2)', 'prediction')}, '{run}' as run_id, '{name}' as model_name from p, b"""


@query("score_file", plane_sql("", ""))
def score_file(t: Tables) -> DataFrame:
    rows = part_rows(t)
    model = models.fit_model(rows, list(WEIGHTS), "y", "linear_regression", "regression")
    source, sink = scratch_path(t.spark, "score-in") + ".csv", scratch_path(t.spark, "score-out") + ".csv"
    tables.write_table(rows, source)
    return scoring.score_file(t.spark, source, sink, rows.schema, model, "p_partkey")


def _tree_part_sql() -> str:
    """Path-dependent attributions of the depth-2 tree over two flags, from its four groups.

    The root splits on the flag that explains more; the other flag is split below it, so
    without the root flag a row follows both sides by their size.
    """
    rows = "(select p_partkey, p_retailprice as y, cast(p_size > 25 as int) as big, cast(length(p_name) > 18 as int) as long from part)"
    return f"""with p as {rows},
g as (select big, long, avg(y) as m, count(*) as n from p group by 1, 2),
t as (select avg(y) as m, count(*) as n from p),
a as (select big, avg(y) as m, count(*) as n from p group by 1),
b as (select long, avg(y) as m, count(*) as n from p group by 1),
r as (select (select sum(a.n * (a.m - t.m) * (a.m - t.m)) from a, t) >= (select sum(b.n * (b.m - t.m) * (b.m - t.m)) from b, t) as big_first),
f as (select p.*, t.m as f0, g.m as f12, case when big_first then a.m else (select sum(b2.n * coalesce(g2.m, b2.m)) / t.n from b b2 left join g g2 on g2.long = b2.long and g2.big = p.big) end as f1,
 case when big_first then (select sum(a2.n * coalesce(g2.m, a2.m)) / t.n from a a2 left join g g2 on g2.big = a2.big and g2.long = p.long) else b.m end as f2
 from p join g using (big, long) join a using (big) join b using (long), t, r),
c as (select *, (f1 - f0 + f12 - f2) / 2 as c1, (f2 - f0 + f12 - f1) / 2 as c2 from f)
select {whole('p_partkey', 'p_partkey')}, {num('f0', 'base')}, {num('f12', 'output')}, feature, {num('case when feature = ' + "'big'" + ' then big else long end', 'value')},
 {num('case when feature = ' + "'big'" + ' then c1 else c2 end', 'contribution')} from c cross join (values ('big'), ('long')) as v(feature)"""


@query("attribution_tree", _tree_part_sql())
def attribution_tree(t: Tables) -> DataFrame:
    flag = lambda test: test.cast("double")
    rows = t.part.select("p_partkey", F.col("p_retailprice").alias("y"), flag(F.col("p_size") > 25).alias("big"), flag(F.length("p_name") > 18).alias("long"))
    model = models.fit_model(rows, ["big", "long"], "y", "random_forest", "regression", {"n_estimators": 1, "max_depth": 2, "bootstrap": False})
    return treeparts.tree_attributions(rows, "p_partkey", ["big", "long"], model)


@query("attribution_forest")
def attribution_forest(t: Tables) -> DataFrame:
    """Exact contributions in a forest; base and contributions add up to the prediction."""
    rows = part_rows(t)
    model = models.fit_model(rows, list(WEIGHTS), "y", "random_forest", "regression")
    return treeparts.tree_attributions(rows, "p_partkey", list(WEIGHTS), model)
