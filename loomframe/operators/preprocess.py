"""Default and advanced preprocessing: fitted once, applied to any table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from loomframe.functions import columns as C
from loomframe.operators import encode, features, impute, outliers, quality, scale
from loomframe.session import materialize


def split_target(df: DataFrame, target: str | None = None) -> tuple[list[str], str]:
    """Feature columns and target; the last column when none is named."""
    target = target or df.columns[-1]
    return [c for c in df.columns if c != target], target


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(key).limit(n)


@dataclass
class Preprocessor:
    """Fitted state of the default steps; every part is bounded by the schema."""

    key: str
    target: str | None
    types: dict[str, str]
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    fills: dict = field(default_factory=dict)
    onehot: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    fences: dict = field(default_factory=dict)
    missing: dict = field(default_factory=dict)

    def output_names(self) -> list[str]:
        hot = [f"{c}_{v}" for c, s in self.onehot.items() for v in s["columns"]]
        parts = [f"{c}_{p}" for c in self.datetime for p in ("year", "month", "day", "dayofweek", "hour", "minute")]
        return [*self.numeric, *hot, *parts]


def fit_preprocessor(
    df: DataFrame,
    key: str,
    target: str | None = None,
    impute_strategy: str = "median",
    scaler: str = "standard",
    max_categories: int | None = 50,
    clip: bool = True,
) -> Preprocessor:
    """types -> impute -> dates -> one-hot -> scale -> clip, in that order."""
    types = quality.type_map(df, key)
    feature = [c for c in df.columns if c not in (key, target)]
    state = Preprocessor(
        key,
        target,
        types,
        [c for c in feature if types[c] == "numeric"],
        [c for c in feature if types[c] in ("categorical", "text")],
        [c for c in feature if types[c] == "datetime"],
    )
    if feature:
        state.missing = C.wide_aggregate(df, [F.count_if(C.is_missing(df, c)).alias(c) for c in feature])
    state.fills = impute.fit_imputer(df, state.numeric, state.categorical, impute_strategy)
    filled = impute.apply_imputer(df, state.fills)
    state.onehot = encode.fit_onehot(filled, state.categorical, max_categories)
    if state.numeric:
        state.scaler = scale.fit_scaler(filled, state.numeric, scaler)
        if clip:
            # fences of the scaled column: quartiles move with a linear map
            raw = outliers.iqr_fences(filled, state.numeric, guarded=False)
            state.fences = {
                c: tuple((edge - state.scaler[c][0]) / state.scaler[c][1] for edge in raw[c]) for c in raw if c in state.scaler
            }
    return state


def apply_preprocessor(df: DataFrame, state: Preprocessor) -> DataFrame:
    """A single projection over the table: no shuffle, no join."""
    out = impute.apply_imputer(df, state.fills)
    out = features.expand_datetime(out, state.datetime)
    out = encode.apply_onehot(out, state.onehot)
    if state.scaler:
        out = scale.apply_scaler(out, state.scaler)
    if state.fences:
        out = outliers.clip_outliers(out, list(state.fences), state.fences)
    names = state.output_names()
    kept = [state.key] + ([state.target] if state.target and state.target in df.columns else [])
    return out.select(*kept, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in names])


def preprocess_info(df: DataFrame, state: Preprocessor) -> DataFrame:
    """What was fitted, as long rows (section, name, value)."""
    rows = [("type", c, t) for c, t in state.types.items()]
    rows += [("missing", c, str(n)) for c, n in state.missing.items()]
    rows += [("output", n, str(i)) for i, n in enumerate(state.output_names())]
    report = df.sparkSession.createDataFrame(rows, "section string, name string, value string")
    if state.numeric:
        found = outliers.iqr_counts(df, state.numeric)
        found = found.select(F.lit("outliers").alias("section"), F.col("column_name").alias("name"), F.col("n_outliers").cast("string").alias("value"))
        report = report.unionByName(found)
    return report


@dataclass
class AdvancedPreprocessor:
    key: str
    target: str
    text: str
    vocabulary: object
    word_model: object
    polynomial: object
    fences: dict
    selected: list[str]


def _expand(df: DataFrame, state: AdvancedPreprocessor) -> DataFrame:
    """Text features, and polynomial terms once they are fitted; a projection without a job."""
    from loomframe.operators import textfeatures as TF

    out = TF.length_features(df, state.text, f"{state.text}_")
    if state.vocabulary is not None:
        out = TF.tfidf_columns(out, state.key, F.col(state.text), state.vocabulary, f"{state.text}_tfidf_")
    if state.word_model is not None:
        arr = out.withColumn("__e", state.word_model.average(TF.hashed_words(F.col(state.text), state.word_model.buckets)))
        out = arr.withColumns({f"{state.text}_embed_{i}": F.get("__e", F.lit(i)) for i in range(state.word_model.size)}).drop("__e")
    return features.apply_polynomial(out, state.polynomial) if state.polynomial else out


def fit_advanced(
    df: DataFrame,
    key: str,
    target: str,
    text: str,
    use_text: bool = True,
    use_embedding: bool = True,
    use_polynomial: bool = True,
    use_outliers: bool = True,
    k: int = 10,
    max_features: int = 50,
) -> AdvancedPreprocessor:
    """text -> embeddings -> polynomial -> outliers -> selection, fitted in order."""
    from loomframe.operators import textfeatures as TF

    vocabulary = TF.fit_tfidf(df, [F.col(text)], max_features, bigrams=True, plain=True, max_df=0.95) if use_text else None
    model = TF.word_vectors(df, key, text, size=8) if use_embedding else None
    lengths = [f"{text}_{c}" for c in ("char_count", "word_count", "sentence_count", "avg_word_length")]
    state = AdvancedPreprocessor(key, target, text, vocabulary, model, None, {}, [])
    if use_polynomial:
        state.polynomial = features.fit_polynomial(TF.length_features(df, text, f"{text}_"), lengths)
    # text features are computed once; fences and scores read them back
    wide = _expand(df, state)
    names = [c for c in C.numeric_columns(wide) if c not in (key, target)]
    wide = materialize(wide.select(key, target, *[F.col(f"`{c}`") for c in names]), "advanced")
    if use_outliers:
        state.fences = outliers.iqr_fences(wide, names)
        wide = outliers.clip_outliers(wide, list(state.fences), state.fences)
    scores = features.f_scores(wide, names, target)
    state.selected = [r["column_name"] for r in features.top_k(scores, k).where("selected").orderBy("rank").collect()]
    return state


def apply_advanced(df: DataFrame, state: AdvancedPreprocessor) -> DataFrame:
    wide = _expand(df, state)
    wide = outliers.clip_outliers(wide, list(state.fences), state.fences)
    kept = [state.key] + ([state.target] if state.target in df.columns else [])
    return wide.select(*kept, *[F.col(f"`{c}`").cast("double").alias(c) for c in state.selected])
