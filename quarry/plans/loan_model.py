"""The loan job as one stored model: every preparation step and the classifier are
stages of a ``PipelineModel``, fitted once, saved, and applied to rows never seen."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import features as fe, model as md
from quarry.operators.association import chi_rank
from quarry.plans.loan_job import LoanRoles
from quarry.session import scratch_path


def _with(**columns: str) -> SQLTransformer:
    added = ", ".join(f"{sql} AS `{name}`" for name, sql in columns.items())
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _bin_sql(column: str, limits: list[float]) -> str:
    q1, q2, q3 = (repr(float(x)) + "D" for x in limits[:3])
    a, b, c, d = (_text(x) for x in fe.QUARTILE_LABELS)
    return (f"CASE WHEN {column} <= {q1} THEN {a} WHEN {column} <= {q2} THEN {b} WHEN {column} <= {q3} THEN {c} "
            f"WHEN {column} IS NOT NULL AND NOT isnan({column}) THEN {d} END")


class _Builder:
    """Stages fitted one after the other, each on the training rows as the stages before leave them."""

    def __init__(self, train: DataFrame):
        self.rows, self.stages = train, []

    def add(self, stage) -> None:
        model = stage.fit(self.rows) if isinstance(stage, Estimator) else stage
        self.stages.append(model)
        self.rows = model.transform(self.rows)

    def store(self) -> None:
        """Later fits read stored rows, so a lost executor costs no chain of fits."""
        path = scratch_path(self.rows.sparkSession, "loan-model")
        schema = self.rows.schema
        self.rows.write.parquet(path)
        self.rows = self.rows.sparkSession.read.schema(schema).parquet(path)


def fit(train: DataFrame, roles: LoanRoles | None = None) -> PipelineModel:
    """The fitted model of the training rows (those without a label do not train). Its
    result columns are the prepared features, ``probability``, ``prediction`` (index of the label) and
    ``predicted`` (the label as text). Scoring needs no label column.

    Missing values: numbers are imputed (mean of the logarithm, else mode), missing or unknown categories
    are an index of their own, or the mode with ``impute_first``."""
    r = roles or LoanRoles()
    b = _Builder(train.filter(F.col(r.label).isNotNull()))
    labels = StringIndexer(inputCol="_label_s", outputCol="label_idx", stringOrderType="frequencyDesc").fit(
        b.rows.select(F.col(r.label).cast("string").alias("_label_s"))).labels
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(r.label).cast("string")) - 1
    b.rows = b.rows.withColumn("label_idx", index.cast("double"))

    b.add(_with(**{f"{c}_log": f"ln(1 + CAST({c} AS DOUBLE))" for c in r.log_binned},
                **{f"{c}_term": f"CAST({c} AS DOUBLE)" for c in r.term_binned},
                **{f"{c}_number": f"CAST({c} AS DOUBLE)" for c in r.mode_imputed}))
    b.add(Imputer(strategy="mean", inputCols=[f"{c}_log" for c in r.log_binned],
                  outputCols=[f"{c}_log_imp" for c in r.log_binned]))
    moded = [f"{c}_term" for c in r.term_binned] + [f"{c}_number" for c in r.mode_imputed]
    b.add(Imputer(strategy="mode", inputCols=moded, outputCols=[f"{c}_imp" for c in moded]))
    b.store()
    text = {c: f"CAST({c} AS STRING)" for c in r.categorical}
    if r.impute_first:
        modes = fe.string_modes(b.rows, list(r.categorical))
        text = {c: sql if modes.get(c) is None else f"coalesce({sql}, {_text(modes[c])})" for c, sql in text.items()}
    bins = {f"{c}_cat": sql for c, sql in text.items()}
    bins |= {f"{c}_qcat": _bin_sql(f"{c}_log_imp", fe.quartile_thresholds(b.rows, f"{c}_log_imp")) for c in r.log_binned}
    zero, more = (_text(x) for x in fe.ZERO_LABELS)
    bins |= {f"{c}_zcat": f"CASE WHEN {c} = 0 THEN {zero} ELSE {more} END" for c in r.zero_binned}
    below, at, above = (_text(x) for x in fe.TERM_LABELS)
    bins |= {f"{c}_tcat": f"CASE WHEN {c}_term_imp < {fe.TERM_THRESHOLD} THEN {below} WHEN {c}_term_imp = "
                          f"{fe.TERM_THRESHOLD} THEN {at} WHEN {c}_term_imp > {fe.TERM_THRESHOLD} THEN {above} END"
             for c in r.term_binned}
    b.add(_with(**bins))
    cats = list(bins)
    b.add(StringIndexer(inputCols=cats, outputCols=[f"{c}_idx" for c in cats], handleInvalid="keep",
                        stringOrderType="frequencyDesc"))
    b.store()
    candidates = [f"{c}_idx" for c in cats] + [f"{c}_number_imp" for c in r.mode_imputed]
    ranked = chi_rank(b.rows, candidates, "label_idx").filter(F.col("rank") <= r.top_k)
    chosen = [candidates[x["place"]] for x in ranked.orderBy("place").collect()]
    coded = [c for c in chosen if c.endswith("_idx")]
    if coded:
        b.add(OneHotEncoder(inputCols=coded, outputCols=[f"{c}_enc" for c in coded], handleInvalid="keep"))
    b.add(VectorAssembler(inputCols=[f"{c}_enc" if c in coded else c for c in chosen], outputCol="loan_features"))
    b.add(LogisticRegression(featuresCol="loan_features", labelCol="label_idx"))
    b.add(IndexToString(inputCol="prediction", outputCol="predicted", labels=labels))
    return PipelineModel(b.stages)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the prepared columns, ``score`` (probability of label index 1) and ``predicted``."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def trained_and_scored(df: DataFrame, roles: LoanRoles | None = None) -> DataFrame:
    """Fit on the training side of the key-hash split, save, load, and score all rows,
    those without a label included; ``same`` tells whether the loaded model's score is that of the fitted one."""
    r = roles or LoanRoles()
    split = md.hash_split(df, r.key, r.train_percent, r.seed)
    fitted = fit(split.filter("is_train"), r)
    path = scratch_path(df.sparkSession, "loan-pipeline")
    save(fitted, path)
    # the fitted model's score beside the loaded one's, on the very same rows
    direct = score(fitted, split).select(*split.columns, F.col("score").alias("direct"))
    return score(load(df.sparkSession, path), direct).withColumn("same", F.col("score") == F.col("direct"))
