"""Feature engineering with Spark ML and built-in column functions."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from quarry.operators.association import chi_rank
from quarry.operators.profile import QUARTILES
from quarry.operators.quantiles import exact_quantiles

# Bin labels and the rule-bin thresholds of the loan job.
QUARTILE_LABELS = ("min-Q1", "Q1-Q2", "Q2-Q3", "Q3-max")
ZERO_LABELS = ("0", ">0")
TERM_THRESHOLD = 360
TERM_LABELS = ("<360", "360", ">360")
#: Labels a column may have before ``string_index`` refuses it (its model lists them all).
MAX_LABELS = 100_000


def derived_sum(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``name = a + b`` (null when either is null)."""
    return df.withColumn(name, F.col(a) + F.col(b))


def log_features(df: DataFrame, cols: list[str], suffix: str = "Log",
                 ndigits: int | None = None) -> DataFrame:
    """``log(1 + x)`` copies of numeric columns."""
    for c in cols:
        v = F.log1p(c)
        df = df.withColumn(f"{c}{suffix}", v if ndigits is None else F.round(v, ndigits))
    return df


def impute(df: DataFrame, cols: list[str], strategy: str = "mean",
           out_cols: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Spark ML ``Imputer`` (null and NaN are missing). ``mode`` breaks ties
    towards the smallest value. One fit pass for all columns, on ``fit_on``
    (default: ``df`` itself)."""
    out_cols = out_cols or [f"{c}_imp" for c in cols]

    def as_double(x: DataFrame) -> DataFrame:  # the imputer wants float columns
        return x.withColumns({c: F.col(c).cast("double") for c in cols})

    d = as_double(df)
    model = Imputer(strategy=strategy, inputCols=cols, outputCols=out_cols).fit(
        d if fit_on is None else as_double(fit_on))
    return model.transform(d)


def string_modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column (ties: the smallest), all
    columns in one grouped pass; one value per column reaches the driver."""
    from quarry.operators.profile import unpivot_text
    counts = (unpivot_text(df, cols).filter(F.col("value").isNotNull())
              .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("variable").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))
    return {r["variable"]: r["mode"] for r in best.collect()}


def impute_string_mode(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None
                       ) -> DataFrame:
    """Fill nulls of text columns with their mode (fitted on ``fit_on``)."""
    modes = string_modes(df if fit_on is None else fit_on, cols)
    return df.fillna({c: v for c, v in modes.items() if v is not None})


def quartile_thresholds(df: DataFrame, col: str, relative_error: float = 0.0) -> list[float]:
    """``[q1, q2, q3, max]``: exact order statistics (rank ceil(p*n)) by
    default, like a zero-error ``approxQuantile``; a positive error uses the
    GK sketch alone. Four numbers come back to the driver."""
    x = F.col(col).cast("double")
    if relative_error > 0:
        acc = int(round(1 / relative_error))
        row = df.agg(*[F.percentile_approx(x, p, acc).alias(f"q{i}")
                       for i, p in enumerate(QUARTILES)], F.max(x).alias("mx")).first()
        return [row["q0"], row["q1"], row["q2"], row["mx"]]
    probs = tuple(QUARTILES) + (1.0,)  # rank n at p = 1 is the maximum
    qs = {r["p"]: r["value"] for r in exact_quantiles(df, [col], probs, False).collect()}
    return [qs.get(p) for p in probs]


def quartile_bins(df: DataFrame, col: str, out: str, thresholds: list[float] | None = None,
                  relative_error: float = 0.0) -> DataFrame:
    """Right-closed quartile bins ``min-Q1, Q1-Q2, Q2-Q3, Q3-max``; null and NaN get null.
    The last bin is open, so thresholds fitted on some rows place all others."""
    t = thresholds or quartile_thresholds(df, col, relative_error)
    x = F.col(col)
    expr = F.when(x <= t[0], QUARTILE_LABELS[0])
    for lim, lab in zip(t[1:-1], QUARTILE_LABELS[1:-1]):
        expr = expr.when(x <= lim, lab)
    last = F.when(x.isNotNull() & ~F.isnan(x.cast("double")), QUARTILE_LABELS[-1])
    return df.withColumn(out, expr.otherwise(last))


def zero_bin(df: DataFrame, col: str, out: str) -> DataFrame:
    """``'0'`` for zero, ``'>0'`` otherwise (null included, as the job does)."""
    return df.withColumn(out, F.when(F.col(col) == 0, ZERO_LABELS[0]).otherwise(ZERO_LABELS[1]))


def term_bin(df: DataFrame, col: str, out: str, threshold: float = TERM_THRESHOLD) -> DataFrame:
    """``<360``, ``360``, ``>360``; null stays null."""
    x = F.col(col)
    return df.withColumn(out, F.when(x < threshold, TERM_LABELS[0])
                         .when(x == threshold, TERM_LABELS[1])
                         .when(x > threshold, TERM_LABELS[2])
                         .otherwise(F.lit(None).cast("string")))


def string_index(df: DataFrame, cols: list[str], out_cols: list[str] | None = None,
                 handle_invalid: str = "keep", fit_on: DataFrame | None = None,
                 max_labels: int = MAX_LABELS):
    """One multi-column ``StringIndexer`` fit (frequency descending, ties
    alphabetical; with ``keep`` a null or unseen value gets index = number of
    labels). Returns ``(frame, model)``. The model holds every label in the driver,
    so a column with (about, to 5%) more than ``max_labels`` of them raises first."""
    out_cols = out_cols or [f"{c}_idx" for c in cols]
    about = (df if fit_on is None else fit_on).agg(
        *[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    wide = {c: about[c] for c in cols if about[c] > max_labels}
    if wide:
        raise ValueError(f"too many labels to index (limit {max_labels}): {wide}")
    model = StringIndexer(inputCols=cols, outputCols=out_cols, handleInvalid=handle_invalid,
                          stringOrderType="frequencyDesc").fit(df if fit_on is None else fit_on)
    return model.transform(df), model


def one_hot(df: DataFrame, cols: list[str], out_cols: list[str] | None = None,
            drop_last: bool = True, handle_invalid: str = "error", fit_on: DataFrame | None = None):
    out_cols = out_cols or [f"{c}_vec" for c in cols]
    model = OneHotEncoder(inputCols=cols, outputCols=out_cols, dropLast=drop_last,
                          handleInvalid=handle_invalid).fit(df if fit_on is None else fit_on)
    return model.transform(df), model


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def chi_select(df: DataFrame, features: list[str], label: str, k: int, out: str = "selected",
               fit_on: DataFrame | None = None):
    """Assemble the ``k`` of the categorical ``features`` (columns) that depend most on the
    categorical label, by :func:`quarry.operators.association.chi_rank` over ``fit_on`` (default: ``df``
    itself), in the order given. Returns ``(frame, selected feature indices)``."""
    chosen = chi_rank(df if fit_on is None else fit_on, features, label).filter(F.col("rank") <= k)
    places = sorted(r["place"] for r in chosen.collect())  # at most k
    return assemble(df, [features[i] for i in places], out), places
