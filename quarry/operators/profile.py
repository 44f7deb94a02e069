"""Tabular profiling on Spark: every statistic for every column in one
aggregation pass, reshaped to long rows with ``stack``.

Rounding: float results are rounded to ``ndigits`` (6 by default) so that
results are comparable across engines whose summation order differs.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.functions.predicates import missing_counts_exprs
from quarry.operators.quantiles import exact_quantiles, quantile_row

QUARTILES = (0.25, 0.5, 0.75)


def _r(c: Column, ndigits: int | None) -> Column:
    return c if ndigits is None else F.round(c, ndigits)


def _stack(row: DataFrame, cols: list[str], fields: list[str], var: str = "variable"
           ) -> DataFrame:
    """One wide row with ``{col}__{field}`` columns -> one row per column."""
    items = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{f}`" for f in fields) for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {items}) AS ({var}, {', '.join(fields)})")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# ---------------------------------------------------------------- counts
def row_column_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def distinct_count(df: DataFrame, col: str, approximate: bool = False,
                   relative_sd: float = 0.01) -> DataFrame:
    """Number of distinct values, null counted as a value (unlike
    ``countDistinct``). ``approximate`` uses the HyperLogLog++ sketch
    (bounded memory, one pass, no shuffle of the values) plus one for null."""
    if approximate:
        has_null = F.max(F.col(col).isNull().cast("int"))
        return df.agg((F.approx_count_distinct(col, relative_sd) + has_null)
                      .cast("long").alias("n_distinct"))
    return df.select(col).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def group_count(df: DataFrame, col: str) -> DataFrame:
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last(col)))


def missing_counts(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row, one column per input column: number of missing values."""
    return df.agg(*missing_counts_exprs(df, exact))


def numeric(c: str) -> Column:
    """A numeric column as double with NaN as missing. Spark orders NaN above every
    number and lets it spread through sums; the profile treats it like null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


# ---------------------------------------------------------------- moments
def describe(df: DataFrame, cols: list[str], ndigits: int | None = 6) -> DataFrame:
    """``variable, count, mean, stddev, min, max`` (sample stddev)."""
    aggs = []
    for c in cols:
        x = numeric(c)
        aggs += [F.count(x).alias(f"{c}__count"), _r(F.avg(x), ndigits).alias(f"{c}__mean"),
                 _r(F.stddev_samp(x), ndigits).alias(f"{c}__stddev"),
                 _r(F.min(x), ndigits).alias(f"{c}__min"), _r(F.max(x), ndigits).alias(f"{c}__max")]
    return _stack(df.agg(*aggs), cols, ["count", "mean", "stddev", "min", "max"])


def skew_kurtosis(df: DataFrame, cols: list[str], ndigits: int | None = 6) -> DataFrame:
    """``variable, skewness, kurtosis`` (population skewness, excess kurtosis)."""
    aggs = []
    for c in cols:
        x = numeric(c)
        aggs += [_r(F.skewness(x), ndigits).alias(f"{c}__skewness"),
                 _r(F.kurtosis(x), ndigits).alias(f"{c}__kurtosis")]
    return _stack(df.agg(*aggs), cols, ["skewness", "kurtosis"])


# ---------------------------------------------------------------- quantiles
def quantiles(df: DataFrame, cols: list[str], probs=QUARTILES, interpolate: bool = True,
              relative_error: float = 0.0, ndigits: int | None = 6,
              names: tuple[str, ...] = ("q1", "q2", "q3")) -> DataFrame:
    """``variable, q1, q2, q3`` for many columns.

    ``interpolate=True``: linear interpolation between order statistics;
    ``False``: the stored value at rank ceil(p*n) (what a zero-error
    ``approxQuantile`` returns). Exact by default, computed without gathering
    a column's distinct values in one task (quarry.operators.quantiles);
    ``relative_error > 0`` returns the GK sketch's answer in one pass.
    """
    if relative_error > 0:
        acc = int(round(1.0 / relative_error))
        aggs = [_r(F.percentile_approx(numeric(c), p, acc), ndigits)
                .alias(f"{c}__{n}") for c in cols for p, n in zip(probs, names)]
        return _stack(df.agg(*aggs), cols, list(names))
    long = exact_quantiles(df, cols, probs, interpolate)
    row = quantile_row(long, cols, probs, names)
    row = row.select(*[_r(F.col(c), ndigits).alias(c) for c in row.columns])
    return _stack(row, cols, list(names))


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """One row: ``{c}__lo, {c}__hi`` = Q1 - k*IQR, Q3 + k*IQR (interpolated)."""
    long = exact_quantiles(df, cols, (0.25, 0.75), True)
    row = quantile_row(long, cols, (0.25, 0.75), ("q1", "q3"))
    out = []
    for c in cols:
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        out += [(q1 - F.lit(k) * (q3 - q1)).alias(f"{c}__lo"),
                (q3 + F.lit(k) * (q3 - q1)).alias(f"{c}__hi")]
    return row.select(*out)


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """``variable, total_outliers, low_outliers, high_outliers``.

    Two aggregation passes (bounds, then counts); the bounds are a one-row
    scalar subquery, evaluated once and inlined, so there is no join."""
    b = iqr_bounds(df, cols, k)
    bounds = b.select(F.struct(*b.columns).alias("b")).scalar()
    aggs = []
    for c in cols:
        x = numeric(c)
        lo, hi = bounds[f"{c}__lo"], bounds[f"{c}__hi"]
        aggs += [F.count(F.when((x < lo) | (x > hi), 1)).alias(f"{c}__total_outliers"),
                 F.count(F.when(x < lo, 1)).alias(f"{c}__low_outliers"),
                 F.count(F.when(x > hi, 1)).alias(f"{c}__high_outliers")]
    return _stack(df.agg(*aggs), cols, ["total_outliers", "low_outliers", "high_outliers"])


def outlier_flags(df: DataFrame, cols: list[str], keep: list[str], k: float = 1.5) -> DataFrame:
    """Per row 0/1 flags ``{c}_out, {c}_low, {c}_high`` (null and NaN compare false)."""
    b = iqr_bounds(df, cols, k)
    bounds = b.select(F.struct(*b.columns).alias("b")).scalar()
    out = [F.col(c) for c in keep]
    for c in cols:
        x = numeric(c)
        lo, hi = bounds[f"{c}__lo"], bounds[f"{c}__hi"]
        low = F.coalesce(x < lo, F.lit(False))
        high = F.coalesce(x > hi, F.lit(False))
        out += [(low | high).cast("int").alias(f"{c}_out"), low.cast("int").alias(f"{c}_low"),
                high.cast("int").alias(f"{c}_high")]
    return df.select(*out)


# ---------------------------------------------------------------- relationships
def correlation_matrix(df: DataFrame, cols: list[str], ndigits: int | None = 6) -> DataFrame:
    """``var_a, var_b, r`` for every ordered pair (Pearson, pairwise-complete),
    all pairs in one aggregation."""
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(_r(F.corr(numeric(a), numeric(b)), ndigits)
                        .alias(f"{a}__{b}"))
    row = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            pairs.append(f"'{a}', '{b}', `{a}__{b}`")
            if a != b:
                pairs.append(f"'{b}', '{a}', `{a}__{b}`")
    return row.selectExpr(f"stack({len(pairs)}, {', '.join(pairs)}) AS (var_a, var_b, r)")


def unpivot_text(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """Categorical columns to ``ids..., variable, value`` rows (value as text)."""
    d = df.select(*(ids or []), *[F.col(c).cast("string").alias(c) for c in cols])
    return d.unpivot(ids or [], cols, "variable", "value")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``variable, value, count`` for many categorical columns in one
    shuffle; the null value's count is the column's missing count."""
    return (unpivot_text(df, cols).groupBy("variable", "value")
            .agg(F.count(F.lit(1)).alias("count")))


def class_counts(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """``variable, value, <label>, count``: category counts split by label."""
    return (unpivot_text(df, cols, [label]).groupBy("variable", "value", label)
            .agg(F.count(F.lit(1)).alias("count")))


def five_number_by_class(df: DataFrame, col: str, label: str, ndigits: int | None = 6) -> DataFrame:
    """``label, min, q1, median, q3, max`` of ``col`` per label value: the
    order statistics at p = 0, .25, .5, .75, 1 from one exact-quantile job."""
    names = ("min", "q1", "median", "q3", "max")
    probs = (0.0,) + tuple(QUARTILES) + (1.0,)
    long = exact_quantiles(df, [col], probs, True, by=[label])
    stats = long.groupBy(F.col(label).alias("_g")).agg(
        *[_r(F.max(F.when(F.col("p") == p, F.col("value"))), ndigits).alias(n)
          for p, n in zip(probs, names)])
    # labels whose values are all null keep a row of nulls
    groups = df.select(label).distinct()
    return (groups.join(stats, F.col(label).eqNullSafe(F.col("_g")), "left")
            .select(label, *names))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way contingency table, one row per ``a`` value and one column per
    ``b`` value (Spark caps the distinct ``b`` values it will pivot). Rows with a null on
    either side are left out."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).stat.crosstab(a, b)


def _wide_contingency(df: DataFrame, features: list[str], label: str):
    """Features unpivoted, counted per ``(variable, value)`` and pivoted on
    the label values (collected once; Spark checks their number against
    ``spark.sql.pivotMaxValues``). Rows with a null label or feature value are left out,
    as in :func:`crosstab`.
    Returns the wide frame and its label columns."""
    u = unpivot_text(df.filter(F.col(label).isNotNull()), features, [label]).filter("value IS NOT NULL")
    wide = u.groupBy("variable", "value").pivot(label).agg(F.count(F.lit(1))).na.fill(0)
    return wide, [c for c in wide.columns if c not in ("variable", "value")]


def contingency(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Long contingency tables of many features against one label, over each
    feature's full grid: ``variable, value, label, observed, row_total``
    (zero cells included; one shuffle for all features)."""
    wide, labels = _wide_contingency(df, features, label)
    row_total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in labels])
    wide = wide.withColumn("_row_total", row_total)
    return (wide.unpivot(["variable", "value", "_row_total"], [F.col(f"`{c}`") for c in labels],
                         "label", "observed")
            .select("variable", "value", "label", F.col("observed").cast("long"),
                    F.col("_row_total").cast("long").alias("row_total")))


def _with_expected(c: DataFrame) -> DataFrame:
    """Adds ``e`` = row total * column total / n. Column totals and n are
    grouped per (variable, label): #features x #labels rows, bounded by the
    pivot cap, so they are broadcast; no window gathers a feature's table."""
    col_t = c.groupBy("variable", "label").agg(F.sum("observed").alias("col_total"))
    n = col_t.groupBy("variable").agg(F.sum("col_total").alias("n"),
                                      F.count(F.lit(1)).alias("n_labels"))
    tot = col_t.join(n, "variable")
    e = c.join(F.broadcast(tot), ["variable", "label"])
    return e.select("variable", "value", "label", "observed", "n", "n_labels",
                    (F.col("row_total") * F.col("col_total") / F.col("n")).alias("e"))


def expected_frequencies(df: DataFrame, a: str, b: str, ndigits: int | None = 6) -> DataFrame:
    """``a, b, observed, expected`` for the full grid of ``a`` x ``b``."""
    e = _with_expected(contingency(df, [a], b))
    return e.select(F.col("value").alias("a"), F.col("label").alias("b"), "observed",
                    _r(F.col("e"), ndigits).alias("expected"))


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, P(X >= x), for integer dof.
    A vectorised (Arrow-batched) helper applied to the tiny test-result rows."""
    return _chi2_sf_udf()(x.cast("double"), dof.cast("long"))


def _chi2_sf_udf():
    # Built inside a function so it pickles by value: executors need not
    # import this package.
    import math

    def sf(x: float, k: int) -> float:
        if x is None or k is None or k <= 0 or math.isnan(x):
            return float("nan")
        if x <= 0:
            return 1.0
        # regularised incomplete gamma function, the large factor kept as a logarithm
        a, h = k / 2.0, x / 2.0
        log_front = a * math.log(h) - h - math.lgamma(a)
        if h < a + 1.0:  # lower tail: h^a e^-h / Gamma(a) * sum h^i / (a (a+1) ... (a+i))
            term = total = 1.0 / a
            i = a
            while term > total * 1e-17:
                i += 1.0
                term *= h / i
                total += term
            return max(0.0, 1.0 - math.exp(log_front) * total)
        # upper tail: a continued fraction, evaluated from the front
        b = h + 1.0 - a
        c, d = 1e300, 1.0 / b
        f = d
        for i in range(1, 100_000):
            step = i * (a - i)
            b += 2.0
            d = 1.0 / (b + step * d)
            c = b + step / c
            f *= c * d
            if abs(c * d - 1.0) < 1e-16:
                break
        return min(1.0, math.exp(log_front) * f)

    @F.pandas_udf(T.DoubleType())
    def chi2_upper(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([sf(a, int(b)) if pd.notna(a) and pd.notna(b) else None
                          for a, b in zip(x, k)], dtype="float64")

    return chi2_upper
