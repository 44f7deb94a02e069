"""The exploratory profile of a table as one job: every statistic the loan
notebook looked at, each computed by a Spark aggregation over the whole
table (no driver-side copy). Returns named result frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarry.operators import profile as pf


def profile_table(df: DataFrame, key: str | None = None, label: str | None = None,
                  numeric: list[str] | None = None, categorical: list[str] | None = None
                  ) -> dict[str, DataFrame]:
    skip = tuple(c for c in (key, label) if c)
    numeric = numeric if numeric is not None else pf.numeric_columns(df, skip)
    categorical = (categorical if categorical is not None
                   else pf.categorical_columns(df, skip))
    out = {"shape": pf.row_column_count(df), "missing": pf.missing_counts(df)}
    if key:
        out["key_distinct"] = pf.distinct_count(df, key)
    if numeric:
        out.update({
            "describe": pf.describe(df, numeric),
            "quartiles": pf.quantiles(df, numeric),
            "moments": pf.skew_kurtosis(df, numeric),
            "outliers": pf.iqr_outliers(df, numeric),
            "correlation": pf.correlation_matrix(df, numeric),
        })
    if categorical:
        out["value_counts"] = pf.value_counts(df, categorical)
    if label:
        if categorical:
            out["class_counts"] = pf.class_counts(df, categorical, label)
        if numeric:
            parts = [pf.five_number_by_class(df, c, label)
                     .select(F.lit(c).alias("variable"), "*") for c in numeric]
            out["five_number_by_class"] = reduce(DataFrame.unionByName, parts)
    return out
