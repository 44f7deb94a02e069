"""The type-aware missing-value predicate of the profiling job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text markers that count a string value as missing.
MISSING_MARKERS = ("None", "NULL")


def missing_value(name: str, dtype: T.DataType, exact: bool = False) -> Column:
    """True when the value counts as missing.

    strings: null, empty, or containing ``None`` / ``NULL`` (substring match, so
    ``Nonesuch`` counts; ``exact=True`` compares whole values);
    float/double: null or NaN; everything else: null.
    """
    c = F.col(name)
    cond = c.isNull()
    if isinstance(dtype, T.StringType):
        for m in MISSING_MARKERS:
            cond = cond | ((c == m) if exact else c.contains(m))
        cond = cond | (c == "")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        cond = cond | F.isnan(c)
    return cond


def missing_counts_exprs(df: DataFrame, exact: bool = False) -> list[Column]:
    return [F.count(F.when(missing_value(f.name, f.dataType, exact), 1)).alias(f.name)
            for f in df.schema.fields]
