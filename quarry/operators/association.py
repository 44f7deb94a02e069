"""Chi-square tests over the cells that occur, and the ranking of features by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.profile import _r, chi2_sf, unpivot_text

#: p-values closer than this are a tie: what 1 - cdf can tell apart in double precision.
P_DIGITS = 15


def _cells(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``variable, value, label, o``: the non-empty cells of every feature's table. A
    row counts for a feature where both it and the label are there."""
    named = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), *features)
    return (unpivot_text(named, features, ["_label"]).filter("value IS NOT NULL")
            .groupBy("variable", "value", F.col("_label").alias("label")).agg(F.count(F.lit(1)).alias("o")))


def chi_square_many(df: DataFrame, features: list[str], label: str,
                    ndigits: int | None = 6, with_p: bool = True) -> DataFrame:
    """Pearson chi-square test of each feature against the label, all features in one
    pass: ``variable, n, dof, statistic, statistic_yates, p_value``.

    With cells o, row totals r and column totals c the statistic is
    ``n (sum o^2 / (r c) - 1)``, to which empty cells add nothing: the work is
    proportional to the cells that occur, not to values times labels. One join brings the row
    totals to the cells; the column totals fall out of the sum by label. A table's
    rows and columns are the values and labels that its feature occurs with (a label whose rows
    all lack the feature is no column). With one row or column there are no degrees of
    freedom: statistic 0, no p-value.

    ``statistic_yates`` applies the continuity correction (each observed cell moves up to
    0.5 towards its expected value) and is set for 2x2 tables only (dof = 1), where
    ``p_value`` uses it, as the reference's test does: there all four cells are equally far
    from what is expected, so it follows from the statistic and the reciprocal totals."""
    cells = _cells(df, features, label)
    rows = cells.groupBy("variable", "value").agg(F.sum("o").alias("r"))
    by_label = (cells.join(rows, ["variable", "value"]).groupBy("variable", "label")
                .agg(F.sum("o").alias("c"), F.sum(F.col("o").cast("double") * F.col("o") / F.col("r")).alias("s")))
    one = F.lit(1.0)
    columns = by_label.groupBy("variable").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels"), F.sum(F.col("s") / F.col("c")).alias("share"),
        F.sum(one / F.col("c")).alias("c_part"))
    values = rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n_values"), F.sum(one / F.col("r")).alias("r_part"))
    d = columns.join(values, "variable").withColumn("dof", (F.col("n_values") - 1) * (F.col("n_labels") - 1))
    n = F.col("n").cast("double")
    stat = F.when(F.col("dof") > 0, F.greatest(F.lit(0.0), n * (F.col("share") - 1))).otherwise(0.0)
    d = d.withColumn("stat", stat).withColumn("spread", n * F.col("c_part") * F.col("r_part"))  # sum of 1 / expected
    moved = F.greatest(F.lit(0.0), F.sqrt(F.col("stat") / F.col("spread")) - 0.5)
    yates = F.when(F.col("dof") == 1, moved * moved * F.col("spread"))
    cols = [F.col("variable"), F.col("n").cast("long").alias("n"), F.col("dof").cast("long").alias("dof"),
            _r(F.col("stat"), ndigits).alias("statistic"), _r(yates, ndigits).alias("statistic_yates")]
    if with_p:
        cols.append(_r(_p_value(F.coalesce(yates, F.col("stat")), F.col("dof")), ndigits).alias("p_value"))
    return d.select(*cols)


def _p_value(stat: Column, dof: Column) -> Column:
    return F.when(dof > 0, chi2_sf(stat, dof))


def chi_square(df: DataFrame, a: str, b: str, ndigits: int | None = 6) -> DataFrame:
    """Chi-square test of independence of ``a`` and ``b`` (one row; none if no row has both)."""
    return chi_square_many(df, [a], b, ndigits)


def chi_rank(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``variable, place, p_value, rank``: features by their dependence on the label, from
    rank 1. Order: Pearson's p-value (without continuity correction, as the ML selector
    has it, to 15 digits), then the order in which the features are given; a
    feature without any value has p-value 1. One row per feature."""
    tests = chi_square_many(df, features, label, None, with_p=False)
    places = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))])
    every = df.sparkSession.createDataFrame([(c,) for c in features], "variable string")
    p = F.round(F.coalesce(_p_value(F.col("statistic"), F.col("dof")), F.lit(1.0)), P_DIGITS)
    ranked = every.join(tests, "variable", "left").select("variable", places[F.col("variable")].alias("place"), p.alias("p_value"))
    # one row per feature
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy("p_value", "place")))
