"""Registered profiling queries (loan-like stand-in: documents left join
labels; numeric profiling without nulls: lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import association as asc, profile as pf
from quarry.plans.registry import query
from quarry.sources.standins import Tables, loan_table

LOAN = ("WITH loan AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)\n")
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LOAN_NUM = ["n_chars", "quality", "toxic"]
LOAN_CAT = ["lang", "source"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


@query("row_column_count", "SELECT count(*) AS n_rows, 5 AS n_cols FROM documents")
def q_row_column_count(spark, sf):
    return pf.row_column_count(Tables(spark, sf).documents)


@query("distinct_values", "SELECT DISTINCT lang FROM documents")
def q_distinct_values(spark, sf):
    return pf.distinct_values(Tables(spark, sf).documents, "lang")


@query("distinct_count", LOAN + "SELECT count(*) AS n_distinct FROM (SELECT DISTINCT quality FROM loan)")
def q_distinct_count(spark, sf):
    return pf.distinct_count(loan_table(Tables(spark, sf)), "quality")


@query("group_count", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment")
def q_group_count(spark, sf):
    return pf.group_count(Tables(spark, sf).customer, "c_mktsegment")


def _miss_str(c):
    return (f"count(*) FILTER (WHERE {c} IS NULL OR contains({c}, 'None') OR "
            f"contains({c}, 'NULL') OR {c} = '') AS {c}")


@query("missing_counts", """
WITH loan AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic
              FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (WHERE doc_id IS NULL) AS doc_id, """
       + ", ".join(_miss_str(c) for c in ("lang", "source", "text")) + """,
       count(*) FILTER (WHERE n_chars IS NULL) AS n_chars,
       count(*) FILTER (WHERE quality IS NULL) AS quality,
       count(*) FILTER (WHERE toxic IS NULL) AS toxic
FROM loan
""")
def q_missing_counts(spark, sf):
    return pf.missing_counts(loan_table(Tables(spark, sf), with_text=True))


@query("describe_numeric", _union([
    f"SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS stddev, round(min({c}), 6) AS min, "
    f"round(max({c}), 6) AS max FROM lineitem" for c in LINE_NUM]))
def q_describe_numeric(spark, sf):
    return pf.describe(Tables(spark, sf).lineitem, LINE_NUM)


def _moments(col_expr: str, name: str, table: str) -> str:
    return (f"SELECT '{name}' AS variable, "
            f"round(avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5), 6) AS skewness, "
            f"round(avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3, 6) AS kurtosis "
            f"FROM (SELECT {col_expr} AS x FROM {table}), "
            f"(SELECT avg({col_expr}) AS mu FROM {table})")


@query("skew_kurtosis", _union(
    [_moments(c, c, "lineitem") for c in LINE_NUM]
    + [_moments(f"ln(1 + {c})", f"{c}_log", "lineitem") for c in LINE_NUM]))
def q_skew_kurtosis(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        *LINE_NUM, *[F.log1p(c).alias(f"{c}_log") for c in LINE_NUM])
    return pf.skew_kurtosis(li, LINE_NUM + [f"{c}_log" for c in LINE_NUM])


@query("log_features", """
SELECT doc_id, round(ln(1 + n_chars), 6) AS n_chars_log FROM documents
""")
def q_log_features(spark, sf):
    from quarry.operators.features import log_features
    d = Tables(spark, sf).documents.select("doc_id", "n_chars")
    return log_features(d, ["n_chars"], suffix="_log", ndigits=6).select("doc_id", "n_chars_log")


@query("quartiles_interpolated", LOAN + _union([
    f"SELECT '{c}' AS variable, round(quantile_cont({c}, 0.25), 6) AS q1, "
    f"round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3 FROM loan"
    for c in LOAN_NUM]))
def q_quartiles_interpolated(spark, sf):
    return pf.quantiles(loan_table(Tables(spark, sf)), LOAN_NUM, interpolate=True)


@query("quartiles_exact", LOAN + _union([
    f"SELECT '{c}' AS variable, CAST(quantile_disc({c}, 0.25) AS DOUBLE) AS q1, "
    f"CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS q2, "
    f"CAST(quantile_disc({c}, 0.75) AS DOUBLE) AS q3 FROM loan" for c in LOAN_NUM]))
def q_quartiles_exact(spark, sf):
    return pf.quantiles(loan_table(Tables(spark, sf)), LOAN_NUM, interpolate=False)


def _iqr_sql(cols, table):
    parts = []
    for c in cols:
        b = (f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - "
             f"quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * "
             f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {table})")
        parts.append(
            f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS total_outliers, "
            f"count(*) FILTER (WHERE {c} < lo) AS low_outliers, "
            f"count(*) FILTER (WHERE {c} > hi) AS high_outliers FROM {table}, {b}")
    return _union(parts)


@query("iqr_outliers", LOAN + _iqr_sql(LOAN_NUM, "loan"))
def q_iqr_outliers(spark, sf):
    return pf.iqr_outliers(loan_table(Tables(spark, sf)), LOAN_NUM)


@query("iqr_outliers_numeric", _iqr_sql(LINE_NUM, "lineitem"))
def q_iqr_outliers_numeric(spark, sf):
    return pf.iqr_outliers(Tables(spark, sf).lineitem, LINE_NUM)


def _flags_sql():
    sel, bounds = [], []
    for c in LOAN_NUM:
        bounds.append(
            f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - "
            f"quantile_cont({c}, 0.25)) AS {c}_lo, quantile_cont({c}, 0.75) + 1.5 * "
            f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi FROM loan)")
        sel += [f"CAST(coalesce({c} < {c}_lo OR {c} > {c}_hi, false) AS INTEGER) AS {c}_out",
                f"CAST(coalesce({c} < {c}_lo, false) AS INTEGER) AS {c}_low",
                f"CAST(coalesce({c} > {c}_hi, false) AS INTEGER) AS {c}_high"]
    return LOAN + f"SELECT doc_id, {', '.join(sel)} FROM loan, {', '.join(bounds)}"


@query("outlier_flags", _flags_sql())
def q_outlier_flags(spark, sf):
    return pf.outlier_flags(loan_table(Tables(spark, sf)), LOAN_NUM, ["doc_id"])


def _corr_sql():
    parts = []
    for a in LINE_NUM:
        for b in LINE_NUM:
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 6) AS r "
                         f"FROM lineitem")
    return _union(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return pf.correlation_matrix(Tables(spark, sf).lineitem, LINE_NUM)


@query("value_counts", LOAN + _union([
    f"SELECT '{c}' AS variable, {c} AS value, count(*) AS count FROM loan GROUP BY {c}"
    for c in LOAN_CAT]))
def q_value_counts(spark, sf):
    return pf.value_counts(loan_table(Tables(spark, sf)), LOAN_CAT)


@query("class_counts", LOAN + _union([
    f"SELECT '{c}' AS variable, {c} AS value, quality, count(*) AS count FROM loan "
    f"GROUP BY {c}, quality" for c in LOAN_CAT]))
def q_class_counts(spark, sf):
    return pf.class_counts(loan_table(Tables(spark, sf)), LOAN_CAT, "quality")


@query("five_number_by_class", LOAN + """
SELECT quality, round(CAST(min(n_chars) AS DOUBLE), 6) AS min, round(quantile_cont(n_chars, 0.25), 6) AS q1,
       round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3,
       round(CAST(max(n_chars) AS DOUBLE), 6) AS max
FROM loan GROUP BY quality
""")
def q_five_number_by_class(spark, sf):
    return pf.five_number_by_class(loan_table(Tables(spark, sf)), "n_chars", "quality")


@query("crosstab", """
SELECT l_returnflag AS l_returnflag_l_linestatus,
       count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY l_returnflag
""")
def q_crosstab(spark, sf):
    return pf.crosstab(Tables(spark, sf).lineitem, "l_returnflag", "l_linestatus")


_GRID = """
WITH obs AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY ALL),
ra AS (SELECT a, sum(o) AS r FROM obs GROUP BY a),
cb AS (SELECT b, sum(o) AS c FROM obs GROUP BY b),
nn AS (SELECT sum(o) AS n FROM obs),
grid AS (SELECT ra.a, cb.b, CAST(coalesce(obs.o, 0) AS BIGINT) AS o, ra.r * cb.c / nn.n AS e, nn.n
         FROM ra CROSS JOIN cb CROSS JOIN nn LEFT JOIN obs ON obs.a = ra.a AND obs.b = cb.b)
"""


@query("expected_frequencies", _GRID.format(a="l_returnflag", b="l_linestatus", t="lineitem") + """
SELECT a, b, o AS observed, round(e, 6) AS expected FROM grid
""")
def q_expected_frequencies(spark, sf):
    return pf.expected_frequencies(Tables(spark, sf).lineitem, "l_returnflag", "l_linestatus")


def _chi_sql(a, b, t, pre=""):
    # p-value: closed form of the upper tail for even dof (the dof of this data)
    return pre + _GRID.format(a=a, b=b, t=t).replace("WITH obs", ", obs" if pre else "WITH obs") + f"""
, s AS (SELECT CAST(max(n) AS BIGINT) AS n,
               CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof,
               sum(power(o - e, 2) / e) AS stat,
               sum(power(o + sign(e - o) * least(0.5, abs(e - o)) - e, 2) / e) AS stat_y FROM grid)
SELECT '{a}' AS variable, n, dof, round(stat, 6) AS statistic,
       round(CASE WHEN dof = 1 THEN stat_y END, 6) AS statistic_yates,
       round(CASE WHEN dof % 2 = 0 THEN exp(-stat / 2) *
             (SELECT sum(power(stat / 2, i) / factorial(CAST(i AS INTEGER))) FROM range(0, dof // 2) r(i))
             END, 6) AS p_value
FROM s
"""


@query("chi_square", _chi_sql("l_returnflag", "l_linestatus", "lineitem"))
def q_chi_square(spark, sf):
    return asc.chi_square(Tables(spark, sf).lineitem, "l_returnflag", "l_linestatus")


#: Upper tail of the chi-square distribution at ``x`` with ``k`` degrees of freedom, as a sum of
#: the incomplete gamma function's series (all terms are positive).
def _tail_sql(x: str, k: str) -> str:
    return (f"round(CASE WHEN {k} = 0 THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - (SELECT sum(exp(-{x} / 2 + ({k} / 2.0 + i) "
            f"* ln({x} / 2) - lgamma({k} / 2.0 + i + 1))) FROM range(0, 20000) r(i))) END, 6)")


def features_chi_sql(rows: str, features: list[str], label: str) -> str:
    """Chi-square per feature over its full grid, with p-value; ``rows`` names a table."""
    one = []
    for f in features:
        grid = _GRID.format(a=f"CAST({f} AS VARCHAR)", b=f"CAST({label} AS VARCHAR)",
                            t=f"(SELECT * FROM {rows} WHERE {f} IS NOT NULL AND {label} IS NOT NULL)")
        one.append(f"""SELECT '{f}' AS variable, n, dof, round(stat, 6) AS statistic,
       round(CASE WHEN dof = 1 THEN stat_y END, 6) AS statistic_yates,
       {_tail_sql("CASE WHEN dof = 1 THEN stat_y ELSE stat END", "dof")} AS p_value
FROM (SELECT CAST(max(n) AS BIGINT) AS n, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof,
             CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN sum(power(o - e, 2) / e) ELSE 0.0 END AS stat,
             sum(power(o + sign(e - o) * least(0.5, abs(e - o)) - e, 2) / e) AS stat_y
      FROM ({grid.strip()} SELECT * FROM grid))""")
    return " UNION ALL ".join(f"({x})" for x in one)


@query("chi_square_wide", features_chi_sql("lineitem", ["l_partkey", "l_suppkey"], "l_linestatus"))
def q_chi_square_wide(spark, sf):
    """Features of thousands of values: only cells that occur are counted."""
    return asc.chi_square_many(Tables(spark, sf).lineitem, ["l_partkey", "l_suppkey"], "l_linestatus")


_GAPS = LOAN + """, gaps AS (SELECT *, CASE WHEN quality = 1 THEN toxic END AS toxic_if_good,
  CASE WHEN doc_id % 3 > 0 THEN lang END AS lang_or_null, CASE WHEN quality = 0 THEN 'x' END AS one_value FROM loan)
"""


@query("chi_square_gaps", _GAPS + features_chi_sql(
    "gaps", ["lang_or_null", "source", "toxic", "toxic_if_good", "one_value"], "quality"))
def q_chi_square_gaps(spark, sf):
    """Features that lack values, one of them wherever the label has one of its values."""
    good = F.col("quality") == 1
    rows = loan_table(Tables(spark, sf)).select(
        "quality", "source", "toxic", F.when(good, F.col("toxic")).alias("toxic_if_good"),
        F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang_or_null"),
        F.when(F.col("quality") == 0, "x").alias("one_value"))
    return asc.chi_square_many(rows, ["lang_or_null", "source", "toxic", "toxic_if_good", "one_value"], "quality")


_PLANTED = """WITH planted AS (SELECT CASE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE WHEN l_linenumber <> 5 THEN l_discount END AS gaps,
  CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_quantity END AS nans FROM lineitem),
kept AS (SELECT CASE WHEN isnan(gaps) THEN NULL ELSE gaps END AS gaps, CASE WHEN isnan(nans) THEN NULL ELSE nans END AS nans FROM planted)
"""


def _planted(c):
    return f"""SELECT '{c}' AS variable, (SELECT count(*) FROM planted WHERE {c} IS NULL OR isnan({c})) AS missing,
  count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, max({c}) AS max,
  (SELECT round(avg(power({c} - mu, 3)) / power(avg(power({c} - mu, 2)), 1.5), 6) FROM kept, (SELECT avg({c}) AS mu FROM kept)) AS skewness,
  (SELECT round(avg(power({c} - mu, 4)) / power(avg(power({c} - mu, 2)), 2) - 3, 6) FROM kept, (SELECT avg({c}) AS mu FROM kept)) AS kurtosis,
  round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3,
  quantile_disc({c}, 0.75) AS top_value
FROM kept"""


@query("profile_gaps", _PLANTED + _planted("gaps") + " UNION ALL " + _planted("nans"))
def q_profile_gaps(spark, sf):
    """Whole profile of columns with NaN and null, which both count as missing."""
    nan = F.lit(float("nan"))
    rows = Tables(spark, sf).lineitem.select(
        F.when(F.col("l_linenumber") == 3, nan).when(F.col("l_linenumber") != 5, F.col("l_discount").cast("double")).alias("gaps"),
        F.when(F.col("l_linenumber") == 2, nan).otherwise(F.col("l_quantity").cast("double")).alias("nans"))
    cols = ["gaps", "nans"]
    missing = pf.missing_counts(rows).unpivot([], cols, "variable", "missing")
    # a sketch's answer at an error below one value's share is the stored value at that rank
    top = pf.quantiles(rows, cols, (0.75,), relative_error=1e-4, names=("top_value",))
    out = missing
    for part in (pf.describe(rows, cols), pf.skew_kurtosis(rows, cols), pf.quantiles(rows, cols), top):
        out = out.join(part, "variable")
    return out


@query("csv_inferred", "SELECT c_nationkey, c_acctbal FROM customer")
def q_csv_inferred(spark, sf):
    """customer stored as header CSV, read back with inferred types; the
    numeric columns except the key are selected by type."""
    from quarry.session import scratch_path
    from quarry.sources.delimited import read_csv_inferred
    path = scratch_path(spark, "csv")
    Tables(spark, sf).customer.write.option("header", "true").csv(path)
    df = read_csv_inferred(spark, path)
    return df.select(*pf.numeric_columns(df, exclude=("c_custkey",)))
