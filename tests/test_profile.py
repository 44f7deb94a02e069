import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import association as asc, profile as pf

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def num(spark):
    x = RNG.gamma(2.0, 3.0, 501)
    y = x * 0.5 + RNG.normal(0, 1, 501)
    z = np.where(RNG.random(501) < 0.1, np.nan, RNG.integers(0, 5, 501).astype(float))
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    sdf = spark.createDataFrame([(float(a), float(b), None if math.isnan(c) else float(c))
                                 for a, b, c in zip(x, y, z)], "x double, y double, z double")
    return pdf, sdf


def test_missing_predicate_type_aware(spark):
    df = spark.createDataFrame(
        [("None", 1.0, 1), ("NULL", float("nan"), None), ("", None, 2), (None, 2.0, 3),
         ("Nonesuch", 3.0, 4), ("ok", 4.0, 5)], "s string, d double, i int")
    row = pf.missing_counts(df).first()
    assert (row.s, row.d, row.i) == (5, 2, 1)
    exact = pf.missing_counts(df, exact=True).first()
    assert exact.s == 4


def test_describe_and_moments(num):
    pdf, sdf = num
    d = {r.variable: r for r in pf.describe(sdf, ["x", "y"]).collect()}
    assert d["x"]["count"] == 501
    assert d["x"].mean == pytest.approx(pdf.x.mean(), abs=1e-6)
    assert d["x"].stddev == pytest.approx(pdf.x.std(), abs=1e-6)
    m = {r.variable: r for r in pf.skew_kurtosis(sdf, ["x"]).collect()}
    c = pdf.x - pdf.x.mean()
    m2 = (c ** 2).mean()
    assert m["x"].skewness == pytest.approx((c ** 3).mean() / m2 ** 1.5, abs=1e-5)
    assert m["x"].kurtosis == pytest.approx((c ** 4).mean() / m2 ** 2 - 3, abs=1e-5)


def test_quantiles_interpolated_and_exact(num):
    pdf, sdf = num
    q = {r.variable: r for r in pf.quantiles(sdf, ["x", "z"], interpolate=True).collect()}
    for col in ("x", "z"):
        s = pdf[col].dropna()
        assert q[col].q1 == pytest.approx(s.quantile(0.25), abs=1e-6)
        assert q[col].q3 == pytest.approx(s.quantile(0.75), abs=1e-6)
    e = {r.variable: r for r in pf.quantiles(sdf, ["x", "z"], interpolate=False).collect()}
    for col in ("x", "z"):
        s = np.sort(pdf[col].dropna().to_numpy())
        for p, name in zip((0.25, 0.5, 0.75), ("q1", "q2", "q3")):
            assert e[col][name] == pytest.approx(s[max(1, math.ceil(p * len(s))) - 1], abs=1e-6)


def test_iqr_outliers_match_pandas(num):
    pdf, sdf = num
    got = {r.variable: r for r in pf.iqr_outliers(sdf, ["x", "z"]).collect()}
    for col in ("x", "z"):
        s = pdf[col]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert got[col].low_outliers == int((s < lo).sum())
        assert got[col].high_outliers == int((s > hi).sum())
        assert got[col].total_outliers == int(((s < lo) | (s > hi)).sum())


def test_correlation_pairwise_complete(num):
    pdf, sdf = num
    got = {(r.var_a, r.var_b): r.r for r in pf.correlation_matrix(sdf, ["x", "y", "z"]).collect()}
    ref = pdf.corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(ref.loc[a, b], abs=1e-5)
    assert len(got) == 9


def test_chi_square_against_hand_computation(spark):
    rows = [("a", "y")] * 10 + [("a", "n")] * 20 + [("b", "y")] * 30 + [("b", "n")] * 15
    df = spark.createDataFrame(rows, "f string, lab string")
    obs = np.array([[10, 20], [30, 15]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    stat = ((obs - exp) ** 2 / exp).sum()
    corr = obs + np.sign(exp - obs) * np.minimum(0.5, np.abs(exp - obs))
    yates = ((corr - exp) ** 2 / exp).sum()
    r = asc.chi_square(df, "f", "lab").first()
    assert (r.n, r.dof) == (75, 1)
    assert r.statistic == pytest.approx(stat, abs=1e-6)
    assert r.statistic_yates == pytest.approx(yates, abs=1e-6)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(yates / 2)), abs=1e-6)


def test_chi_square_zero_cells(spark):
    rows = [("a", "y")] * 5 + [("b", "n")] * 5 + [("c", "n")] * 2 + [("c", "y")] * 1
    df = spark.createDataFrame(rows, "f string, lab string")
    e = pf.expected_frequencies(df, "f", "lab").collect()
    assert len(e) == 6 and sum(r.observed for r in e) == 13
    r = asc.chi_square(df, "f", "lab").first()
    obs = np.array([[0, 5], [5, 0], [2, 1]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    stat = ((obs - exp) ** 2 / exp).sum()
    assert r.dof == 2 and r.statistic_yates is None
    assert r.statistic == pytest.approx(stat, abs=1e-6)
    assert r.p_value == pytest.approx(math.exp(-stat / 2), abs=1e-6)


@pytest.mark.parametrize("x,k,expected", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0)])
def test_chi2_upper_tail(spark, x, k, expected):
    df = spark.createDataFrame([(x, k)], "x double, k long")
    from pyspark.sql import functions as F
    got = df.select(pf.chi2_sf(F.col("x"), F.col("k")).alias("p")).first().p
    assert got == pytest.approx(expected, abs=1e-9)


def test_value_and_class_counts(spark):
    df = spark.createDataFrame([("en", "s1", 1), ("en", None, 0), (None, "s1", 1)],
                               "lang string, source string, label int")
    vc = {(r.variable, r.value): r["count"] for r in pf.value_counts(df, ["lang", "source"]).collect()}
    assert vc == {("lang", "en"): 2, ("lang", None): 1, ("source", "s1"): 2, ("source", None): 1}
    cc = pf.class_counts(df, ["lang"], "label").collect()
    assert sum(r["count"] for r in cc) == 3


def test_distinct_count_counts_null(spark):
    df = spark.createDataFrame([(1,), (None,), (1,), (2,)], "a int")
    assert pf.distinct_count(df, "a").first().n_distinct == 3


def test_constant_column_quantiles_and_iqr(spark):
    from quarry.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(5.0,)] * 300 + [(None,)] * 3, "c double")
    got = {r.p: r.value for r in exact_quantiles(df, ["c"], (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: 5.0, 0.5: 5.0, 1.0: 5.0}
    r = pf.iqr_outliers(df, ["c"]).first()
    assert (r.total_outliers, r.low_outliers, r.high_outliers) == (0, 0, 0)


def test_single_class_label_chi_square(spark):
    df = spark.createDataFrame([("a", "y"), ("b", "y"), ("a", "y")], "f string, lab string")
    r = asc.chi_square(df, "f", "lab").first()
    assert (r.n, r.dof, r.statistic) == (3, 0, 0.0)
    assert r.statistic_yates is None and (r.p_value is None or math.isnan(r.p_value))


def test_five_number_keeps_all_null_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None), (None, 2.0)], "lab int, x double")
    got = {r.lab: (r["min"], r.median, r["max"]) for r in pf.five_number_by_class(df, "x", "lab").collect()}
    assert got == {1: (1.0, 2.0, 3.0), 2: (None, None, None), None: (2.0, 2.0, 2.0)}


def test_distinct_count_approximate(spark):
    df = spark.range(0, 5000).select((F.col("id") % 1000).alias("a")).union(
        spark.createDataFrame([(None,)], "a long"))
    exact = pf.distinct_count(df, "a").first().n_distinct
    approx = pf.distinct_count(df, "a", approximate=True).first().n_distinct
    assert exact == 1001 and abs(approx - exact) <= 30


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (nan, 1.0), (None, 2.0)], "x double, y double")
    r = pf.describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["max"]) == (3, 2.0, 3.0)
    assert pf.iqr_outliers(df, ["x"]).first().total_outliers == 0
    assert [f.x_out for f in pf.outlier_flags(df, ["x"], ["y"]).collect()] == [0] * 5
    c = {(r.var_a, r.var_b): r.r for r in pf.correlation_matrix(df, ["x", "y"]).collect()}
    assert c["x", "y"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1], abs=1e-6)


def test_chi2_tail_for_all_sizes(spark):
    # x, dof, P(X >= x): normal limit for large dof, closed forms for small ones
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (0.0, 3, 1.0),
             (1964.36, 1999, 0.7053), (1500.0, 1400, 0.0315), (10000.0, 10000, 0.4981), (3000.0, 2000, 0.0)]
    df = spark.createDataFrame([k[:2] for k in known], "x double, k long")
    got = [r.p for r in df.select(pf.chi2_sf(F.col("x"), F.col("k")).alias("p")).collect()]
    for p, (x, k, want) in zip(got, known):
        assert p == pytest.approx(want, abs=5e-3 if k > 3 else 1e-9), (x, k)


def test_null_categories_are_left_out(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x"), ("a", None), ("a", "y"), ("b", "x")],
                               "f string, l string")
    assert asc.chi_square(df, "f", "l").first().dof == 1
    assert sum(v for r in pf.crosstab(df, "f", "l").collect() for v in r[1:]) == 4
