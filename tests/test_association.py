"""Chi-square over occurring cells, ranked selection, rank-sum area, stored models."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.sql import functions as F

from quarry.operators import association as asc, features as fe, model as md, profile as pf
from quarry.plans import loan_model
from quarry.plans.loan_job import LoanRoles
from quarry.sources.standins import Tables, loan_table

SMALL = "/root/testdata/sf0.001"


def test_chi_square_where_a_feature_lacks_a_label(spark):
    rows = [("Y", "a", "u"), ("Y", "b", "u"), ("N", None, "v"), ("N", None, "u"), (None, "a", "u")]
    df = spark.createDataFrame(rows, "y string, f string, g string")
    got = {r.variable: r for r in asc.chi_square_many(df, ["f", "g"], "y").collect()}
    assert (got["f"].n, got["f"].dof, got["f"].statistic, got["f"].p_value) == (2, 0, 0.0, None)
    assert (got["g"].n, got["g"].dof) == (4, 1) and got["g"].statistic == pytest.approx(4 / 3, abs=1e-6)
    assert asc.chi_square_many(df.filter("y IS NULL"), ["f"], "y").count() == 0


def test_chi_square_of_wide_tables_without_their_grid(spark):
    r = random.Random(4)
    rows = [(f"v{r.randrange(300)}", f"l{r.randrange(40)}") for _ in range(2000)]
    df = spark.createDataFrame(rows, "f string, y string")
    a, b = sorted({x for x, _ in rows}), sorted({y for _, y in rows})
    obs = np.zeros((len(a), len(b)))
    for x, y in rows:
        obs[a.index(x), b.index(y)] += 1
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    got = asc.chi_square(df, "f", "y").first()
    assert got.statistic == pytest.approx(((obs - exp) ** 2 / exp).sum(), rel=1e-9)
    assert got.dof == (len(a) - 1) * (len(b) - 1) and got.statistic_yates is None
    plan = asc.chi_square(df, "f", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "pivot" not in plan.lower() and "Cartesian" not in plan


def test_selection_agrees_with_the_ml_selector(spark):
    r = random.Random(8)
    rows = []
    for _ in range(400):
        y = r.randrange(2)
        rows.append((float(y), float(r.randrange(4)), float(y if r.random() < 0.6 else r.randrange(3)),
                     float(r.randrange(2)), float((y + r.randrange(3)) % 3)))
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    for k in (1, 2, 3, 4, 9):
        sel = UnivariateFeatureSelector(featuresCol="v", outputCol="o", labelCol="y", selectionMode="numTopFeatures")
        sel.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)
        want = sel.fit(fe.assemble(df, cols, "v")).selectedFeatures
        assert fe.chi_select(df, cols, "y", k)[1] == sorted(want)
    # ties go to the feature named first; a feature without values comes last
    tied = df.select("y", F.col("a").alias("p"), F.col("a").alias("q"), F.lit(None).cast("string").alias("none"))
    assert [x.variable for x in asc.chi_rank(tied, ["none", "q", "p"], "y").orderBy("rank").collect()][:1] == ["q"]


@pytest.mark.parametrize("parts", [1, 7])
def test_area_equals_counting_all_pairs(spark, parts):
    r = random.Random(parts)
    rows = [(r.randrange(2), r.choice([r.randrange(6) / 2, -0.0, 0.0, 1e300, -1e300])) for _ in range(500)]
    rows += [(None, 1.0), (1, None), (0, float("nan"))]
    pos = [x for y, x in rows if y == 1 and x is not None]
    neg = [x for y, x in rows if y == 0 and x is not None and x == x]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "y int, x double").repartition(parts)
    got = md.rank_auc(df, "y", "x").first()
    assert (got.n_positive, got.n_negative) == (len(pos), len(neg)) and got.auc == pytest.approx(want, rel=1e-12)
    assert md.rank_auc(df.filter("y = 1"), "y", "x").first().auc is None
    assert tuple(md.rank_auc(df.limit(0), "y", "x").first()) == (0, 0, None)


def test_certificate_tells_a_converged_fit(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(float(r.random() < 0.3 + 0.4 * x), x) for x in (r.random() for _ in range(800))], "y double, x double")
    lr = md.fit_logistic(df, ["x"], "y", tol=1e-12).stages[-1]
    good = md.log_loss(df, ["x"], "y", [float(lr.coefficients[0])], float(lr.intercept)).first()
    off = md.log_loss(df, ["x"], "y", [float(lr.coefficients[0]) + 0.1], float(lr.intercept)).first()
    assert good.n == 800 and good.gradient_norm < 1e-6 < off.gradient_norm and good.log_loss < off.log_loss
    far = md.log_loss(df, ["x"], "y", [5000.0], 0.0).first()  # no overflow
    assert np.isfinite(far.log_loss)


def test_stored_model_scores_rows_never_seen(spark, tmp_dir):
    df = loan_table(Tables(spark, SMALL))
    split = md.hash_split(df, "doc_id")
    roles = LoanRoles(impute_first=True)
    model = loan_model.fit(split.filter("is_train"), roles)
    path = f"{tmp_dir}/model"
    loan_model.save(model, path)
    new = spark.createDataFrame([(-1, "xx'\\", None, None, None, None), (-2, None, "s", 10, 0, 7), (-3, "en", None, 10 ** 9, 1, None)],
                                "doc_id long, lang string, source string, n_chars long, toxic int, other int")
    rows = {r.doc_id: r for r in loan_model.score(loan_model.load(spark, path), new).collect()}
    assert set(rows) == {-1, -2, -3} and all(0 <= r.score <= 1 and r.predicted in ("0", "1") for r in rows.values())
    assert rows[-3].n_chars_qcat == "Q3-max" and rows[-2].n_chars_tcat == "<360" and rows[-2].other == 7
    direct = {r.doc_id: r.score for r in loan_model.score(model, new).collect()}
    assert direct == {k: r.score for k, r in rows.items()}


def test_nan_counts_as_missing_in_moments_and_sketches(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 5, "nan")] + [(None,)], "x double")
    r = pf.skew_kurtosis(df, ["x"]).first()
    v = np.array([1.0, 2.0, 5.0])
    z = v - v.mean()
    assert r.skewness == pytest.approx((z ** 3).mean() / (z ** 2).mean() ** 1.5, abs=1e-6)
    assert pf.quantiles(df, ["x"], relative_error=0.001).first().q3 == 5.0
