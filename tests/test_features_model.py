from pyspark.sql import functions as F

from quarry.operators import features as fe, model as md


def test_quartile_bins_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    t = fe.quartile_thresholds(df, "x")
    assert t == [2.0, 4.0, 6.0, 8.0]
    got = [r.b for r in fe.quartile_bins(df, "x", "b").orderBy("x").collect()]
    assert got == ["min-Q1", "min-Q1", "Q1-Q2", "Q1-Q2", "Q2-Q3", "Q2-Q3", "Q3-max", "Q3-max"]


def test_rule_bins(spark):
    df = spark.createDataFrame([(0.0, 300.0), (5.0, 360.0), (None, 480.0), (1.0, None)],
                               "c double, t double")
    out = fe.term_bin(fe.zero_bin(df, "c", "cb"), "t", "tb").collect()
    assert [r.cb for r in out] == ["0", ">0", ">0", ">0"]
    assert [r.tb for r in out] == ["<360", "360", ">360", None]


def test_string_index_ties_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    out, model = fe.string_index(df, ["s"])
    assert model.labelsArray[0] == ["c", "a", "b"]
    got = {r.s: r.s_idx for r in out.collect()}
    assert got == {"c": 0.0, "a": 1.0, "b": 2.0, None: 3.0}


def test_mode_imputer_smallest_tie(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (1.0,), (None,), (float("nan"),)], "x double")
    out = fe.impute(df, ["x"], "mode").collect()
    assert [r.x_imp for r in out][-2:] == [1.0, 1.0]


def test_hash_split_stable_under_repartition(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a = {r.k for r in md.hash_split(df, "k").filter("is_train").collect()}
    b = {r.k for r in md.hash_split(df.repartition(7), "k").filter("is_train").collect()}
    assert a == b and 1200 < len(a) < 1600


def test_loan_job_runs(spark):
    from quarry.plans import loan_job
    from quarry.sources.standins import Tables, loan_table
    res = loan_job.run(loan_table(Tables(spark, "/root/testdata/sf0.01")))
    assert res["n_train"] + res["n_test"] == 399
    for k in ("auc_score", "auc_label", "auc_selected_score", "auc_selected_label"):
        assert 0.0 <= res[k] <= 1.0
    assert len(res["selected"]) == 2
    assert res["screening"].count() == 6


def test_string_modes_and_fill(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y"), ("a", "y"), (None, None)],
                               "c1 string, c2 string")
    assert fe.string_modes(df, ["c1", "c2"]) == {"c1": "a", "c2": "y"}
    out = fe.impute_string_mode(df, ["c1", "c2"]).collect()
    assert [r.c1 for r in out] == ["b", "a", "b", "a", "a"]
    assert [r.c2 for r in out] == ["x", "y", "y", "y", "y"]


def test_loan_job_options(spark):
    from quarry.plans import loan_job
    from quarry.sources.standins import Tables, loan_table
    df = loan_table(Tables(spark, "/root/testdata/sf0.001"))
    base = loan_job.run(df)
    opt = loan_job.run(df, loan_job.LoanRoles(impute_first=True, fit_on_train=True))
    assert base["n_train"] == opt["n_train"] and base["n_test"] == opt["n_test"]
    for k in ("auc_score", "auc_selected_score"):
        assert 0.0 <= opt[k] <= 1.0


def test_recommended_shuffle_partitions():
    from quarry.session import recommended_shuffle_partitions
    assert recommended_shuffle_partitions(100 << 40) == 409600
    assert recommended_shuffle_partitions(1000) == 8


def test_column_roles_and_random_split(spark):
    from quarry.operators.profile import categorical_columns, numeric_columns
    df = spark.createDataFrame([(1, "a", 2.0, "x")], "id int, s string, d double, key string")
    assert numeric_columns(df, ("id",)) == ["d"]
    assert categorical_columns(df, ("key",)) == ["s"]
    a, b = md.random_split(spark.range(1000), (0.7, 0.3), seed=3)
    assert a.count() + b.count() == 1000 and a.join(b, "id").count() == 0


def test_string_index_refuses_a_million_labels(spark):
    import pytest
    df = spark.range(1_000_000).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="too many labels"):
        fe.string_index(df, ["s"])


def test_loan_job_imputes_the_term_before_binning(spark):
    from quarry.plans import loan_job
    rows = [(i, i % 2, "a" if i % 3 else "b", float(i + 1), float(i % 4), 360.0 if i % 5 else None)
            for i in range(60)]
    df = spark.createDataFrame(rows, "k long, y int, c string, x double, z double, t double")
    r = loan_job.LoanRoles(key="k", label="y", categorical=["c"], log_binned=["x"], zero_binned=["z"],
                           term_binned=["t"], mode_imputed=["z"])
    d, feats = loan_job.prepare(df, r)
    assert {x.t_tcat for x in d.select("t_tcat").distinct().collect()} == {"360"}
    assert "t_tcat_idx" in feats


def test_loan_job_feature_roles_and_training_fits(spark):
    import pytest
    from quarry.plans import loan_job
    from quarry.sources.standins import Tables, loan_table
    df = loan_table(Tables(spark, "/root/testdata/sf0.001"))
    _, feats = loan_job.prepare(df, loan_job.LoanRoles())
    roles = loan_job.LoanRoles(fit_on_train=True, top_k=1, selector_features=feats[:3], model_features=feats[1:3])
    base = loan_job.run(df, roles)
    assert len(base["selected"]) == 1 and base["selected"][0] in feats[:3]
    # other values in test rows leave what was fitted on the training rows alone
    split = md.hash_split(df, "doc_id")
    other = split.withColumn("lang", F.when(F.col("is_train"), F.col("lang")).otherwise(F.lit("new"))).drop("is_train")
    moved = loan_job.run(other, roles)
    assert moved["selected"] == base["selected"]
    assert sorted(map(tuple, moved["screening"].collect())) == sorted(map(tuple, base["screening"].collect()))
    with pytest.raises(ValueError, match="model_features"):
        loan_job.run(df, loan_job.LoanRoles(model_features=["nope"]))
