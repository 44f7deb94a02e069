from quarry.__main__ import main
from quarry.sources.standins import Tables, clinical_sources, loan_table

SMALL = "/root/testdata/sf0.001"


def test_etl_command(spark, tmp_dir, capsys):
    src = clinical_sources(Tables(spark, SMALL))
    for n in ("visit", "visit_lab", "visit_procedure", "visit_diagnosis", "patient", "provider",
              "lab", "clinical_procedures", "diagnosis"):
        src[n].write.parquet(f"{tmp_dir}/src/{n}")
    assert main(["--master", "local[2]", "etl", f"{tmp_dir}/src", f"{tmp_dir}/wh", "--check"]) == 0
    out = capsys.readouterr().out
    assert "fact_lab" in out and '"check": "orphans"' in out
    assert spark.read.parquet(f"{tmp_dir}/wh/fact_patient").count() > 0


def test_loan_command(spark, tmp_dir, capsys):
    loan_table(Tables(spark, SMALL)).write.parquet(f"{tmp_dir}/loan")
    rc = main(["--master", "local[2]", "loan", f"{tmp_dir}/loan", "--key", "doc_id",
               "--label", "quality", "--categorical", "lang,source", "--log-binned", "n_chars",
               "--zero-binned", "toxic", "--term-binned", "n_chars", "--mode-imputed", "toxic",
               "--top-k", "2"])
    assert rc == 0
    assert '"auc_score"' in capsys.readouterr().out


def test_profile_job_and_command(spark, tmp_dir, capsys):
    from quarry.plans.profile_job import profile_table
    df = loan_table(Tables(spark, SMALL))
    out = profile_table(df, key="doc_id", label="quality")
    assert set(out) >= {"shape", "missing", "key_distinct", "describe", "quartiles", "moments",
                        "outliers", "correlation", "value_counts", "class_counts",
                        "five_number_by_class"}
    assert out["key_distinct"].first().n_distinct == df.count()
    assert {r.variable for r in out["describe"].collect()} == {"n_chars", "toxic"}
    df.write.parquet(f"{tmp_dir}/t")
    assert main(["--master", "local[2]", "profile", f"{tmp_dir}/t", "--key", "doc_id",
                 "--label", "quality"]) == 0
    assert "-- five_number_by_class" in capsys.readouterr().out
