"""Command line for the jobs: ``python -m quarry <job> ...`` (or spark-submit).

Log jobs read a comma-split log and store a tab-separated result folder:
  freq      LOG OUT [--token search_query] [--k N]
  busiest   LOG OUT [--token referrer]
  pair      LOG OUT
  tally     LOG OUT
  hour      LOG_TM OUT
  datepart  LOG_TM OUT
Warehouse (operational tables as Parquet folders named visit, visit_lab, ...):
  etl       SOURCE_DIR TARGET_DIR [--check]   (a published version, and its tables as TARGET_DIR/<table>)
Loan job and table profile (header CSV or Parquet):
  loan      INPUT [--key K --label L --categorical a,b ...]
  profile   INPUT [--key K --label L --out DIR]
"""

from __future__ import annotations

import argparse
import json
import sys


def _session(master: str | None):
    from pyspark.sql import SparkSession

    from quarry.session import build_session, tune
    if master:
        return build_session(master)
    return tune(SparkSession.builder.appName("quarry").getOrCreate())


def _load(spark, path: str):
    if path.endswith(".csv"):
        from quarry.sources.delimited import read_csv_inferred
        return read_csv_inferred(spark, path)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quarry", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--master", default=None, help="e.g. local[*]; default: the cluster's")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("freq", "busiest", "pair", "tally", "hour", "datepart"):
        p = sub.add_parser(name)
        p.add_argument("log")
        p.add_argument("out")
        if name in ("freq", "busiest"):
            p.add_argument("--token", default="search_query" if name == "freq" else "referrer")
        if name == "freq":
            p.add_argument("--k", type=int, default=None)
    p = sub.add_parser("etl")
    p.add_argument("source_dir")
    p.add_argument("target_dir")
    p.add_argument("--check", action="store_true")
    p = sub.add_parser("loan")
    p.add_argument("input")
    # Column names of the loan input.
    p.add_argument("--key", default="Loan_ID")
    p.add_argument("--label", default="Loan_Status")
    p.add_argument("--categorical", default="Gender,Married,Dependents,Education,"
                   "Self_Employed,Property_Area")
    p.add_argument("--log-binned", default="ApplicantIncome,LoanAmount")
    p.add_argument("--zero-binned", default="CoapplicantIncome")
    p.add_argument("--term-binned", default="Loan_Amount_Term")
    p.add_argument("--mode-imputed", default="Credit_History")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--selector-features", default="", help="prepared columns the selector chooses from")
    p.add_argument("--model-features", default="", help="prepared columns of the hand-picked model")
    p = sub.add_parser("profile")
    p.add_argument("input")
    p.add_argument("--key", default=None)
    p.add_argument("--label", default=None)
    p.add_argument("--out", default=None, help="folder for the frames (default: the session's scratch folder)")
    a = ap.parse_args(argv)
    spark = _session(a.master)

    from quarry.plans import weblog_jobs as wj
    if a.job == "freq":
        print(wj.frequency_job(spark, a.log, a.out, a.token, a.k))
    elif a.job == "busiest":
        print(wj.busiest_job(spark, a.log, a.out, a.token))
    elif a.job == "pair":
        print(wj.busiest_pair_job(spark, a.log, a.out))
    elif a.job == "tally":
        print(wj.largest_tally_job(spark, a.log, a.out))
    elif a.job == "hour":
        print(wj.busiest_hour_job(spark, a.log, a.out))
    elif a.job == "datepart":
        print(wj.busiest_date_part_job(spark, a.log, a.out))
    elif a.job == "etl":
        from quarry.plans.warehouse_etl import load, run_checks, run_etl
        names = ("visit visit_lab visit_procedure visit_diagnosis patient provider lab "
                 "clinical_procedures diagnosis").split()
        src = {n: spark.read.parquet(f"{a.source_dir.rstrip('/')}/{n}") for n in names}
        paths = run_etl(spark, src, a.target_dir)
        # the version that was published, also under the tables' plain names
        for name, df in load(spark, paths).items():
            df.write.mode("overwrite").parquet(f"{a.target_dir.rstrip('/')}/{name}")
        print(json.dumps(paths))
        if a.check:
            for name, df in run_checks(spark, src, paths).items():
                out = f"{a.target_dir.rstrip('/')}/_findings/{name}"
                df.write.mode("overwrite").parquet(out)
                print(json.dumps({"check": name, "rows": spark.read.schema(df.schema).parquet(out).count(),
                                  "findings": out}))
    elif a.job == "profile":
        from quarry.plans.profile_job import profile_table
        from quarry.session import scratch_path
        for name, frame in profile_table(_load(spark, a.input), a.key, a.label).items():
            # a text column has a row per distinct value: stored, not shown
            out = scratch_path(spark, f"profile-{name}") if a.out is None else f"{a.out.rstrip('/')}/{name}"
            frame.write.mode("overwrite").parquet(out)
            print(f"-- {name}")
            print(json.dumps({"frame": name, "rows": spark.read.schema(frame.schema).parquet(out).count(), "stored": out}))
    elif a.job == "loan":
        from quarry.plans.loan_job import LoanRoles, run
        df = _load(spark, a.input)
        split = lambda s: [c for c in s.split(",") if c]
        roles = LoanRoles(key=a.key, label=a.label, categorical=split(a.categorical),
                          log_binned=split(a.log_binned), zero_binned=split(a.zero_binned),
                          term_binned=split(a.term_binned), mode_imputed=split(a.mode_imputed),
                          top_k=a.top_k, selector_features=split(a.selector_features) or None,
                          model_features=split(a.model_features) or None)
        res = run(df, roles)
        res["screening"].show(truncate=False)
        print(json.dumps({k: v for k, v in res.items() if k != "screening"}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
