"""Faulty log lines, and facts stored by month."""

import os

from pyspark.sql import functions as F

from quarry.plans import weblog_jobs as jobs
from quarry.plans.warehouse_etl import load, month_of_fact, run_checks, run_etl
from quarry.schemas import WAREHOUSE, WEBLOG_TM
from quarry.sources import rejects
from quarry.sources.delimited import read_weblog_tm
from quarry.sources.standins import Tables, clinical_sources

SMALL = "/root/testdata/sf0.001"
LINES = ["timestamp,user_id,search_query,browser,os,referrer",
         "2020-01-01 10:00:00,u1,q,ff,linux,r",
         "2020-01-01 10:05:00,u1,q",                        # short
         "2020-01-01 11:00:00,u2,q,ff,linux,r,x,y",         # long
         "yesterday,u3,q,ff,linux,r",                       # no time
         "soon,u3",                                         # short comes before time
         ",u4,q,ff,linux,r",                                # absent time: no fault
         "",                                                # blank: no row
         '2020-01-01 10:09:00,"u,5",q,ff,linux,r']          # quotes are plain text: long


def _log(tmp_dir, lines=LINES):
    path = os.path.join(tmp_dir, "log.txt")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_rows_are_those_of_the_plain_scan(spark, tmp_dir):
    path = _log(tmp_dir)
    rows = rejects.read_with_lines(spark, path, WEBLOG_TM)
    assert sorted(map(str, rows.drop(rejects.LINE).collect())) == sorted(map(str, read_weblog_tm(spark, path).collect()))
    lines = {r[0] for r in rows.filter(F.col(rejects.LINE).isNotNull()).select(rejects.LINE, "user_id").collect()}
    assert lines == {LINES[2], LINES[3], LINES[5], LINES[8]}


def test_ledger_by_kind(spark, tmp_dir):
    rows = rejects.read_with_lines(spark, _log(tmp_dir), WEBLOG_TM)
    got = {r["fault"]: (r["lines"], r["distinct_values"]) for r in rejects.ledger(
        rows, WEBLOG_TM, timestamp="timestamp", header=True, count_distinct="user_id").collect()}
    assert got == {"short": (2, 2), "long": (2, 2), "time": (1, 1)}
    plain = {r["fault"]: r["lines"] for r in rejects.ledger(rows, WEBLOG_TM, timestamp="timestamp").collect()}
    assert plain == {"short": 2, "long": 2, "time": 2}  # the header's time is one more


def test_ledger_of_no_lines_and_of_sound_lines(spark, tmp_dir):
    for lines in ([], LINES[:2]):
        rows = rejects.read_with_lines(spark, _log(tmp_dir, lines), WEBLOG_TM)
        assert rejects.ledger(rows, WEBLOG_TM, timestamp="timestamp", header=True).count() == 0


def test_separator_that_is_a_pattern_sign(spark, tmp_dir):
    rows = rejects.read_with_lines(spark, _log(tmp_dir, ["a|b", "a|b|c", "a|b|c|d"]),
                                   WEBLOG_TM.__class__(WEBLOG_TM.fields[:3]), "|")
    got = {r["fault"]: r["lines"] for r in rejects.ledger(rows, WEBLOG_TM.__class__(WEBLOG_TM.fields[:3]), "|").collect()}
    assert got == {"short": 1, "long": 1}


def test_audited_job_stores_both(spark, tmp_dir):
    out, faults = tmp_dir + "/hour", tmp_dir + "/faults"
    jobs.audited_hour_job(spark, _log(tmp_dir), out, faults)
    hour = spark.read.option("sep", "\t").csv(out).collect()
    assert [tuple(r) for r in hour] == [("2020", "1", "1", "10", "3", "3")]
    assert {(r["token"], r["count"]) for r in jobs.read_result(spark, faults).collect()} == {
        ("short", 2), ("long", 2), ("time", 1)}


def test_facts_by_month_read_one_folder(spark, tmp_dir):
    src = clinical_sources(Tables(spark, SMALL))
    paths = run_etl(spark, src, tmp_dir + "/by-month", by_month=True)
    plain = load(spark, run_etl(spark, src, tmp_dir + "/plain"))
    tables = load(spark, paths)
    months = plain["dim_time"].count()
    for name in ("fact_patient", "fact_lab", "fact_procedure", "fact_diagnosis"):
        assert tables[name].columns == WAREHOUSE[name].names
        assert tables[name].exceptAll(plain[name]).count() == 0 == plain[name].exceptAll(tables[name]).count()
        one = month_of_fact(tables, name, 1997, "March")
        wanted = plain["dim_time"].filter("year = 1997 AND month = 'March'").first()["date_id"]
        assert "dynamicpruning" in one._jdf.queryExecution().executedPlan().toString().lower()
        assert one.count() == plain[name].filter(F.col("date_id") == wanted).count()
        folders = [f for f in os.listdir(paths[name].removeprefix("file:")) if f.startswith("date_id=")]
        assert 1 < len(folders) <= months
    found = run_checks(spark, src, paths)
    assert all(found[n].count() == 0 for n in found if n.endswith("_vs_source"))


def test_pruned_scan_reads_one_partition(spark, tmp_dir):
    src = clinical_sources(Tables(spark, SMALL))
    tables = load(spark, run_etl(spark, src, tmp_dir + "/by-month", by_month=True))
    one = month_of_fact(tables, "fact_lab", 1997, "March")
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            scans.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    fact = [s for s in scans if "dynamicpruning" in s.toString().lower()]
    assert len(fact) == 1 and fact[0].metrics().apply("numPartitions").value() == 1
