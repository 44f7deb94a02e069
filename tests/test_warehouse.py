import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import calendar as cal, quality as dq, warehouse as wh

D = dt.date


def _visits(spark, rows):
    return spark.createDataFrame(rows, "visit_id long, provider_id long, patient_id long, visit_date date")


def test_dim_time_month_end_adds_next_month(spark):
    v = _visits(spark, [(1, 1, 1, D(2024, 1, 15)), (2, 1, 1, D(2024, 3, 31))])
    got = [(r.date_id, r.start_dt, r.end_dt, r.days_in_month, r.month, r.year, r.quarter)
           for r in cal.dim_time(v).orderBy("date_id").collect()]
    assert got[0] == (1, D(2024, 1, 1), D(2024, 1, 31), 31, "January", 2024, 1)
    assert got[1][3] == 29  # leap February
    assert [g[1] for g in got] == [D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1), D(2024, 4, 1)]
    strict = cal.dim_time(v, inclusive_extra_day=False)
    assert strict.count() == 3


def test_visit_month_matches_range_join(spark):
    v = _visits(spark, [(1, 1, 1, D(2024, 1, 31)), (2, 1, 1, D(2024, 2, 1)), (3, 1, 1, None)])
    dim = cal.dim_time(v)
    got = {r.visit_id: r.date_id for r in cal.visit_month(v, dim).collect()}
    assert got == {1: 1, 2: 2, 3: None}
    rng = v.join(dim, (v.visit_date >= dim.start_dt) & (v.visit_date <= dim.end_dt), "left")
    assert {r.visit_id: r.date_id for r in rng.collect()} == got


def _lines(spark, rows, col):
    return spark.createDataFrame(rows, f"visit_id long, {col} long")


def test_fact_patient_fan_out_and_null_provider(spark):
    v = _visits(spark, [(1, 7, 100, D(2024, 1, 5)), (2, 7, 100, D(2024, 1, 20)),
                        (3, None, 100, D(2024, 1, 9)), (4, 8, 101, D(2024, 2, 1))])
    lab = _lines(spark, [(1, 10), (1, 11), (2, 10), (3, 10), (9, 10)], "lab_id")
    proc = _lines(spark, [(1, 20), (1, 21), (1, 22)], "procedure_id")
    diag = _lines(spark, [(2, 30), (4, None)], "diagnosis_id")
    dim = cal.dim_time(v)
    got = {(r.provider_id, r.patient_id, r.date_id): (r.visit_count, r.lab_count, r.procedure_count,
                                                      r.diagnosis_count)
           for r in wh.fact_patient(v, dim, lab, proc, diag).collect()}
    # visit 1 has 2 labs and 3 procedures: no fan-out between the measures
    assert got == {(7, 100, 1): (2, 3, 3, 1), (8, 101, 2): (1, 0, 0, 0)}
    rej = wh.rejected_visits(v, dim)
    assert [r.visit_id for r in rej.collect()] == [3]


def test_fact_lines_counts(spark):
    v = _visits(spark, [(1, 7, 100, D(2024, 1, 5)), (2, 7, None, D(2024, 1, 6)),
                        (3, 8, 101, D(2024, 2, 1))])
    lab = _lines(spark, [(1, 10), (1, 10), (2, 10), (3, 11), (3, None)], "lab_id")
    dim = cal.dim_time(v)
    for pre in (True, False):
        got = {(r.provider_id, r.lab_id, r.date_id): (r.patient_count, r.visit_count, r.lab_count)
               for r in wh.fact_lines(v, dim, lab, "lab_id", "lab_count", pre).collect()}
        assert got == {(7, 10, 1): (2, 3, 3), (8, 11, 2): (1, 1, 1)}


def test_quality_checks(spark):
    dim_rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    dups = dq.duplicate_keys(dim_rows, ["k"]).collect()
    assert [(r.k, r["count"]) for r in dups] == [(1, 2)]
    fact = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k long")
    assert dq.orphan_count(fact, dim_rows, "k").first().orphan_rows == 2
    assert [r.k for r in dq.orphan_rows(fact, dim_rows, "k").collect()] == [3, 3]
    nulls = {r.column_name: r.null_rows for r in dq.null_counts(fact).collect()}
    assert nulls == {"k": 1}


def test_reconcile_flags_differences(spark):
    s = spark.createDataFrame([(1, 5), (2, 3)], "k long, value long")
    f = spark.createDataFrame([(1, 5), (3, 1)], "k long, value long")
    got = {r.k: (r.source_value, r.fact_value, r.diff) for r in dq.reconcile(s, f, ["k"]).collect()}
    assert got == {1: (5, 5, 0), 2: (3, None, 3), 3: (None, 1, -1)}


def test_in_month_reaches_scan(spark, tmp_dir):
    from quarry.functions.dates import in_month
    v = _visits(spark, [(1, 1, 1, D(1996, 1, 31)), (2, 1, 1, D(1996, 2, 1))])
    v.write.parquet(tmp_dir + "/v")
    df = spark.read.parquet(tmp_dir + "/v").filter(in_month("visit_date", 1996, 1))
    assert [r.visit_id for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(visit_date" in plan and "LessThan(visit_date" in plan


def test_etl_then_checks_pass(spark, tmp_dir):
    from quarry.plans.warehouse_etl import run_checks, run_etl
    from quarry.sources.standins import Tables, clinical_sources
    src = clinical_sources(Tables(spark, "/root/testdata/sf0.001"))
    paths = run_etl(spark, src, tmp_dir + "/wh")
    assert set(paths) == {"dim_time", "dim_patient", "dim_provider", "dim_lab", "dim_procedure",
                          "dim_diagnosis", "fact_patient", "fact_lab", "fact_procedure",
                          "fact_diagnosis"}
    checks = run_checks(spark, src, paths)
    compared = [n for n in checks if n.endswith("_vs_source")]
    assert len(compared) == 13 and all(checks[n].count() == 0 for n in compared)
    assert all(r.null_rows == 0 for r in checks["null_date_ids"].collect())
    assert all(r.orphan_rows == 0 for r in checks["orphans"].collect())
    assert all(r.duplicate_keys == 0 for r in checks["duplicates"].collect())
    assert checks["ambiguous_months"].count() == 0
    assert checks["calendar"].count() == 0
    assert all(r.null_rows == 0 for r in checks["not_null"].collect())
    for name in ("fact_lab", "fact_procedure", "fact_diagnosis"):
        assert checks[f"{name}_vs_source"].count() == 0
    lab = spark.read.parquet(paths["fact_lab"])
    lab.withColumn("lab_count", F.when(F.col("lab_id") % 5 == 0, F.col("lab_count") + 1)
                   .otherwise(F.col("lab_count"))).write.parquet(tmp_dir + "/bad_lab")
    bad = run_checks(spark, src, {**paths, "fact_lab": tmp_dir + "/bad_lab"})
    assert bad["fact_lab_vs_source"].count() == lab.filter("lab_id % 5 = 0").count() > 0


def test_web_log_jobs(spark, tmp_dir):
    import os
    from quarry.plans import weblog_jobs as wj
    p = os.path.join(tmp_dir, "log.csv")
    with open(p, "w") as f:
        f.write("u1,q1,ff,linux,r1\nu2,q1,ff,mac,r1\nu1,q2,ch,linux,r2\n")
    out = wj.frequency_job(spark, p, tmp_dir + "/freq", "user_id", k=1)
    assert [tuple(r) for r in wj.read_result(spark, out).collect()] == [("u1", 2)]
    out = wj.busiest_job(spark, p, tmp_dir + "/ref", "referrer")
    assert [tuple(r) for r in wj.read_result(spark, out, wj.ARGMAX_RESULT).collect()] == [("r1", 2, 2)]
    out = wj.largest_tally_job(spark, p, tmp_dir + "/tally")
    assert [tuple(r) for r in wj.read_result(spark, out, wj.ARGMAX_RESULT).collect()] == [("ff", 2, 2)]


def test_skew_join_hot_key(spark):
    from quarry.operators.joins import hot_key_salts, skew_join
    many = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("k"),
        F.col("id").alias("v"))
    one = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    salts = dict(hot_key_salts(many, "k", 12))
    n7 = many.filter("k = 7").count()  # a bit over a third of the rows
    assert salts == {7: -(-n7 * 12 // 20000)}  # keys with one salt are left out
    for how in ("inner", "left"):
        got = skew_join(many, one, "k", how, partitions=12)
        want = many.join(one, "k", how)
        assert got.count() == want.count()
        assert sorted(map(tuple, got.select("k", "v", "w").collect())) == \
            sorted(map(tuple, want.select("k", "v", "w").collect()))


def test_positional_insert_and_rebuild(spark, tmp_dir):
    from quarry.schemas import DIM_LAB
    from quarry.sources.sinks import conform, insert_positional, save_table
    src = spark.createDataFrame([(1, "c1", "lab one"), (2, "c2", "lab two")],
                                "lab_id long, cpt_code string, lab_name string")
    spark.sql("DROP TABLE IF EXISTS quarry_dim_lab")
    spark.createDataFrame([], DIM_LAB).write.mode("overwrite").option(
        "path", tmp_dir + "/dim_lab_tbl").saveAsTable("quarry_dim_lab")
    # names differ, order matches: the insert goes by position
    insert_positional(src.toDF("a", "b", "c"), "quarry_dim_lab")
    got = sorted(tuple(r) for r in spark.table("quarry_dim_lab").collect())
    assert got == [(1, "c1", "lab one"), (2, "c2", "lab two")]
    out = save_table(src.select("lab_name", "lab_id", "cpt_code"), tmp_dir + "/dim_lab", DIM_LAB)
    assert spark.read.parquet(out).columns == ["lab_id", "cpt_code", "lab_name"]
    assert conform(src, DIM_LAB).schema.fieldNames() == ["lab_id", "cpt_code", "lab_name"]
    spark.sql("DROP TABLE IF EXISTS quarry_dim_lab")


def test_web_log_time_jobs(spark, tmp_dir):
    import os
    from quarry.plans import weblog_jobs as wj
    p = os.path.join(tmp_dir, "tm.csv")
    with open(p, "w") as f:
        f.write("timestamp,user_id,search_query,browser,os,referrer\n")
        f.write("2024-03-01 05:10:00,u1,q,ff,linux,r\n2024-03-01 05:20:00,u2,q,ff,linux,r\n")
        f.write("2024-03-02 06:00:00,u3,q,ch,mac,r\n")
    out = wj.busiest_date_part_job(spark, p, tmp_dir + "/parts")
    got = sorted(tuple(r) for r in wj.read_result(spark, out, wj.ARGMAX_RESULT).collect())
    assert got == [("2024", 3, 3), ("3", 3, 3)]  # year and month tie at 3
    out = wj.busiest_pair_job(spark, p.replace("tm.csv", "tm.csv"), tmp_dir + "/pair")
    # read as the 5-field log, the first field is the time: pairs are search_query:browser
    got = wj.read_result(spark, out, wj.ARGMAX_RESULT).collect()
    assert got and all(r["count"] == r.max_count for r in got)


def test_fact_lines_salted_equals_plain_with_hot_visit(spark):
    visits = spark.range(0, 300).select(
        F.col("id").alias("visit_id"), (F.col("id") % 7).alias("provider_id"),
        (F.col("id") % 11).alias("patient_id"),
        F.expr("date_add(date'2024-01-01', cast(id % 90 as int))").alias("visit_date"))
    lines = spark.range(0, 9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 300).cast("long")
        .alias("visit_id"), (F.col("id") % 13).alias("lab_id"))
    dim = cal.dim_time(visits)
    salted = wh.fact_lines(visits, dim, lines, "lab_id", "lab_count", skew="salt")
    plain = wh.fact_lines(visits, dim, lines, "lab_id", "lab_count", skew="aqe")
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    assert salted.agg(F.sum("lab_count")).first()[0] == 9000


SOURCES = "visit visit_lab visit_procedure visit_diagnosis patient provider lab clinical_procedures diagnosis".split()


def test_all_measures_and_null_keys_are_compared(spark, tmp_dir):
    from quarry.plans.warehouse_etl import run_checks, run_etl
    from quarry.sources.standins import Tables, clinical_sources
    src = clinical_sources(Tables(spark, "/root/testdata/sf0.001"))
    v = src["visit"]
    src = {n: src[n] for n in SOURCES} | {"visit": v.withColumn("provider_id", F.when(F.col("visit_id") % 10 != 3, F.col("provider_id")))
           .withColumn("patient_id", F.when(F.col("visit_id") % 10 != 5, F.col("patient_id")))}
    paths = run_etl(spark, src, tmp_dir + "/wh")
    checks = run_checks(spark, src, paths)  # rejected visits are in no fact and no finding
    assert all(checks[n].count() == 0 for n in checks if n.endswith("_vs_source"))
    for name, column in (("fact_patient", "visit_count"), ("fact_patient", "procedure_count"),
                         ("fact_patient", "diagnosis_count"), ("fact_lab", "patient_count"),
                         ("fact_procedure", "visit_count"), ("fact_diagnosis", "patient_count")):
        table = spark.read.parquet(paths[name])
        bad = f"{tmp_dir}/bad-{name}-{column}"
        table.withColumn(column, F.col(column) + 1).write.parquet(bad)
        found = run_checks(spark, src, {**paths, name: bad})
        assert [n for n in found if n.endswith("_vs_source") and found[n].count()] == [f"{name}_{column}_vs_source"]
    null_safe = dq.reconcile(spark.createDataFrame([(None, 1, 5), (1, None, 2)], "a int, b int, value int"),
                             spark.createDataFrame([(None, 1, 4), (2, 2, 1)], "a int, b int, value int"), ["a", "b"])
    assert sorted(map(tuple, null_safe.collect()), key=str) == sorted(
        [(None, 1, 5, 4, 1), (1, None, 2, None, 2), (2, 2, None, 1, -1)], key=str)


def test_a_rebuild_that_breaks_leaves_the_old_warehouse(spark, tmp_dir, monkeypatch):
    import os
    from quarry.plans.warehouse_etl import load, run_etl
    from quarry.sources import sinks, versions
    from quarry.sources.standins import Tables, clinical_sources
    src = clinical_sources(Tables(spark, "/root/testdata/sf0.001"))
    root = tmp_dir + "/wh"
    assert versions.current(spark, root) == {}
    run_etl(spark, src, root)
    before = {n: sorted(map(tuple, t.collect()), key=str) for n, t in load(spark, versions.current(spark, root)).items()}
    real, calls = sinks.save_table, []

    def breaks(*a, **k):
        calls.append(a)
        if len(calls) == 5:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(sinks, "save_table", breaks)
    half = {n: src[n] for n in SOURCES} | {"visit": src["visit"].filter("visit_id % 2 = 0")}
    with pytest.raises(RuntimeError):
        run_etl(spark, half, root)
    after = {n: sorted(map(tuple, t.collect()), key=str) for n, t in load(spark, versions.current(spark, root)).items()}
    assert after == before and len(calls) == 5
    monkeypatch.undo()
    paths = run_etl(spark, half, root)
    assert load(spark, paths)["fact_patient"].agg(F.sum("visit_count")).first()[0] < sum(r[3] for r in before["fact_patient"])
    # one version is left, with the ten tables alone
    left = [n for n in os.listdir(root) if n.startswith("v-")]
    assert len(left) == 1 and len([n for n in os.listdir(f"{root}/{left[0]}") if not n.startswith(".")]) == 10


def test_findings_count_each_fault(spark):
    from quarry.schemas import WAREHOUSE
    dims = {"provider_id": spark.createDataFrame([(1,), (2,)], "provider_id long"),
            "lab_id": spark.createDataFrame([(7,)], "lab_id long"), "date_id": spark.createDataFrame([(1,)], "date_id int")}
    rows = [(1, 7, 1, 1, 1, 1)] * 3 + [(2, 7, 1, 1, None, 1), (3, 7, 1, 1, 1, 1), (3, 8, 1, 1, 1, 1), (None, 7, 2, 1, 1, 1)]
    fact = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WAREHOUSE["fact_lab"].fields))
    got = {(r.check, r.column_name): r.findings for r in dq.table_findings("fact_lab", fact, dims).collect()}
    assert got[("rows", None)] == 7 and got[("duplicates", None)] == 1
    assert got[("orphans", "provider_id")] == 2 and got[("orphans", "lab_id")] == 1 and got[("orphans", "date_id")] == 1
    assert got[("null", "provider_id")] == 1 and got[("null", "visit_count")] == 1 and got[("null", "lab_count")] == 0
    frame = dq.table_findings("fact_lab", fact, dims)
    frame.collect()
    assert {r[1] for r in dq.table_findings("fact_lab", fact.limit(0), dims).select("check", "findings").collect()} == {0}


def test_positional_insert_checks_count_and_types(spark, tmp_dir):
    from quarry.sources.sinks import insert_positional
    spark.sql("DROP TABLE IF EXISTS quarry_ins")
    spark.sql(f"CREATE TABLE quarry_ins (a BIGINT, b STRING, d INT) USING parquet PARTITIONED BY (d) LOCATION '{tmp_dir}/ins'")
    insert_positional(spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "b int, d string, a int"), "quarry_ins")
    with pytest.raises(ValueError, match="3 columns"):
        insert_positional(spark.createDataFrame([(1, "x")], "a int, b string"), "quarry_ins")
    with pytest.raises(ValueError, match="do not fit"):
        insert_positional(spark.createDataFrame([("x", "x", 1)], "a string, b string, d int"), "quarry_ins")
    insert_positional(spark.createDataFrame([(9, "z", 2)], "p int, q string, r int"), "quarry_ins", overwrite=True)
    assert sorted(tuple(r) for r in spark.table("quarry_ins").collect()) == [(1, "x", 1), (9, "z", 2)]
    spark.sql("DROP TABLE quarry_ins")


def _exchanges(frame):
    import re
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", frame._jdf.queryExecution().executedPlan().toString())


def _hospital(spark, tmp_dir):
    v = _visits(spark, [(i, i % 3, i % 5, D(2024, 1 + i % 4, 3)) for i in range(40)])
    lab = _lines(spark, [(i % 40, i % 7) for i in range(200)], "lab_id")
    v.write.parquet(tmp_dir + "/v")
    lab.write.parquet(tmp_dir + "/l")
    return spark.read.parquet(tmp_dir + "/v"), spark.read.parquet(tmp_dir + "/l")


def test_fact_lines_are_exchanged_once_before_their_grouping(spark, tmp_dir):
    v, lab = _hospital(spark, tmp_dir)
    dim = spark.createDataFrame(cal.dim_time(v).collect(), cal.dim_time(v).schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        fact = wh.fact_lines(v, dim, lab, "lab_id", "lab_count")
        assert len(_exchanges(fact)) == 3  # lines, visits, groups
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    copies = wh.fact_lines(v, dim, lab, "lab_id", "lab_count", preaggregate=True)
    assert sorted(map(tuple, fact.collect())) == sorted(map(tuple, copies.collect()))
    assert fact.columns == copies.columns == ["provider_id", "lab_id", "date_id", "patient_count", "visit_count", "lab_count"]


def test_etl_bounds_its_partitions_and_gives_the_setting_back(spark, tmp_dir, monkeypatch):
    from quarry.plans import warehouse_etl
    from quarry.sources import sinks
    from quarry.sources.standins import Tables, clinical_sources
    name, seen, real = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], sinks.save_table
    before = spark.conf.get(name)
    monkeypatch.setattr(sinks, "save_table", lambda *a, **k: seen.append(spark.conf.get(name)) or real(*a, **k))
    warehouse_etl.run_etl(spark, clinical_sources(Tables(spark, "/root/testdata/sf0.001")), tmp_dir + "/wh")
    assert set(seen) == {"16m"} and spark.conf.get(name) == before


def test_source_lines_are_exchanged_once(spark, tmp_dir):
    v, lab = _hospital(spark, tmp_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = dq.source_measure(v, lab, ["provider_id", "lab_id"], "lab_id", "lab_id")
        assert len(_exchanges(found)) == 3  # lines, visits, groups
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.agg(F.sum("value")).first()[0] == 200


def test_findings_group_a_table_once(spark, tmp_dir):
    from quarry.schemas import WAREHOUSE
    names = WAREHOUSE["fact_lab"].names
    spark.range(50).select(*[(F.col("id") % (i + 2)).cast("int").alias(c) if c == "date_id" else
                             (F.col("id") % (i + 2)).alias(c) for i, c in enumerate(names)]).write.parquet(tmp_dir + "/f")
    fact = spark.read.parquet(tmp_dir + "/f")
    dims = {c: spark.range(2).select(F.col("id").alias(c)) for c in ("provider_id", "lab_id", "date_id")}
    frame = dq.table_findings("fact_lab", fact, dims)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert len([e for e in _exchanges(frame) if e.startswith("provider_id")]) == 1
    got = {(r.check, r.column_name): r.findings for r in frame.collect()}
    assert got[("rows", None)] == 50 and got[("duplicates", None)] == 12
    assert got[("orphans", "provider_id")] == 0 and got[("orphans", "lab_id")] == 16


def test_tables_of_a_kind_are_written_side_by_side(monkeypatch):
    """Two dimensions are under way at once, and facts begin when every dimension is written."""
    import threading

    from quarry.sources import sinks
    both, done = threading.Barrier(2), []

    def save(df, path, *_):
        if "/dim_" in path:
            both.wait(20)
        done.append(path)
        return path
    monkeypatch.setattr(sinks, "save_table", save)
    out = sinks.write_warehouse(None, dict.fromkeys(("fact_a", "dim_b", "dim_a")), "/root_of_all/")
    assert out == {n: f"/root_of_all/{n}" for n in ("dim_a", "dim_b", "fact_a")}
    assert done[-1].endswith("fact_a")


def test_small_partitions_hold_for_the_block_alone(spark):
    from quarry.session import rows_in_memory
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    with rows_in_memory(spark, "1m", scanned="2m"):
        assert [spark.conf.get(n) for n in names] == ["1m", "2m"]
    assert [spark.conf.get(n) for n in names] == before
