
from pyspark.sql import functions as F

from quarry.operators import calendar as cal, profile as pf, tokens as tk, warehouse as wh
from quarry.sources.standins import Tables, clinical_sources

MID = "/root/testdata/sf0.01"


def test_token_counts_sum_to_non_null_rows(spark):
    ev = Tables(spark, MID).events
    total = tk.count_tokens(tk.select_token(ev, "event_type")).agg(F.sum("count")).first()[0]
    assert total == ev.filter(F.col("event_type").isNotNull()).count()


def test_arg_max_rows_carry_the_maximum(spark):
    docs = Tables(spark, MID).documents
    counts = tk.count_tokens(tk.select_token(docs, "source"))
    top = tk.busiest(docs, "source").collect()
    mx = counts.agg(F.max("count")).first()[0]
    assert top and all(r["count"] == r.max_count == mx for r in top)
    assert len(top) == counts.filter(F.col("count") == mx).count()


def test_fact_visits_add_up(spark):
    src = clinical_sources(Tables(spark, MID))
    dim = cal.dim_time(src["visit"])
    facts = wh.facts(src, dim)
    visits = src["visit"].count()
    in_fact = facts["fact_patient"].agg(F.sum("visit_count")).first()[0]
    rejected = wh.rejected_visits(src["visit"], dim).count()
    assert in_fact + rejected == visits
    lab_lines = src["visit_lab"].filter(F.col("lab_id").isNotNull())
    fact_lab = facts["fact_lab"].agg(F.sum("lab_count")).first()[0]
    lab_in_patient = facts["fact_patient"].agg(F.sum("lab_count")).first()[0]
    assert fact_lab == lab_in_patient <= lab_lines.count()


def test_crosstab_total_is_row_count(spark):
    li = Tables(spark, MID).lineitem
    ct = pf.crosstab(li, "l_returnflag", "l_linestatus")
    total = ct.select(sum(F.col(c) for c in ct.columns[1:]).alias("t")).agg(F.sum("t")).first()[0]
    assert total == li.count()
    e = pf.expected_frequencies(li, "l_returnflag", "l_linestatus")
    sums = e.agg(F.sum("observed"), F.sum("expected")).first()
    assert sums[0] == li.count() and abs(sums[1] - li.count()) < 1e-3


def test_calendar_covers_every_visit_once(spark):
    src = clinical_sources(Tables(spark, MID))
    dim = cal.dim_time(src["visit"])
    rows = dim.orderBy("date_id").collect()
    assert [r.date_id for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.end_dt < b.start_dt for a, b in zip(rows, rows[1:]))
    vm = cal.visit_month(src["visit"], dim)
    assert vm.count() == src["visit"].count()
    assert vm.filter(F.col("date_id").isNull() & F.col("visit_date").isNotNull()).count() == 0
