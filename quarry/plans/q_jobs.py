"""Registered queries that run a job from text to its stored result, or over tables that
a job has written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarry.functions.dates import LOG_TS_FORMAT
from quarry.plans import weblog_jobs as jobs
from quarry.plans.q_warehouse import _sql, _src
from quarry.plans.registry import query
from quarry.schemas import WEBLOG_TM
from quarry.session import scratch_path
from quarry.sources import rejects
from quarry.sources.sinks import store_delimited
from quarry.sources.standins import Tables, weblog_from_documents, weblog_tm_from_events


def _text_log(spark, sf):
    return store_delimited(weblog_from_documents(Tables(spark, sf).documents), scratch_path(spark, "log"), sep=",")


# an empty field of the text is null
LOG_ROWS = """
WITH log AS (SELECT nullif(lang, '') AS browser, nullif(source, '') AS os, nullif(source, '') AS referrer FROM documents)
"""


@query("job_busiest_referrer", LOG_ROWS + """
, ranked AS (SELECT referrer AS token, count(referrer) AS count, max(count(referrer)) OVER () AS max_count
             FROM log GROUP BY referrer)
SELECT * FROM ranked WHERE count = max_count
""")
def job_busiest_referrer(spark, sf):
    """A text log in, the busiest referrer out of the stored result."""
    out = jobs.busiest_job(spark, _text_log(spark, sf), scratch_path(spark, "referrer"), "referrer")
    return jobs.read_result(spark, out, jobs.ARGMAX_RESULT)


@query("job_busiest_pair", LOG_ROWS + """
, ranked AS (SELECT browser || ':' || os AS token, count(browser || ':' || os) AS count,
                    max(count(browser || ':' || os)) OVER () AS max_count FROM log GROUP BY 1)
SELECT * FROM ranked WHERE count = max_count
""")
def job_busiest_pair(spark, sf):
    out = jobs.busiest_pair_job(spark, _text_log(spark, sf), scratch_path(spark, "pair"))
    return jobs.read_result(spark, out, jobs.ARGMAX_RESULT)


@query("job_largest_tally", LOG_ROWS + """
, ranked AS (SELECT browser, count(os) AS os_count, max(count(os)) OVER () AS max_count FROM log GROUP BY browser)
SELECT * FROM ranked WHERE os_count = max_count
""")
def job_largest_tally(spark, sf):
    out = jobs.largest_tally_job(spark, _text_log(spark, sf), scratch_path(spark, "tally"))
    return jobs.read_result(spark, out, jobs.ARGMAX_RESULT).toDF("browser", "os_count", "max_count")


@query("job_busiest_date_part", """
WITH parts AS (SELECT unnest([year(ts), month(ts), day(ts), hour(ts)]) AS part FROM events)
, ranked AS (SELECT CAST(part AS VARCHAR) AS token, count(part) AS count, max(count(part)) OVER () AS max_count
             FROM parts GROUP BY part)
SELECT * FROM ranked WHERE count = max_count
""")
def job_busiest_date_part(spark, sf):
    log = store_delimited(weblog_tm_from_events(Tables(spark, sf).events), scratch_path(spark, "log-tm"),
                          sep=",", header=True)
    out = jobs.busiest_date_part_job(spark, log, scratch_path(spark, "part"))
    return jobs.read_result(spark, out, jobs.ARGMAX_RESULT)


# ----------------------------------------------------------------- a log with faults
def _damaged_log(spark, sf) -> str:
    """All events as lines under a header: every seventh without its last two fields,
    every eleventh with one more, every thirteenth with a time that is none."""
    ev = Tables(spark, sf).events
    time = F.when(F.col("event_id") % 13 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", LOG_TS_FORMAT))
    line = F.concat_ws(",", time, F.col("user_id").cast("string"), "event_type", "event_type",
                       *[F.when(F.col("event_id") % 7 != 0, F.lit(x)) for x in ("linux", "home")],
                       F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 11 == 0), F.lit("surplus")))
    path = scratch_path(spark, "damaged-log")
    header = spark.createDataFrame([(",".join(WEBLOG_TM.names),)], "line string")
    header.unionByName(ev.select(line.alias("line"))).write.text(path)
    return path


@query("log_rejects", """
SELECT fault, count(*) AS lines, count(DISTINCT user_id) AS distinct_values
FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN 'short' WHEN event_id % 11 = 0 THEN 'long'
                           WHEN event_id % 13 = 0 THEN 'time' END AS fault FROM events)
WHERE fault IS NOT NULL GROUP BY fault
""")
def log_rejects(spark, sf):
    """Faulty lines of a damaged log by kind, and how many users they are from."""
    rows = rejects.read_with_lines(spark, _damaged_log(spark, sf), WEBLOG_TM)
    return rejects.ledger(rows, WEBLOG_TM, timestamp="timestamp", header=True, count_distinct="user_id")


@query("job_audited_hour", """
WITH hours AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY 1)
, top AS (SELECT 'hour' AS kind, strftime(h, '%Y-%m-%d %H') AS item, n AS lines FROM hours
          WHERE n = (SELECT max(n) FROM hours))
SELECT * FROM top UNION ALL
SELECT 'fault', CASE WHEN event_id % 7 = 0 THEN 'short' WHEN event_id % 11 = 0 THEN 'long' ELSE 'time' END, count(*)
FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 GROUP BY 2
""")
def job_audited_hour(spark, sf):
    """The audited job over a damaged log: its stored result and its stored ledger."""
    out, faults = scratch_path(spark, "hour"), scratch_path(spark, "ledger")
    jobs.audited_hour_job(spark, _damaged_log(spark, sf), out, faults)
    schema = "log_yr int, log_mn int, log_day int, log_hr int, count long, max_count long"
    hours = spark.read.schema(schema).option("sep", "\t").csv(out).select(
        F.lit("hour").alias("kind"), F.format_string("%d-%02d-%02d %02d", "log_yr", "log_mn", "log_day", "log_hr").alias("item"),
        F.col("count").alias("lines"))
    return hours.unionByName(jobs.read_result(spark, faults).select(
        F.lit("fault").alias("kind"), F.col("token").alias("item"), F.col("count").alias("lines")))


# ----------------------------------------------------------------- facts stored by month
_BY_MONTH: dict[tuple[str, str], str] = {}


def _by_month(spark, sf) -> dict[str, DataFrame]:
    """The written warehouse with a folder per month of each fact; one ETL run per session."""
    from quarry.plans.warehouse_etl import load, run_etl
    from quarry.sources import versions
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BY_MONTH or not versions.current(spark, _BY_MONTH[key]):
        root = scratch_path(spark, "warehouse-by-month")
        run_etl(spark, _src(spark, sf), root, by_month=True)
        _BY_MONTH[key] = root
    return load(spark, versions.current(spark, _BY_MONTH[key]))


_MEASURES = {"fact_patient": "visit_count", "fact_lab": "lab_count", "fact_procedure": "procedure_count",
             "fact_diagnosis": "diagnosis_frequency"}


@query("facts_of_month", _sql("\nUNION ALL ".join(
    f"SELECT '{n}' AS fact, provider_id, count(*) AS rows, CAST(sum({m}) AS BIGINT) AS total FROM {n} "
    f"WHERE date_id IN (SELECT date_id FROM visit_months WHERE year(visit_date) = 1997 AND month(visit_date) = 3) "
    f"GROUP BY provider_id" for n, m in _MEASURES.items()), facts=True))
def facts_of_month(spark, sf):
    """One month of every fact by provider, chosen by year and month name in the calendar;
    only that month's folders are read."""
    from quarry.plans.warehouse_etl import month_of_fact
    t = _by_month(spark, sf)
    return reduce(DataFrame.unionByName, [
        month_of_fact(t, n, 1997, "March").groupBy("provider_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(m).alias("total"))
        .select(F.lit(n).alias("fact"), "provider_id", "rows", "total") for n, m in _MEASURES.items()])
