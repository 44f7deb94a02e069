"""Registered web-log queries (stand-ins per FIXTURES.md section 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.dates import LOG_TS_FORMAT
from quarry.operators import tokens as tk
from quarry.plans.registry import query
from quarry.sources.standins import Tables


@query("token_count", """
SELECT event_type AS token, count(event_type) AS count FROM events GROUP BY event_type
""")
def token_count(spark, sf):
    return tk.count_tokens(tk.select_token(Tables(spark, sf).events, "event_type"))


@query("token_frequency", """
SELECT p_name AS token, count(p_name) AS count FROM part GROUP BY p_name
""")
def token_frequency(spark, sf):
    """Frequency job as stored: every token, descending by count."""
    return tk.token_frequencies(Tables(spark, sf).part, "p_name")


@query("top_tokens", """
SELECT p_name AS token, count(p_name) AS count FROM part GROUP BY p_name
ORDER BY count DESC, token ASC NULLS LAST LIMIT 10
""")
def top_tokens(spark, sf):
    return tk.token_frequencies(Tables(spark, sf).part, "p_name", k=10)


@query("top_users", """
SELECT user_id AS token, count(user_id) AS count FROM events GROUP BY user_id
ORDER BY count DESC, token ASC NULLS LAST LIMIT 5
""")
def top_users(spark, sf):
    return tk.token_frequencies(Tables(spark, sf).events, "user_id", k=5)


@query("busiest_referrer", """
WITH c AS (SELECT source AS token, count(source) AS count FROM documents GROUP BY source)
SELECT token, count, (SELECT max(count) FROM c) AS max_count FROM c
WHERE count = (SELECT max(count) FROM c)
""")
def busiest_referrer(spark, sf):
    return tk.busiest(Tables(spark, sf).documents, "source")


BUSIEST_PAIR_SQL = """
WITH c AS (SELECT lang || ':' || source AS token, count(lang || ':' || source) AS count
           FROM documents GROUP BY 1)
SELECT token, count, (SELECT max(count) FROM c) AS max_count FROM c
WHERE count = (SELECT max(count) FROM c)
"""


@query("busiest_pair", BUSIEST_PAIR_SQL)
def busiest_pair(spark, sf):
    return tk.busiest_pair(Tables(spark, sf).documents, "lang", "source")


@query("largest_tally", """
WITH c AS (SELECT d.lang AS lang, count(l.quality) AS os_count
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang)
SELECT lang, os_count, (SELECT max(os_count) FROM c) AS max_count FROM c
WHERE os_count = (SELECT max(os_count) FROM c)
""")
def largest_tally(spark, sf):
    t = Tables(spark, sf)
    df = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"),
                                                   "doc_id", "left")
    return tk.largest_tally(df, "lang", "quality", "os_count")


_HOUR_CTE = """
WITH p AS (SELECT CAST(year(ts) AS INTEGER) AS log_yr, CAST(month(ts) AS INTEGER) AS log_mn,
                  CAST(day(ts) AS INTEGER) AS log_day, CAST(hour(ts) AS INTEGER) AS log_hr
           FROM (SELECT strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts
                 FROM events))
"""


@query("busiest_hour", _HOUR_CTE + """
, c AS (SELECT log_yr, log_mn, log_day, log_hr, count(log_yr) AS count FROM p
        GROUP BY log_yr, log_mn, log_day, log_hr)
SELECT *, (SELECT max(count) FROM c) AS max_count FROM c WHERE count = (SELECT max(count) FROM c)
""")
def busiest_hour(spark, sf):
    from quarry.sources.standins import weblog_tm_from_events
    log = weblog_tm_from_events(Tables(spark, sf).events)
    return tk.busiest_hour(log, "timestamp")


@query("busiest_date_part", _HOUR_CTE + """
, t AS (SELECT CAST(v AS VARCHAR) AS token FROM p,
        unnest([log_yr, log_mn, log_day, log_hr]) AS u(v))
, c AS (SELECT token, count(token) AS count FROM t GROUP BY token)
SELECT token, count, (SELECT max(count) FROM c) AS max_count FROM c
WHERE count = (SELECT max(count) FROM c)
""")
def busiest_date_part(spark, sf):
    from quarry.sources.standins import weblog_tm_from_events
    log = weblog_tm_from_events(Tables(spark, sf).events)
    return tk.busiest_date_part(log, "timestamp")


@query("strip_spaces", """
SELECT p_partkey, replace(p_name, ' ', '') AS search_query FROM part
""")
def strip_spaces(spark, sf):
    part = Tables(spark, sf).part.select("p_partkey", F.col("p_name").alias("search_query"))
    return tk.remove_spaces(part, "search_query")


@query("drop_header", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(user_id AS VARCHAR) AS user_id,
       event_type AS search_query FROM events
""")
def drop_header(spark, sf):
    """The timestamped log with a header row unioned in, then dropped."""
    ev = Tables(spark, sf).events.select(
        F.date_format("ts", LOG_TS_FORMAT).alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("search_query"))
    header = spark.createDataFrame([("timestamp", "user_id", "search_query")], ev.schema)
    return tk.drop_header(ev.unionByName(header), "timestamp")


@query("text_tokens", """
WITH t AS (SELECT unnest(string_split_regex(p_name, '[ ",()*]+')) AS token FROM part)
SELECT token, count(token) AS count FROM t WHERE token <> '' GROUP BY token
""")
def text_tokens(spark, sf):
    return tk.text_tokens(Tables(spark, sf).part, "p_name")


# ----------------------------------------------------------------- sources and sinks
@query("weblog_round_trip", """
SELECT event_type AS token, count(event_type) AS count FROM events GROUP BY event_type
""")
def weblog_round_trip(spark, sf):
    """Events stored as comma-split web-log text, loaded back with the
    declared schema, then the frequency job on ``search_query``."""
    from quarry.session import scratch_path
    from quarry.sources.sinks import store_delimited
    from quarry.sources.standins import weblog_from_events
    from quarry.plans.weblog_jobs import frequency_job, read_result
    path = store_delimited(weblog_from_events(Tables(spark, sf).events),
                           scratch_path(spark, "weblog"), sep=",")
    out = frequency_job(spark, path, scratch_path(spark, "freq"), "search_query")
    return read_result(spark, out)


@query("weblog_tm_round_trip", _HOUR_CTE + """
, c AS (SELECT log_yr, log_mn, log_day, log_hr, count(log_yr) AS count FROM p
        GROUP BY log_yr, log_mn, log_day, log_hr)
SELECT *, (SELECT max(count) FROM c) AS max_count FROM c WHERE count = (SELECT max(count) FROM c)
""")
def weblog_tm_round_trip(spark, sf):
    """Timestamped log stored with a header line per part file, loaded back
    as text, header dropped, busiest hour."""
    from quarry.session import scratch_path
    from quarry.sources.sinks import store_delimited
    from quarry.sources.standins import weblog_tm_from_events
    from quarry.plans.weblog_jobs import busiest_hour_job
    path = store_delimited(weblog_tm_from_events(Tables(spark, sf).events),
                           scratch_path(spark, "weblog-tm"), sep=",", header=True)
    out = busiest_hour_job(spark, path, scratch_path(spark, "hour"))
    schema = "log_yr int, log_mn int, log_day int, log_hr int, count long, max_count long"
    return spark.read.schema(schema).option("sep", "\t").csv(out)


@query("stream_token_count", """
SELECT event_type AS token, count(event_type) AS count FROM events GROUP BY event_type
""")
def stream_token_count(spark, sf):
    from quarry.streaming import run_available_now, stream_table, token_counts
    t = Tables(spark, sf)
    s = stream_table(spark, f"{sf.rstrip('/')}/events*.parquet", t.events)
    return run_available_now(spark, token_counts(s, "event_type"), "update", "tokens")


@query("stream_hour_counts", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS count FROM events GROUP BY 1
""")
def stream_hour_counts(spark, sf):
    from quarry.streaming import hour_counts, run_available_now, stream_table
    t = Tables(spark, sf)
    s = stream_table(spark, f"{sf.rstrip('/')}/events*.parquet", t.events)
    return run_available_now(spark, hour_counts(s), "update", "hours")


@query("stream_hour_counts_by_file", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS count FROM events GROUP BY 1
""")
def stream_hour_counts_by_file(spark, sf):
    """The same over files that come one by one and out of order."""
    from quarry.session import scratch_path
    from quarry.streaming import hour_counts, run_available_now, stream_table
    events = Tables(spark, sf).events
    folder = scratch_path(spark, "events-by-file")
    events.repartition(4, "event_id").write.parquet(folder)
    s = stream_table(spark, folder, events, max_files_per_trigger=1)
    return run_available_now(spark, hour_counts(s), "update", "hours-by-file")


@query("stream_log_frequency", """
SELECT event_type AS token, count(event_type) AS count FROM events GROUP BY event_type
""")
def stream_log_frequency(spark, sf):
    """The events written as a comma-split log folder, read back as a file
    stream with the declared schema, search-query counts kept as state."""
    from quarry.session import scratch_path
    from quarry.sources.sinks import store_delimited
    from quarry.sources.standins import weblog_from_events
    from quarry.streaming import log_stream, run_available_now, token_counts
    folder = store_delimited(weblog_from_events(Tables(spark, sf).events),
                             scratch_path(spark, "weblog-stream"), sep=",")
    return run_available_now(spark, token_counts(log_stream(spark, folder), "search_query"),
                             "update", "log-tokens")


@query("stream_busiest", """
WITH c AS (SELECT event_type AS token, count(event_type) AS count FROM events GROUP BY event_type)
SELECT token, count, (SELECT max(count) FROM c) AS max_count FROM c
WHERE count = (SELECT max(count) FROM c)
""")
def stream_busiest(spark, sf):
    """Running token counts from a stream, then the arg-max (ties kept) over
    the latest counts."""
    from quarry.streaming import run_available_now, stream_table, token_counts
    t = Tables(spark, sf)
    s = stream_table(spark, f"{sf.rstrip('/')}/events*.parquet", t.events)
    return tk.keep_max(run_available_now(spark, token_counts(s, "event_type"), "update", "busy"))
