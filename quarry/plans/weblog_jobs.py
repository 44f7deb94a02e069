"""The web-log jobs end to end: load the log, compute, store the result as
tab-separated part files (the store fails if the folder exists).

Job parameters are plain arguments (token column, k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from quarry.operators import tokens as tk
from quarry.schemas import WEBLOG_TM
from quarry.sources import rejects
from quarry.sources.delimited import read_delimited, read_weblog, read_weblog_tm
from quarry.sources.sinks import store_delimited


def frequency_job(spark: SparkSession, log_path: str, out: str, token: str = "search_query",
                  k: int | None = None) -> str:
    """Token frequencies, descending (top ``k`` when given)."""
    return store_delimited(tk.token_frequencies(read_weblog(spark, log_path), token, k), out)


def busiest_job(spark: SparkSession, log_path: str, out: str, token: str = "referrer") -> str:
    """Most frequent value(s) of one column, with count and maximum."""
    return store_delimited(tk.busiest(read_weblog(spark, log_path), token), out)


def busiest_pair_job(spark: SparkSession, log_path: str, out: str) -> str:
    """Most frequent ``browser:os`` pair(s)."""
    return store_delimited(tk.busiest_pair(read_weblog(spark, log_path)), out)


def largest_tally_job(spark: SparkSession, log_path: str, out: str, group: str = "browser",
                      tallied: str = "os") -> str:
    """Browser(s) with the largest number of non-null OS values."""
    df = tk.largest_tally(read_weblog(spark, log_path), group, tallied, "os_count")
    return store_delimited(df, out)


def busiest_hour_job(spark: SparkSession, log_path: str, out: str) -> str:
    """Busiest (year, month, day, hour) of a log with a header line."""
    return store_delimited(tk.busiest_hour(read_weblog_tm(spark, log_path)), out)


def busiest_date_part_job(spark: SparkSession, log_path: str, out: str) -> str:
    """Busiest date-part token (year, month, day and hour pooled)."""
    return store_delimited(tk.busiest_date_part(read_weblog_tm(spark, log_path)), out)


def audited_hour_job(spark: SparkSession, log_path: str, out: str, ledger_out: str) -> str:
    """Busiest hour of a log with a header line; the counts of short, long and malformed-time
    lines are stored first, beside the result, as ``fault, lines``."""
    rows = rejects.read_with_lines(spark, log_path, WEBLOG_TM)
    store_delimited(rejects.ledger(rows, WEBLOG_TM, timestamp="timestamp", header=True), ledger_out)
    return busiest_hour_job(spark, log_path, out)


TOKEN_RESULT = T.StructType([T.StructField("token", T.StringType()),
                             T.StructField("count", T.LongType())])
ARGMAX_RESULT = T.StructType(TOKEN_RESULT.fields + [T.StructField("max_count", T.LongType())])


def read_result(spark: SparkSession, path: str, schema: T.StructType = TOKEN_RESULT) -> DataFrame:
    """Load a stored job result (tab-separated, no header)."""
    return read_delimited(spark, path, schema, sep="\t")
