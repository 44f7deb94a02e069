"""Web-log token analytics: frequencies, top-k, and arg-max with ties.

Plan shape: partial count -> hash exchange on the token -> final count. The
arg-max joins the counts with their one-row maximum by broadcast, so the big
side never shuffles again and the count exchange is reused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.dates import parse_timestamp
from quarry.functions.text import strip_spaces, token_concat, tokenize


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def select_token(df: DataFrame, token, alias: str = "token") -> DataFrame:
    """One column (a name or an expression) as the token."""
    return df.select(_c(token).alias(alias))


def count_tokens(df: DataFrame, key="token", count_name: str = "count") -> DataFrame:
    """``key, count``. Counts non-null values, so a null key forms its own
    group with count 0. ``key`` may be a list for composite tokens."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    return df.groupBy(*keys).agg(F.count(_c(keys[0])).alias(count_name))


def max_count(counts: DataFrame, count_name: str = "count") -> DataFrame:
    """One row: ``max_count``."""
    return counts.agg(F.max(count_name).alias("max_count"))


def keep_max(counts: DataFrame, count_name: str = "count") -> DataFrame:
    """Rows whose count equals the overall maximum, all ties kept, with the
    maximum attached. The maximum is a one-row frame: safe to broadcast."""
    mx = F.broadcast(max_count(counts, count_name))
    return counts.join(mx, F.col(count_name) == F.col("max_count"), "inner")


def sort_counts(counts: DataFrame, key: str = "token", count_name: str = "count") -> DataFrame:
    """Descending by count, ties by token (the global sort range-partitions)."""
    return counts.orderBy(F.desc(count_name), F.asc_nulls_last(key))


def top_k(counts: DataFrame, k: int, key: str = "token", count_name: str = "count") -> DataFrame:
    """First ``k`` rows of :func:`sort_counts`; planned as a per-partition
    top-k plus a k-row merge (TakeOrderedAndProject), no full sort."""
    return sort_counts(counts, key, count_name).limit(k)


def token_frequencies(df: DataFrame, token, k: int | None = None) -> DataFrame:
    """Token, count, descending (the frequency job); ``k`` keeps the top k."""
    counts = count_tokens(select_token(df, token))
    return sort_counts(counts) if k is None else top_k(counts, k)


def busiest(df: DataFrame, token) -> DataFrame:
    """Most frequent token(s): ``token, count, max_count``."""
    return keep_max(count_tokens(select_token(df, token)))


def pair_token(browser="browser", os="os") -> Column:
    """``browser:os`` (null when either part is null)."""
    return token_concat(browser, os, sep=":")


def busiest_pair(df: DataFrame, browser="browser", os="os") -> DataFrame:
    return busiest(df, pair_token(browser, os))


def largest_tally(df: DataFrame, group: str = "browser", tallied: str = "os",
                  tally_name: str = "os_count") -> DataFrame:
    """Per ``group`` the number of non-null ``tallied`` values; keep the
    group(s) with the largest tally: ``group, tally, max_count``."""
    counts = df.groupBy(group).agg(F.count(tallied).alias(tally_name))
    return keep_max(counts, tally_name)


def drop_header(df: DataFrame, column: str = "timestamp", header: str | None = None) -> DataFrame:
    """Drop embedded header rows (``column != header``; null values go too)."""
    return df.filter(F.col(column) != F.lit(header or column))


HOUR_PARTS = ("log_yr", "log_mn", "log_day", "log_hr")


def hour_parts(df: DataFrame, ts: str = "timestamp", parse: bool = True) -> DataFrame:
    """``log_yr, log_mn, log_day, log_hr`` of a text (or timestamp) column;
    unparsable text gives nulls. The parse happens once."""
    t = parse_timestamp(ts) if parse else F.col(ts)
    return (df.select(t.alias("_ts"))
            .select(F.year("_ts").alias("log_yr"), F.month("_ts").alias("log_mn"),
                    F.dayofmonth("_ts").alias("log_day"), F.hour("_ts").alias("log_hr")))


def busiest_hour(df: DataFrame, ts: str = "timestamp", parse: bool = True,
                 header: bool = True) -> DataFrame:
    """Busiest ``(year, month, day, hour)`` bucket(s) with count and maximum.
    A bucket is counted by its year, so unparsable rows count 0."""
    if header and parse:
        df = drop_header(df, ts)
    parts = hour_parts(df, ts, parse)
    return keep_max(count_tokens(parts, list(HOUR_PARTS)))


def busiest_date_part(df: DataFrame, ts: str = "timestamp", parse: bool = True,
                      header: bool = True) -> DataFrame:
    """The four date parts pooled as text tokens; busiest token(s)."""
    if header and parse:
        df = drop_header(df, ts)
    parts = hour_parts(df, ts, parse)
    tokens = parts.select(F.explode(F.array(*[F.col(p).cast("string") for p in HOUR_PARTS]))
                          .alias("token"))
    return keep_max(count_tokens(tokens))


def text_tokens(df: DataFrame, text: str, with_counts: bool = True) -> DataFrame:
    """Tokenize text and un-nest to one token per row; optionally counted."""
    toks = df.select(F.explode(tokenize(text)).alias("token"))
    return count_tokens(toks) if with_counts else toks


def remove_spaces(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or column, strip_spaces(column))
