"""Delimited text scans.

The web log is plain comma-split text with no quoting: short rows pad with
null, extra fields are dropped, empty fields are null. A declared all-string
schema plus ``quote=""`` gives exactly that, with no inference pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from quarry.schemas import WEBLOG, WEBLOG_TM


def read_delimited(spark: SparkSession, path: str, schema: T.StructType,
                   sep: str = ",") -> DataFrame:
    return (spark.read.schema(schema)
            .option("sep", sep).option("quote", "").option("escape", "")
            .option("mode", "PERMISSIVE").option("header", "false")
            .csv(path))


def read_weblog(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, search_query, browser, os, referrer``."""
    return read_delimited(spark, path, WEBLOG)


def read_weblog_tm(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp`` plus the web-log fields. A header line, if present, stays
    in the data; drop it with :func:`quarry.operators.tokens.drop_header`."""
    return read_delimited(spark, path, WEBLOG_TM)


def read_csv_inferred(spark: SparkSession, path: str,
                      schema: T.StructType | None = None) -> DataFrame:
    """Header CSV. Without a schema the types are inferred from all of the data, like
    the original job; pass ``schema`` to skip that pass."""
    r = spark.read.option("header", "true")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", "true").csv(path)
