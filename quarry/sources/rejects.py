"""A text log with its faulty lines named.

The plain scans (quarry.sources.delimited) keep every line: short ones are padded with
null, surplus fields are dropped, a malformed time becomes null later on. Here
the same rows come with the line they were read from, where its number of fields is
wrong, so that a job can store what was wrong with its input beside its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarry.functions.dates import parse_timestamp

#: The reader's column for a line whose number of fields is not the schema's.
LINE = "_line"


def read_with_lines(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """The rows of :func:`quarry.sources.delimited.read_delimited` (all lines, padded or cut)
    with ``_line``: the whole line where it is too short or too long, else null. Blank
    lines are no rows, as in that scan."""
    return (spark.read.schema(T.StructType(schema.fields + [T.StructField(LINE, T.StringType())]))
            .option("sep", sep).option("quote", "").option("escape", "")
            # a scan of some fields only would not count the others
            .option("columnPruning", "false")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
            .option("header", "false").csv(path))


def fault(schema: T.StructType, sep: str = ",", timestamp: str | None = None) -> Column:
    """What is wrong with a row of :func:`read_with_lines`, the first that holds: ``short``, ``long``,
    ``time`` (text in ``timestamp`` that is no time; an absent one is none), else null."""
    fields = F.size(F.split(LINE, f"\\Q{sep}\\E", -1))
    # a short line's last field is absent; naming it keeps the scan from reading the lines alone
    short = (fields < len(schema.fields)) & F.col(schema.fields[-1].name).isNull()
    wrong = F.when(short, "short").when(F.col(LINE).isNotNull(), "long")
    if timestamp is None:
        return wrong
    return wrong.when(F.col(timestamp).isNotNull() & parse_timestamp(timestamp).isNull(), "time")


def ledger(rows: DataFrame, schema: T.StructType, sep: str = ",", timestamp: str | None = None,
           header: bool = False, count_distinct: str | None = None) -> DataFrame:
    """Counts of faulty lines: ``fault, lines`` and, if asked, ``distinct_values`` of a column among
    them. One partial count before the exchange; at most three rows. ``header``: lines
    that hold the column's own name as their time are no faults."""
    if header:
        rows = rows.filter(~F.col(timestamp).eqNullSafe(F.lit(timestamp)))
    named = rows.withColumn("fault", fault(schema, sep, timestamp)).filter("fault IS NOT NULL")
    if count_distinct is None:
        return named.groupBy("fault").agg(F.count(F.lit(1)).alias("lines"))
    # counted per value first: no set of values lies in one task
    per_value = named.groupBy("fault", F.col(count_distinct).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return per_value.groupBy("fault").agg(F.sum("_n").alias("lines"), F.count("_v").alias("distinct_values"))
