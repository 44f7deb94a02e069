"""Global order without a global sort in one task: rows are dealt by ranges of the
key, and only one summary row per range is put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import written


def dealt_by_range(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the number ``range_no`` of its key range, ascending with the key.
    Written out, because the ranges come from a sample: a second computation could
    cut them elsewhere."""
    return written(df.repartitionByRange(key).withColumn("range_no", F.spark_partition_id()), name)


def following(ids: DataFrame, key: str, value: str) -> DataFrame:
    """For every row the key and value of the row with the next larger key
    (``after_key``, ``after_value``); the largest key is followed by the smallest.
    ``ids`` comes from :func:`dealt_by_range` and holds each key once."""
    pair = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    within = Window.partitionBy("range_no").orderBy(key)
    # one row per range: bounded by the number of partitions
    heads = ids.groupBy("range_no").agg(F.min(pair).alias("head"))
    order = Window.orderBy("range_no")
    heads = heads.select(
        "range_no",
        F.coalesce(F.lead("head").over(order),
                   F.first("head").over(order.rowsBetween(Window.unboundedPreceding,
                                                          Window.unboundedFollowing))).alias("next_head"))
    rows = ids.withColumn("after", F.lead(pair).over(within))
    after = F.coalesce("after", "next_head")
    return rows.join(F.broadcast(heads), "range_no").select(
        key, value, after["k"].alias("after_key"), after["v"].alias("after_value"))


def range_offsets(ids: DataFrame, amount: str) -> DataFrame:
    """Per range the sum of ``amount`` over all smaller ranges (``before``): one row
    per range, bounded by the number of partitions."""
    sums = ids.groupBy("range_no").agg(F.sum(amount).alias("total"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("range_no", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
