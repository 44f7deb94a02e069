"""Exact quantiles without gathering a column's distinct values in one task.

1. Every (group, column, value) is counted, with map-side partial counts, so a
   value or a group that holds a large share of the rows collapses before it
   is shuffled.
2. The counts are dealt by ranges of (group, column, value) and written to
   the shared scratch folder; the ranges come from a sample, so they are
   computed once. Each range is one partition, whatever the column's size.
3. One total per (group, column, range) gives the rank at which each range
   begins; a wanted rank falls in exactly one range.
4. Only the ranges that hold a wanted rank are searched, each by a running
   sum inside it.

There is one path for every input size, and no task's input grows with the
column. Rank conventions: ``interpolate=True`` is linear interpolation between
the order statistics around p*(n-1) (pandas' default, Spark ``percentile``);
``False`` is the value at rank ceil(p*n) (a zero-error ``approxQuantile``,
``percentile_disc``). Nulls and NaN are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.session import scratch_path


def _dealt_counts(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``g (struct of by and variable), x, c, part``: counts in range partitions."""
    spark = df.sparkSession
    counts = (df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot(by, cols, "variable", "x")
              .filter(F.col("x").isNotNull() & ~F.isnan("x"))
              .groupBy(F.struct(*by, "variable").alias("g"), "x")
              .agg(F.count(F.lit(1)).alias("c")))
    path = scratch_path(spark, "quantile-counts")
    dealt = counts.repartitionByRange("g", "x").withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def exact_quantiles(df: DataFrame, cols: list[str], probs, interpolate: bool = True,
                    by: list[str] | tuple = ()) -> DataFrame:
    """Long result: ``by..., variable, p, value`` (one row per group, column
    and probability; groups with no values are absent, null is a group)."""
    by = list(by)
    dealt = _dealt_counts(df, cols, by)
    # one row per group and range it reaches into
    parts = dealt.groupBy("g", "part").agg(F.sum("c").alias("size"))
    before = F.sum("size").over(Window.partitionBy("g").orderBy("part")) - F.col("size")
    n = F.sum("size").over(Window.partitionBy("g"))
    parts = parts.select("g", "part", "size", before.alias("before"), n.alias("n"))
    p = F.col("p")
    if interpolate:
        at = p * (F.col("n") - 1)
        ranks = F.array(F.floor(at) + 1, F.ceil(at) + 1)
        share = at - F.floor(at)
    else:
        ranks = F.array(F.greatest(F.lit(1), F.ceil(p * F.col("n"))))
        share = F.lit(0.0)
    wanted = (parts.withColumn("p", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
              .select("g", "part", "size", "before", "p", share.alias("share"),
                      F.posexplode(ranks).alias("side", "rank"))
              .filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("size"))))
    running = F.sum("c").over(Window.partitionBy("g", "part").orderBy("x"))
    searched = dealt.join(wanted.select("g", "part").distinct(), ["g", "part"], "left_semi")
    searched = searched.withColumn("upto", running)
    found = (wanted.join(searched, ["g", "part"]).filter(F.col("before") + F.col("upto") >= F.col("rank"))
             .groupBy("g", "p", "side").agg(F.min("x").alias("x"), F.first("share").alias("share")))
    low, high = F.min("x"), F.max("x")
    share = F.first("share")
    value = F.when(low == high, low).otherwise((F.lit(1.0) - share) * low + share * high)
    return found.groupBy("g", "p").agg(value.alias("value")).select(
        *[F.col(f"g.{c}").alias(c) for c in by], F.col("g.variable").alias("variable"), "p", "value")


def quantile_row(long: DataFrame, cols: list[str], probs, names) -> DataFrame:
    """One row ``{col}__{name}`` from the long result (nulls for empty columns)."""
    aggs = [F.max(F.when((F.col("variable") == c) & (F.col("p") == float(p)), F.col("value")))
            .alias(f"{c}__{n}") for c in cols for p, n in zip(probs, names)]
    return long.agg(*aggs)
