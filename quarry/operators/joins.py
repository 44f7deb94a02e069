"""A many-to-one equi-join that stays balanced when a few keys hold a large
share of the many side.

1. One count per key (partial counts first, so a hot key collapses map-side)
   finds the keys with more rows than a partition's share ``N / P``; there are
   fewer than ``P`` of them, whatever the data. Without any, it is a plain join.
2. All other rows join as usual.
3. Rows of hot keys are collapsed to distinct rows with a number of copies, and
   joined on ``(key, salt)`` with ``ceil(n_k * P / N)`` salts, for which the one
   side repeats that key's rows; copies are expanded after the join.

The salt is a hash of the row's content, so a re-run task gives every row the
same salt whatever order it reads its input in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hot_key_salts(df: DataFrame, key: str, partitions: int | None = None) -> list[tuple]:
    """``(key, salts)`` of the keys with more than ``rows / partitions`` rows: fewer than
    ``partitions`` pairs. Null keys are not hot (they join nothing)."""
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).select("t").scalar()
    rows = (counts.filter(F.col(key).isNotNull() & (F.col("_n") * p > total))
            .select(key, F.ceil(F.col("_n") * p / total).cast("int").alias("s")).collect())
    return sorted((r[0], r[1]) for r in rows)


def skew_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner",
              partitions: int | None = None, seed: int = 17) -> DataFrame:
    """``many JOIN one USING (key)`` (``how`` in inner / left), with hot keys
    of ``many`` salted in proportion to their share. ``one`` should have few
    rows per key (a key column)."""
    if how not in ("inner", "left"):
        raise ValueError("skew_join supports inner and left joins")
    hot = hot_key_salts(many, key, partitions)
    if not hot:
        return many.join(one, key, how)
    spark, cols = many.sparkSession, many.columns
    salts = F.broadcast(spark.createDataFrame(hot, f"`{key}` {many.schema[key].dataType.simpleString()}, _salts int"))
    cold = many.join(salts, key, "left_anti").join(one, key, how)
    content = F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))
    m = (many.join(salts, key).groupBy(*cols, "_salts").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
         .withColumn("_salt", F.pmod(content, F.col("_salts").cast("long")).cast("int")).drop("_salts"))
    o = (one.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
         .drop("_salts"))
    spread = (m.join(o, [key, "_salt"], how)
              .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
    return cold.unionByName(spread.select(*cold.columns))
