"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back:
    the lineage ends there, so a lost executor costs no more than its own tasks,
    and a frame whose rows depend on the partitioning is computed only once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
