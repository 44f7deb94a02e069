"""Token counts and busiest-hour buckets over a stream.

The batch operators become incremental aggregations: one state row per token or
hour. ``run_available_now`` drains what is there and stops, writing each
micro-batch's result to a shared folder; given the same folder again, it resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.session import scratch_path


def stream_table(spark: SparkSession, path: str, like: DataFrame,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over Parquet at ``path`` (a folder or a glob) with the
    schema of ``like``."""
    r = spark.readStream.schema(like.schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def log_stream(spark: SparkSession, folder: str, timestamped: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a comma-split text log folder as a stream, with the
    declared all-string schema (no inference, no quoting), like the batch
    scan."""
    from quarry.schemas import WEBLOG, WEBLOG_TM
    r = (spark.readStream.schema(WEBLOG_TM if timestamped else WEBLOG)
         .option("sep", ",").option("quote", "").option("escape", "").option("header", "false"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.csv(folder)


def token_counts(stream: DataFrame, token: str) -> DataFrame:
    """Running count per token (non-null values counted, as in batch)."""
    return stream.groupBy(F.col(token).alias("token")).agg(F.count(token).alias("count"))


def hour_counts(stream: DataFrame, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Events per hour bucket, every event counted however late it comes; state is one
    row per hour. Naming a ``watermark`` is a choice to drop what is older than it
    (latest event time seen minus ``watermark``), and with it to forget closed hours."""
    t = F.col(ts)
    hour = F.date_trunc("hour", t).cast("timestamp_ntz").alias("window_start")
    if watermark is None:
        return stream.groupBy(hour).agg(F.count(F.lit(1)).alias("count"))
    # Event time must carry a zone: read the zone-less clock as UTC, so hour
    # windows follow the clock whatever the session time zone is. The
    # zone-less hour itself is carried as the output key.
    event = F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t),
                             F.second(t), F.lit("UTC"))
    return (stream.select(event.alias("_event"), hour).withWatermark("_event", watermark)
            .groupBy(F.window("_event", "1 hour"), "window_start")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("window_start", "count"))


def run_available_now(spark: SparkSession, agg: DataFrame, mode: str = "update",
                      name: str = "stream", state: str | None = None) -> DataFrame:
    """Run the aggregation over everything available and return the result.

    ``state`` is a shared folder for the stream's checkpoint and output: a later
    call with the same folder goes on where the last one stopped. Without it each
    call starts from the first file.

    ``update`` mode: each micro-batch upserts its changed rows by appending
    them with the batch id; the latest version per key is the answer (a
    window over the written table picks it). ``complete``: the last batch's
    full result is the answer.
    """
    root = state or scratch_path(spark, name)
    out, ckpt = f"{root}/out", f"{root}/checkpoint"

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id))
         .write.mode("overwrite" if mode == "complete" else "append").parquet(out))

    q = (agg.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    if mode == "complete":
        return res.drop("_batch")
    keys = [c for c in agg.columns if c != "count"]
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return (res.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .drop("_rn", "_batch"))
