import os

from pyspark.sql import functions as F

from quarry.operators import tokens as tk
from quarry.streaming import hour_counts, log_stream, run_available_now, stream_table, token_counts


def test_multi_batch_log_stream_equals_batch(spark, tmp_dir):
    rows = [(f"u{i % 4}", f"q{i % 3}", "ff", "linux", "r") for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, search_query string, browser string, "
                                     "os string, referrer string").repartition(4)
    folder = os.path.join(tmp_dir, "log")
    df.write.option("sep", ",").csv(folder)
    got = run_available_now(spark, token_counts(log_stream(spark, folder, max_files_per_trigger=1),
                                                "user_id"), "update", "t1")
    want = tk.count_tokens(tk.select_token(df, "user_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_multi_batch_hour_counts(spark, tmp_dir):
    ev = spark.createDataFrame(
        [(i, f"2024-01-01 {h:02d}:{m:02d}:00") for i, (h, m) in
         enumerate([(0, 5), (0, 55), (1, 10), (3, 0), (3, 1), (3, 59)])], "id long, t string"
    ).select("id", F.to_timestamp_ntz("t").alias("ts")).repartition(3)
    folder = os.path.join(tmp_dir, "ev")
    ev.write.parquet(folder)
    s = stream_table(spark, folder, ev, max_files_per_trigger=1)
    # files arrive in any order; a watermark covering the data's lateness keeps
    # every event (with "1 hour", an 01:10 event read after 03:59 is dropped)
    got = {r.window_start.hour: r["count"] for r in
           run_available_now(spark, hour_counts(s, "ts", "1 day"), "update", "h1").collect()}
    assert got == {0: 2, 1: 1, 3: 3}


def test_hour_counts_independent_of_session_zone(spark, tmp_dir):
    ev = spark.createDataFrame([(1, "2024-01-01 10:20:00"), (2, "2024-01-01 10:40:00"),
                                (3, "2024-01-01 11:05:00")], "id long, t string") \
        .select("id", F.to_timestamp_ntz("t").alias("ts"))
    folder = os.path.join(tmp_dir, "evz")
    ev.write.parquet(folder)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # +05:30
    try:
        s = stream_table(spark, folder, ev)
        got = {(r.window_start.hour, r.window_start.minute): r["count"] for r in
               run_available_now(spark, hour_counts(s, "ts", "1 hour"), "update", "hz").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {(10, 0): 2, (11, 0): 1}


def test_hours_of_late_files_are_counted(spark, tmp_dir):
    for i, day in enumerate((20, 10, 1)):
        spark.sql(f"SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-{day:02d} 10:30:00' AS ts FROM range(5)").coalesce(1) \
            .write.parquet(f"{tmp_dir}/d{i}")
    like = spark.read.parquet(f"{tmp_dir}/d0")
    s = stream_table(spark, f"{tmp_dir}/d*", like, max_files_per_trigger=1)
    rows = run_available_now(spark, hour_counts(s), "update", "late", state=f"{tmp_dir}/state").collect()
    assert sorted(r["count"] for r in rows) == [5, 5, 5]
