import os

from pyspark.sql import functions as F

from quarry.operators import tokens as tk
from quarry.sources.delimited import read_weblog, read_weblog_tm
from quarry.sources.sinks import store_delimited


def test_null_token_counts_zero(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "token string")
    got = {r["token"]: r["count"] for r in tk.count_tokens(df).collect()}
    assert got == {"a": 2, "b": 1, None: 0}


def test_arg_max_keeps_all_ties(spark):
    df = spark.createDataFrame([(x,) for x in "aabbc"], "t string")
    got = sorted((r.token, r["count"], r.max_count) for r in tk.busiest(df, "t").collect())
    assert got == [("a", 2, 2), ("b", 2, 2)]


def test_arg_max_empty_input(spark):
    df = spark.createDataFrame([], "t string")
    assert tk.busiest(df, "t").count() == 0


def test_top_k_tie_break_is_token(spark):
    df = spark.createDataFrame([(x,) for x in "zzyyxxw"], "t string")
    got = [(r.token, r["count"]) for r in tk.token_frequencies(df, "t", k=2).collect()]
    assert got == [("x", 2), ("y", 2)]


def test_pair_token_null_part_is_null(spark):
    df = spark.createDataFrame([("ff", "linux"), ("ff", None), ("ff", "linux")], "b string, o string")
    got = {r.token: r["count"] for r in tk.count_tokens(tk.select_token(df, tk.pair_token("b", "o"))).collect()}
    assert got == {"ff:linux": 2, None: 0}


def test_largest_tally_counts_non_null(spark):
    df = spark.createDataFrame([("ff", "a"), ("ff", None), ("ch", "a"), ("ch", "b")],
                               "browser string, os string")
    got = [(r.browser, r.os_count) for r in tk.largest_tally(df).collect()]
    assert got == [("ch", 2)]


def test_plain_comma_scan_semantics(spark, tmp_dir):
    p = os.path.join(tmp_dir, "log.csv")
    with open(p, "w") as f:
        f.write("u1,q1,ff,linux,r1\n")          # normal
        f.write("u2,q2\n")                      # short row -> nulls
        f.write("u3,q3,ch,mac,r3,extra,more\n")  # extra fields dropped
        f.write('u4,"a,b",ff,win,r4\n')          # quotes are plain text
        f.write("u5,,ff,,r5\n")                  # empty fields -> null
    rows = {r.user_id: r for r in read_weblog(spark, p).collect()}
    assert rows["u2"].browser is None and rows["u2"].referrer is None
    assert rows["u3"].referrer == "r3"
    assert rows["u4"].search_query == '"a' and rows["u4"].browser == 'b"'
    assert rows["u5"].search_query is None and rows["u5"].os is None


def test_header_and_malformed_timestamp(spark, tmp_dir):
    p = os.path.join(tmp_dir, "tm.csv")
    with open(p, "w") as f:
        f.write("timestamp,user_id,search_query,browser,os,referrer\n")
        f.write("2024-01-01 10:15:00,u1,q,ff,linux,r\n")
        f.write("2024-01-01 10:45:00,u2,q,ff,linux,r\n")
        f.write("2024-01-01 11:00:00,u3,q,ff,linux,r\n")
        f.write("not a time,u4,q,ff,linux,r\n")
        f.write(",u5,q,ff,linux,r\n")
    log = read_weblog_tm(spark, p)
    assert tk.drop_header(log).count() == 4   # header gone, null timestamp gone too
    got = [tuple(r) for r in tk.busiest_hour(log).collect()]
    assert got == [(2024, 1, 1, 10, 2, 2)]


def test_date_part_tokens_pool(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00",), ("2024-02-01 03:00:00",)], "timestamp string")
    got = [(r.token, r["count"]) for r in tk.busiest_date_part(df).collect()]
    assert got == [("1", 4)]  # month 1, day 1 twice, hour 1


def test_tokenize_default_delimiters(spark):
    df = spark.createDataFrame([('a b,"c"(d)*e  f',), (None,)], "s string")
    got = sorted(r.token for r in tk.text_tokens(df, "s", with_counts=False).collect())
    assert got == list("abcdef")


def test_store_fails_if_exists(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1)], "token string, count long")
    p = os.path.join(tmp_dir, "out")
    store_delimited(df, p)
    lines = "".join(open(os.path.join(p, f)).read() for f in sorted(os.listdir(p))
                    if f.startswith("part-"))
    assert lines == "a\t1\n"
    try:
        store_delimited(df, p)
        raise AssertionError("expected failure")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)


def test_strip_spaces(spark):
    df = spark.createDataFrame([("a b  c",)], "q string")
    assert tk.remove_spaces(df, "q").first().q == "abc"
