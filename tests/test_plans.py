"""The plans we want, not only the rows."""

import re

import pytest
from pyspark.sql import functions as F

from moodquarry.operators import ordering as O
from moodquarry.operators import prepare as P
from moodquarry.operators import scoring as S
from moodquarry.operators import stats as ST
from moodquarry.operators import tables as T
from moodquarry.operators.filters import time_range
from moodquarry.plans.lookup import lookup_column, lookup_join, small_copy
from moodquarry.plans.skew import hot_join, hot_keys
from moodquarry.plans.spread import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def test_scoring_neither_shuffles_nor_uses_python(docs, lexicons):
    text = plan(S.analyze_table(docs, None, "text", lexicons))
    assert not re.search(r"Exchange|Python|Arrow|Join", text)


def test_filters_and_columns_reach_the_scan(events):
    end = F.lit("2024-01-10").cast("timestamp_ntz")
    text = plan(time_range(events, "ts", F.lit("2024-01-05").cast("timestamp_ntz"), end).select("event_id"))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "props" not in text.split("ReadSchema")[1]


def test_top_rows_are_cut_before_the_shuffle(docs, events):
    text = plan(O.top_n_per_group(docs, "source", [F.desc("n_chars")], 3))
    assert text.count("WindowGroupLimit") == 2
    text = plan(T.dedup_key(events, ["user_id"], "event_id").select("event_id"))
    assert text.count("WindowGroupLimit") == 2 and "props" not in text.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan(O.recent(events, "ts", 10, "event_id"))


def test_distinct_users_are_counted_in_steps(events):
    posts = events.select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("sentiment"), "value",
        F.col("user_id").alias("author_id"), F.lit(0.5).alias("confidence"), F.lit("1").alias("retweet_count"), F.lit("1").alias("like_count"),
    )
    assert plan(ST.hourly_stats(posts)).count("HashAggregate") == 4


def test_lookup_size_decides_the_join(spark, frame):
    big, small = spark.range(1000).withColumnRenamed("id", "k"), frame("k bigint, v int", [(1, 2), (3, 4)])
    assert "BroadcastHashJoin" in plan(lookup_join(big, small, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(lookup_join(big, small, "k", max_rows=1))
        assert "BroadcastHashJoin" in plan(lookup_join(big, small, "k", max_rows=2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small_copy(small, 1) is None and lookup_column(small.selectExpr("string(k) k", "v"), "k", "v", 1) is None


def test_split_ranks_no_whole_class(spark, docs):
    """The final pass holds no window: rows are compared to the cut places."""
    df = docs.select("doc_id", "lang", "text")
    text = plan(P.stratified_split(df, "lang", "doc_id"))
    assert "Window" not in text and "Sort" not in text and "BroadcastHashJoin" in text


def test_spread_leaves_large_inputs_alone(spark, docs):
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many
    assert "Exchange" in plan(spread(docs))


def test_constant_lookup_finds_every_key(spark, frame):
    rows = [(f"key{i}", i) for i in range(5000)]
    find = lookup_column(frame("k string, v int", rows + [("key7", 99)]), "k", "v")
    df = frame("k string", [(k,) for k, _ in rows[:200]] + [("none",), (None,)])
    got = [r[0] for r in df.select(find(F.col("k"))).collect()]
    assert got == list(range(200)) + [None, None]


def test_hot_join_equals_the_plain_join(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 500).cast("bigint")
    left = spark.range(6000).select("id", key.alias("k"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left, "k", 100)
    assert [tuple(r) for r in hot.collect()] == [(7, 21)] and hot_keys(left, "k") is None
    want = sorted(map(str, left.join(right, "k", "left").select("id", "k", "v").collect()))
    for rows in (100, 10**6):
        assert sorted(map(str, hot_join(left, right, "k", rows).select("id", "k", "v").collect())) == want


def test_hot_join_parts_equal_rows(spark):
    left = spark.range(20_000).select(F.lit(7).cast("bigint").alias("k"), F.lit("same").alias("t"))
    right = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = hot_join(left, right, "k", 100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes) and out.where("v = 'x'").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_join_spreads_the_hot_key(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = hot_join(left, right, "k", 100).groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in out.collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
