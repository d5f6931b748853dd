import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from moodquarry.operators import rollup as R
from moodquarry.operators.stats import hourly_source_stats
from moodquarry.operators.tables import union_posts
from moodquarry.sinks.batches import Counts, make_batch_writer, parquet_sink, table_sink
from moodquarry.sources.messages import message_posts, read_message_stream
from moodquarry.sources.schemas import POST
from moodquarry.streaming import control as C
from moodquarry.streaming import hourly as H
from moodquarry.streaming import posts as P

T0 = datetime.datetime(2025, 1, 1, 10, 0)
FIELDS = "tweet_id string, source string, created_at timestamp, sentiment string, confidence double"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def feed(spark, folder, files, schema=FIELDS):
    """One Parquet file per list of rows, read one file per trigger in order."""
    done = set()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for path in set(folder.glob("*.parquet")) - done:
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
            done.add(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_trends_close_and_drop_late_rows(spark, tmp_path):
    files = [
        [("1", "a", at(0), "positive", 0.5), ("2", "a", at(1), "positive", 0.7), ("3", "a", at(2), "negative", 0.2)],
        [("4", "a", at(30), "positive", 0.9)],
        # A watermark drops rows from the batch after the next one on.
        [("7", "a", at(31), "positive", 0.7)],
        [("5", "a", at(1), "positive", 0.1), ("6", "a", at(60), "neutral", 0.4)],
    ]
    rows = P.flatten_trends(P.trend_windows(feed(spark, tmp_path / "in", files)))
    query = run(C.start(rows, "trends", make_batch_writer([table_sink(str(tmp_path / "out"))]), None, str(tmp_path / "state")))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.window_start, r.sentiment): (r.tweet_count, round(r.avg_confidence, 6)) for r in out}
    assert got == {(at(0), "positive"): (2, 0.6), (at(0), "negative"): (1, 0.2), (at(30), "positive"): (2, 0.8)}
    assert C.late_rows(query) == 1


def test_dedup_within_the_delay(spark, tmp_path):
    files = [
        [("1", "a", at(0), "positive", 0.5), ("1", "a", at(0), "positive", 0.5), ("1", "b", at(0), "positive", 0.5)],
        [("1", "a", at(0), "positive", 0.5), ("2", "a", at(0), "positive", 0.5)],
    ]
    rows = P.dedup_stream(feed(spark, tmp_path / "in", files), ["tweet_id", "source"], delay="5 minutes")
    run(C.start_files(rows, "dedup", str(tmp_path / "out"), None, str(tmp_path / "state")))
    got = sorted((r.tweet_id, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("1", "a"), ("1", "b"), ("2", "a")]


def post_rows(texts):
    return [(str(i), t, "u", at(i), 1, 2) for i, t in enumerate(texts)]


def test_scored_stream_equals_batch_and_resumes(spark, tmp_path, lexicons):
    texts = ["I love it", "not good", "", "HATE this thing", "plain"]
    schema = POST.simpleString()
    posts = spark.createDataFrame(post_rows(texts), POST).withColumn("source", F.lit("twitter"))
    want = sorted(map(tuple, P.score_stream(posts, lexicons).collect()))

    def once():
        stream = spark.readStream.schema(POST).parquet(str(tmp_path / "in")).withColumn("source", F.lit("twitter"))
        return run(C.start_fan_out(stream, "scored", lexicons, str(tmp_path / "root"), None, str(tmp_path / "state")))

    columns = P.score_stream(posts, lexicons).columns
    read = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "root" / "scored")).select(*columns).collect()))
    spark.createDataFrame(post_rows(texts)[:3], POST).coalesce(1).write.parquet(str(tmp_path / "in"))
    once()
    spark.createDataFrame(post_rows(texts)[3:], POST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once()
    once()
    assert read() == want and schema


def test_failed_sink_repeats_the_batch_without_copies(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[("1", "a", at(0), "positive", 0.5)]])
    state = {"down": True}

    def shaky(df, batch_id, query):
        if state["down"]:
            raise RuntimeError("sink is down")

    writer = make_batch_writer([parquet_sink(str(tmp_path / "out")), shaky])
    with pytest.raises(Exception):
        C.start(stream, "shaky", writer, None, str(tmp_path / "state")).awaitTermination()
    state["down"] = False
    run(C.start(stream, "shaky", writer, None, str(tmp_path / "state")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_message_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = {"id": "1", "text": "hi", "created_at": "Mon Dec 01 10:00:00 +0000 2025", "retweet_count": "3"}
    (tmp_path / "in" / "a.json").write_text(json.dumps(body) + "\nbroken\n")
    rows = message_posts(read_message_stream(spark, "text", {"path": str(tmp_path / "in")}))
    run(C.start_collector(rows, "collect", str(tmp_path / "out"), str(tmp_path / "state"), None))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("tweet_id = '1'").first().retweet_count == 3 and out.count() == 2
    assert {"ingest_date", "ingest_hour", "batch_id"} <= set(out.columns)


def test_start_status_stop(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    got = C.start_all({"one": rate, "none": None}, lambda df, i, query: None, "1 second", str(tmp_path))
    assert list(got) == ["one"]
    assert C.status(spark, "one")["is_active"] and "error" in C.status(spark, "other")
    spark.streams.resetTerminated()  # of earlier tests
    assert C.wait(spark, "one", 0.5) is False and C.wait(spark, "one", 0) is False and C.wait(spark, timeout=0) is False
    assert C.stop(spark, "other") is False
    assert C.stop_all(spark) == ["one"] and not got["one"].isActive


def test_console_and_counts(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[("1", "a", at(0), "positive", 0.5)], [("2", "a", at(0), "positive", 0.5)] * 3])
    query = run(C.start_console(stream, "console", None, str(tmp_path / "state"), ["tweet_id", "sentiment"]))
    assert sorted(p["numInputRows"] for p in query.recentProgress if p["numInputRows"]) == [1, 3]


def test_counts_outlive_a_restart(spark, tmp_path):
    """Rows and late rows of all batches, though the stream is started anew and a batch fails between its sinks and its note."""
    files = [
        [("1", "a", at(0), "positive", 0.5), ("2", "a", at(1), "positive", 0.5)],
        [("3", "a", at(30), "positive", 0.5)],
        [("4", "a", at(19), "positive", 0.5), ("5", "a", at(21), "positive", 0.5), ("6", "a", None, "positive", 0.5)],
        [("7", "a", at(2), "positive", 0.5)] * 4,
    ]
    counts = Counts(str(tmp_path / "counts"), "created_at", "10 minutes")
    writer = make_batch_writer([table_sink(str(tmp_path / "out"))], counts=counts)
    state = {"left": 2}

    def breaks(df, batch_id, query):
        if not state["left"]:
            raise RuntimeError("the driver is gone")
        state["left"] -= 1
        writer(df, batch_id, query)

    stream = feed(spark, tmp_path / "in", files)
    with pytest.raises(Exception):
        C.start(stream, "counted", breaks, None, str(tmp_path / "state")).awaitTermination()
    state["left"] = 9
    query = run(C.start(stream, "counted", breaks, None, str(tmp_path / "state")))
    again = make_batch_writer([], counts=counts)
    again(spark.createDataFrame([("8", "a", at(0), "positive", 0.5)], FIELDS), 1, f"counted.{query.id}")  # noted already
    got = C.batch_counts(spark, str(tmp_path / "counts"), "counted").orderBy("batch_id").collect()
    assert [(r.batch_id, r.num_input_rows, r.late_rows) for r in got] == [(0, 2, 0), (1, 1, 0), (2, 3, 0), (3, 4, 4)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_noted_late_rows_are_those_that_spark_drops(spark, tmp_path):
    files = [[("1", "a", at(0), "p", 0.5)], [("2", "a", at(30), "p", 0.5)], [("3", "a", at(14), "p", 0.5), ("4", "a", at(16), "p", 0.5), ("5", "a", at(21), "p", 0.5)],
             [("6", "a", at(1), "p", 0.5)] * 3]
    stream = feed(spark, tmp_path / "in", files)
    counts = Counts(str(tmp_path / "counts"), "created_at", P.TREND_DELAY, P.TREND_WIDTH)
    run(C.start(stream, "noted", make_batch_writer([], counts=counts), None, str(tmp_path / "state")))
    dropped = run(C.start(P.flatten_trends(P.trend_windows(stream)), "dropping", make_batch_writer([]), None, str(tmp_path / "state")))
    noted = C.batch_counts(spark, str(tmp_path / "counts"), "noted").agg(F.sum("late_rows")).first()[0]
    # Spark counts what it drops after partial aggregation: one row for each window and label of a batch.
    assert noted == 3 and C.late_rows(dropped) == 1


def wait_for(test, query, seconds=90):
    for _ in range(seconds * 4):
        if query.exception():
            raise query.exception()
        if test():
            return
        time.sleep(0.25)
    raise TimeoutError


def flushes(spark, path):
    there = path.exists() and any(c.name.startswith("query=") for c in path.iterdir())
    rows = spark.read.parquet(str(path)).groupBy("buffer", "flush", "flush_rows", "flush_cause").count().collect() if there else []
    return sorted((r.buffer, r.flush, r.flush_rows, r["count"], r.flush_cause) for r in rows)


def test_flush_by_rows_or_by_time(spark, tmp_path):
    """2,500 messages in one file land as flushes of 1000 and 1000, and of 500 when the time is up."""
    fields = "id string, n bigint, at timestamp"
    big = 1 << 60
    rows = spark.range(2500).selectExpr("cast(id AS string) AS id", f"if(id % 3 = 0, null, id + {big}) AS n", "timestamp_seconds(id) AS at")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
    query = C.start_flushes(stream, "flush", str(tmp_path / "out"), str(tmp_path / "state"), 1000, 8, "500 milliseconds")
    try:
        wait_for(lambda: len(flushes(spark, tmp_path / "out")) >= 2, query)
        assert [f[:4] for f in flushes(spark, tmp_path / "out")][:2] == [(0, 0, 1000, 1000), (0, 1, 1000, 1000)]
        wait_for(lambda: len(flushes(spark, tmp_path / "out")) == 3, query)
    finally:
        query.stop()
    assert flushes(spark, tmp_path / "out")[2] == (0, 2, 500, 500, "time")
    out = spark.read.parquet(str(tmp_path / "out")).select("id", "n", "at")
    assert out.exceptAll(rows).count() == 0 and out.count() == 2500


def test_what_is_held_outlives_a_restart(spark, tmp_path):
    fields = "id string"
    source = tmp_path / "in"

    def go(seconds):
        stream = spark.readStream.schema(fields).parquet(str(source))
        buffer = F.col("id").cast("int") % 2
        return C.start_flushes(stream, "held", str(tmp_path / "out"), str(tmp_path / "state"), 10, seconds, "500 milliseconds", buffer)

    spark.range(14).selectExpr("cast(id AS string) AS id").coalesce(1).write.parquet(str(source))
    query = go(600)
    wait_for(lambda: sum(p["numInputRows"] for p in query.recentProgress) == 14, query)
    query.stop()
    assert flushes(spark, tmp_path / "out") == []
    spark.range(14, 22).selectExpr("cast(id AS string) AS id").coalesce(1).write.mode("append").parquet(str(source))
    query = go(600)
    wait_for(lambda: len(flushes(spark, tmp_path / "out")) == 2, query)
    query.stop()
    assert flushes(spark, tmp_path / "out") == [(0, 0, 10, 10, "rows"), (1, 0, 10, 10, "rows")]
    assert {int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(range(20))


def test_hours_fold_and_count_late_and_repeated_batches_once(spark, tmp_path):
    fields = "source string, created_at timestamp, sentiment string, primary_emotion string, confidence double, author_id string"
    root = str(tmp_path / "hours")
    batches = [
        [("a", at(0), "positive", "joy", 0.5, "u1"), ("a", at(70), "negative", None, 0.25, "u2"), (None, at(5), "neutral", "unknown", None, "u1")],
        [("a", at(75), "positive", "joy", 0.75, "u1"), ("b", at(1), "positive", "fear", 0.5, None)],
        [("a", at(1), "positive", "unknown", 1.0, "u3")],  # an hour that was folded
    ]
    frames = [spark.createDataFrame(rows, fields) for rows in batches]
    sink = H.hourly_sink(root)

    def plain(df):
        return sorted(((r.source, r.hour_bucket, r.total_count, r.positive_count, r.avg_confidence, sorted(r.emotion_counts.items())) for r in df.collect()), key=str)

    def expected(n):
        return plain(hourly_source_stats(union_posts(*[f.withColumn("compound_score", F.lit(0.0)) for f in frames[:n]])))

    def actual():
        return plain(R.source_hours(H.read_hours(spark, root)))

    sink(frames[0], 0, "q.1")
    sink(frames[0], 0, "q.1")
    assert actual() == expected(1)
    assert H.fold_hours(spark, root) == 0 and actual() == expected(1)
    sink(frames[0], 0, "q.1")  # a repeat after the fold
    sink(frames[1], 1, "q.1")
    assert actual() == expected(2)
    assert H.fold_hours(spark, root) == 1 and actual() == expected(2)
    assert not (tmp_path / "hours" / "parts" / "query=q.1" / "batch_id=0").exists()
    sink(frames[0], 0, "q.1")  # a repeat whose part was removed
    sink(frames[2], 2, "q.1")
    assert actual() == expected(3)
    assert H.fold_hours(spark, root) == 2 and H.fold_hours(spark, root) == 3 and actual() == expected(3)
    days = {(r.day.hour, r.sentiment): (r.tweet_count, r.unique_users) for r in R.spans(H.read_hours(spark, root)).collect()}
    assert days == {(0, "positive"): (4, 2), (0, "negative"): (1, 1), (0, "neutral"): (1, 1)}


def test_user_sketches_within_their_error(spark):
    posts = spark.range(200_000).selectExpr(
        "'a' AS source", "timestamp_seconds(id % 86400) AS created_at", "'neutral' AS sentiment", "cast(id % 50000 AS string) AS author_id"
    )
    day = R.spans(R.merge_states(R.hour_states(posts))).first()
    assert day.tweet_count == 200_000 and abs(day.unique_users - 50_000) < 4 * 0.0163 * 50_000


def test_a_batch_is_whole_without_success_marks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", at(0), "positive", 0.5)], FIELDS)
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        for _ in range(3):
            parquet_sink(str(tmp_path / "out"))(rows, 0, "q")
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    files = {f.name for f in (tmp_path / "out").rglob("*.parquet")}
    parquet_sink(str(tmp_path / "out"))(rows, 0, "q")
    assert files == {f.name for f in (tmp_path / "out").rglob("*.parquet")} and len(files) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_trends_start_before_the_first_batch(spark, tmp_path):
    query = C.start_trends(spark, "early", str(tmp_path), "1 second", str(tmp_path / "state"))
    try:
        parquet_sink(str(tmp_path / "scored"))(spark.createDataFrame([("1", "a", at(0), "positive", 0.5)], FIELDS), 0, "posts")
        parquet_sink(str(tmp_path / "scored"))(spark.createDataFrame([("2", "a", at(60), "positive", 0.5)], FIELDS), 1, "posts")
        wait_for(lambda: any((tmp_path / "trends").glob("query=*")), query)
    finally:
        query.stop()
    assert [r.tweet_count for r in spark.read.parquet(str(tmp_path / "trends")).collect()] == [1]


def test_streams_with_one_writer_keep_their_rows(spark, tmp_path):
    one = feed(spark, tmp_path / "one", [[("1", "a", at(0), "positive", 0.5)] * 5])
    two = feed(spark, tmp_path / "two", [[("2", "b", at(0), "positive", 0.5)] * 5])
    writer = make_batch_writer([table_sink(str(tmp_path / "out"))])
    for state in ("first", "anew"):  # a new checkpoint reads all again and takes nothing away
        for query in C.start_all({"one": one, "two": two}, writer, None, str(tmp_path / state)).values():
            run(query)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.source, r["count"]) for r in got.groupBy("source").count().collect()} == {("a", 10), ("b", 10)}


def test_a_repeated_batch_is_no_new_trend(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", at(0), "positive", 0.5), ("2", "a", at(1), "positive", 0.5)], FIELDS)
    last = spark.createDataFrame([("3", "a", at(60), "positive", 0.5)], FIELDS)
    archive = parquet_sink(str(tmp_path / "scored"))
    archive(rows, 0, "posts")
    run(C.start_trends(spark, "trends_once", str(tmp_path), None, str(tmp_path / "state")))
    archive(rows, 0, "posts")
    archive(last, 1, "posts")
    run(C.start_trends(spark, "trends_once", str(tmp_path), None, str(tmp_path / "state")))
    assert [r.tweet_count for r in spark.read.parquet(str(tmp_path / "trends")).collect()] == [2]
