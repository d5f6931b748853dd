"""Streams over the given tables, run to their end, next to the same result as SQL."""

from pyspark.sql import functions as F

from moodquarry.operators import rollup as R
from moodquarry.operators.tables import union_posts
from moodquarry.plans.scratch import children, new_folder
from moodquarry.queries import query
from moodquarry.queries.aggregates import LABEL_COUNTS, _LABELS
from moodquarry.queries.scoring import _both_sql, _emotion_parts, _sentiment_parts
from moodquarry.queries.tables import COMMON_WORDS, PARTS, STAND_IN_RULES, common_lexicons, lexicons, ntz, posts, posts_of, r6, sql, stream, table
from moodquarry.sinks.batches import Counts, make_batch_writer, parquet_sink, table_sink
from moodquarry.sources.messages import message_posts, read_message_stream
from moodquarry.sources.search_pages import PAGE_SCHEMA, flatten_search_pages
from moodquarry.streaming import control as C
from moodquarry.streaming import hourly as H
from moodquarry.streaming import posts as P


def _end(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


_TRENDS = """
    SELECT time_bucket(INTERVAL '5 minutes', created_at) AS window_start,
           time_bucket(INTERVAL '5 minutes', created_at) + INTERVAL '5 minutes' AS window_end, sentiment,
           count(*) AS tweet_count, round(avg(confidence), 6) AS avg_confidence
    FROM posts GROUP BY ALL"""


def _trend_rows(df):
    return df.select(ntz("window_start"), ntz("window_end"), "sentiment", "tweet_count", r6("avg_confidence"))


@query("trend_windows", sql("posts", _TRENDS))
def trend_windows(spark, sf):
    """The batch twin: all windows."""
    return _trend_rows(P.flatten_trends(P.trend_windows(posts(spark, sf))))


@query(
    "trend_stream",
    sql("posts", f"SELECT * FROM ({_TRENDS}) WHERE window_end <= (SELECT max(created_at) FROM posts) - INTERVAL '10 minutes'"),
)
def trend_stream(spark, sf):
    """The windows that a stream has closed."""
    root = new_folder(spark, "trends")
    rows = P.flatten_trends(P.trend_windows(posts_of(stream(spark, sf, "events"))))
    _end(C.start(rows, "trend_stream", make_batch_writer([table_sink(f"{root}/out")]), None, f"{root}/state"))
    return _trend_rows(spark.read.parquet(f"{root}/out").drop("query", "batch_id"))


@query("dedup_stream", sql("posts", "SELECT id, source, sentiment FROM posts"))
def dedup_stream(spark, sf):
    """Every post is delivered twice."""
    root = new_folder(spark, "dedup")
    one, two = (posts_of(stream(spark, sf, "events")) for _ in range(2))
    rows = P.dedup_stream(union_posts(one, two), ["tweet_id", "source"], delay="40 days")
    _end(C.start_files(rows.select("id", "source", "sentiment"), "dedup_stream", f"{root}/out", None, f"{root}/state"))
    return spark.read.parquet(f"{root}/out")


_STREAMED = _both_sql(
    """SELECT t.id, sentiment, compound AS compound_score, primary_emotion, round(emotion_confidence, 6) AS confidence
       FROM turns t JOIN sentiments s ON s.key = t.id JOIN emotions e ON e.key = t.id""",
    rel="turns", key="id", turns="SELECT conv_id || '.' || turn AS id, text FROM conversations",
)


def _turn_posts(df):
    key = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    return df.select(
        key.alias("tweet_id"), "text", F.col("role").alias("author_id"), F.timestamp_seconds("conv_id").alias("created_at"),
        F.lit(0).cast("bigint").alias("retweet_count"), F.lit(0).cast("bigint").alias("like_count"), F.lit("twitter").alias("source"),
    )


def _score_rows(df):
    return df.select(F.col("tweet_id").alias("id"), "sentiment", "compound_score", "primary_emotion", r6("confidence"))


@query("score_stream", _STREAMED)
def score_stream(spark, sf):
    """A lexicon of any size: each batch is scored as a table."""
    root = new_folder(spark, "scored")
    _end(C.start_fan_out(_turn_posts(stream(spark, sf, "conversations")), "score_stream", lexicons(spark, sf), root, None, f"{root}/state", rules=STAND_IN_RULES))
    return _score_rows(spark.read.parquet(f"{root}/scored"))


@query(
    "score_stream_in_row",
    sql(
        "",
        """SELECT t.id, sentiment, compound AS compound_score, primary_emotion, round(emotion_confidence, 6) AS confidence
           FROM turns t JOIN sentiments s ON s.key = t.id JOIN emotions e ON e.key = t.id""",
        lex0=COMMON_WORDS, lexicon=PARTS["lexicon"], emolex=PARTS["emolex"], turns="SELECT conv_id || '.' || turn AS id, text FROM conversations",
        **_sentiment_parts("turns", "id"), **_emotion_parts("turns", "id", words=False),
    ),
)
def score_stream_in_row(spark, sf):
    """A lexicon of common words, however many there are, is a constant of the stream itself, which keeps no state and moves no row."""
    root = new_folder(spark, "scored")
    scored = P.score_stream(_turn_posts(stream(spark, sf, "conversations")), common_lexicons(spark, sf), rules=STAND_IN_RULES, in_row=True)
    _end(C.start_files(scored, "score_stream_in_row", f"{root}/out", None, f"{root}/state", ["source"]))
    return _score_rows(spark.read.parquet(f"{root}/out"))


@query("fan_out", _STREAMED)
def fan_out(spark, sf):
    """Scored once per batch, into an archive and a second table that must agree."""
    root = new_folder(spark, "fan")
    _end(
        C.start_fan_out(
            _turn_posts(stream(spark, sf, "conversations")), "fan_out", lexicons(spark, sf), root, None, f"{root}/state",
            [table_sink(f"{root}/second")], rules=STAND_IN_RULES,
        )
    )
    first, second = (spark.read.parquet(f"{root}/{x}") for x in ("scored", "second"))
    return _score_rows(first.join(second.select("tweet_id"), "tweet_id", "left_semi"))


@query("fan_out_trends", sql("posts", f"SELECT * FROM ({_TRENDS}) WHERE window_end <= (SELECT max(created_at) FROM posts) - INTERVAL '10 minutes'"))
def fan_out_trends(spark, sf):
    """Trends from the archive of scored posts, as a stream of its own. The archive's batch is given twice."""
    root = new_folder(spark, "fan")
    archive = parquet_sink(f"{root}/scored", ["source", "date"])
    for _ in range(2):
        archive(posts(spark, sf), 0, "posts")
    _end(C.start_trends(spark, "fan_out_trends", root, None, f"{root}/state"))
    return _trend_rows(spark.read.parquet(f"{root}/trends"))


_MESSAGES = """
    SELECT CAST(event_id AS VARCHAR) AS tweet_id, props AS text, 'user_' || user_id AS author_id,
           CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS created_at, 'en' AS lang,
           coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE CAST(floor(value) AS BIGINT) END, -1) AS retweet_count,
           user_id AS like_count, '["' || event_type || '","k"]' AS hashtags FROM events"""


def _message_lines(spark, sf):
    e = table(spark, sf, "events")
    at = F.when(F.col("event_type") != "error", F.date_format(F.col("ts").cast("timestamp"), "E MMM dd HH:mm:ss Z yyyy"))
    count = F.when(F.col("event_type") == "click", "many").otherwise(F.floor("value").cast("string"))
    body = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("text"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"), at.alias("created_at"),
        F.lit("en").alias("lang"), count.alias("retweet_count"), F.col("user_id").cast("string").alias("favorite_count"),
        F.to_json(F.array("event_type", F.lit("k"))).alias("hashtags"),
    )
    return e.select(F.to_json(body).alias("value"))


def _message_rows(df):
    out = df.select("tweet_id", "text", "author_id", ntz("created_at"), "lang", "retweet_count", "like_count", "hashtags")
    return out.na.fill(-1, ["retweet_count"])


@query("read_message_stream", _MESSAGES)
def message_stream(spark, sf):
    root = new_folder(spark, "messages")
    _message_lines(spark, sf).write.text(f"{root}/in")
    rows = message_posts(read_message_stream(spark, "text", {"path": f"{root}/in"}))
    _end(C.start_files(rows, "read_message_stream", f"{root}/out", None, f"{root}/state"))
    return _message_rows(spark.read.parquet(f"{root}/out"))


def _flushed(spark, sf, name, rows=1000):
    """Two of three messages in four files, gathered by one buffer; ends once every message is flushed."""
    root = new_folder(spark, "collected")
    lines = _message_lines(spark, sf).where(F.get_json_object("value", "$.id").cast("bigint") % 3 > 0)
    lines.repartition(4).write.text(f"{root}/in")
    posts = message_posts(read_message_stream(spark, "text", {"path": f"{root}/in"}))
    expected = spark.read.text(f"{root}/in").count()
    started = C.start_flushes(posts, name, f"{root}/out", f"{root}/state", rows, 3, "1 second")
    try:
        landed, idle = 0, 0
        while landed < expected:
            started.awaitTermination(0.5)
            if started.exception():
                raise started.exception()
            there = any(c.startswith("query=") for c in children(spark, f"{root}/out"))
            before, landed = landed, spark.read.parquet(f"{root}/out").count() if there else 0
            # A batch may take as long as it needs; a stream that has nothing to do will flush no more.
            idle = 0 if landed > before or started.status["isDataAvailable"] else idle + 1
            if idle == 240:
                raise TimeoutError(f"{landed} of {expected} messages are flushed")
    finally:
        started.stop()
    return spark.read.parquet(f"{root}/out").where("ingest_date IS NOT NULL AND ingest_hour BETWEEN 0 AND 23")


@query("flush_micro_batches", f"SELECT * FROM ({_MESSAGES}) WHERE CAST(tweet_id AS BIGINT) % 3 > 0")
def flush_micro_batches(spark, sf):
    """Every message lands once, with all its columns."""
    return _message_rows(_flushed(spark, sf, "flush_micro_batches"))


@query(
    "flush_sizes",
    """SELECT i AS flush, least(700, n - 700 * i) AS flush_rows, CASE WHEN 700 * (i + 1) <= n THEN 'rows' ELSE 'time' END AS flush_cause,
              least(700, n - 700 * i) AS landed
       FROM (SELECT unnest(range(0, CAST(ceil(n / 700) AS BIGINT))) AS i, n FROM (SELECT count(*) AS n FROM events WHERE event_id % 3 > 0))""",
)
def flush_sizes(spark, sf):
    """Flushes of 700 messages, and one of the rest when its time is up."""
    flushed = _flushed(spark, sf, "flush_sizes", 700)
    return flushed.groupBy("flush", "flush_rows", "flush_cause").agg(F.count(F.lit(1)).alias("landed"))


_LATE = "id % 7 = 0"


def _three_batches(spark, sf, name, root, sink):
    """Posts in three files, each with rows of all hours, one batch a file; every batch is given twice, as after a failure."""
    rows = posts(spark, sf).where(f"NOT ({_LATE})").withColumn("file", F.col("id") % 3)
    for i in range(3):
        rows.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    stream_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def twice(df, batch_id, query):
        for _ in range(2):
            make_batch_writer([sink])(df, batch_id, query)

    _end(C.start(stream_, name, twice, None, f"{root}/state"))


_HOURS = f"""SELECT source, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket, count(*) AS total_count, {_LABELS},
                    round(avg(compound_score), 6) AS avg_compound_score, round(avg(confidence), 6) AS avg_confidence
             FROM posts GROUP BY 1, 2"""


@query("hourly_from_stream", sql("posts", _HOURS))
def hourly_from_stream(spark, sf):
    """Hours from the states of three batches, folded, and of late rows that come after the fold."""
    root = new_folder(spark, "hours")
    _three_batches(spark, sf, "hourly_from_stream", root, H.hourly_sink(f"{root}/hours"))
    H.fold_hours(spark, f"{root}/hours")
    H.hourly_sink(f"{root}/hours")(posts(spark, sf).where(_LATE), 0, "late")
    return R.source_hours(H.read_hours(spark, f"{root}/hours")).select(
        "source", ntz("hour_bucket"), "total_count", *LABEL_COUNTS, r6("avg_compound_score"), r6("avg_confidence")
    )


@query(
    "daily_from_sketches",
    sql(
        "posts",
        """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, sentiment, count(*) AS tweet_count, round(avg(confidence), 6) AS avg_confidence,
                  CAST(sum(retweet_count) AS BIGINT) AS total_retweets, CAST(sum(like_count) AS BIGINT) AS total_favorites,
                  count(DISTINCT author_id) AS exact_users, true AS within_error
           FROM posts GROUP BY 1, 2""",
    ),
)
def daily_from_sketches(spark, sf):
    """Days from the hours' states, without the posts; the estimate of users lies within four standard errors of the exact number."""
    days = R.spans(R.merge_states(R.hour_states(posts(spark, sf))))
    exact = posts(spark, sf).groupBy(F.date_trunc("day", "created_at").alias("day"), "sentiment").agg(F.count_distinct("author_id").alias("exact_users"))
    near = F.abs(F.col("unique_users") - F.col("exact_users")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 64 * F.col("exact_users"))
    return days.join(exact, ["day", "sentiment"]).select(
        ntz("day"), "sentiment", "tweet_count", r6("avg_confidence"), "total_retweets", "total_favorites", "exact_users", near.alias("within_error")
    )


@query(
    "stream_batch_counts",
    sql(
        "posts",
        """SELECT i AS batch_id, count(*) AS num_input_rows, count(*) FILTER (id % 3 = i AND created_at <= newest - INTERVAL '10 minutes') AS late_rows
           FROM (SELECT p.id, p.created_at, p.id % 3 AS i, (SELECT max(created_at) FROM posts q WHERE q.id % 3 < p.id % 3 - 1) AS newest FROM posts p)
           GROUP BY i""",
    ),
)
def stream_batch_counts(spark, sf):
    """Rows and late rows of each batch, noted beside the batches; each is written twice and noted once."""
    root = new_folder(spark, "counts")
    rows = posts(spark, sf).withColumn("file", F.col("id") % 3)
    writer = make_batch_writer([table_sink(f"{root}/out")], counts=Counts(f"{root}/counts"))
    for i in range(3):
        for _ in range(2):
            writer(rows.where(F.col("file") == i), i, "posts")
    return C.batch_counts(spark, f"{root}/counts", "posts").drop("query")


@query("start_all", sql("posts", "SELECT id, source, sentiment FROM posts UNION ALL SELECT id, 'again' AS source, sentiment FROM posts"))
def start_all(spark, sf):
    """Two streams with one writer keep all rows of both, also where one is begun again with a new checkpoint."""
    root = new_folder(spark, "all")
    writer = make_batch_writer([table_sink(f"{root}/out")])
    rows = posts_of(stream(spark, sf, "events")).select("id", "source", "sentiment")
    half = rows.where("id % 2 = 0")
    for streams, state in (({"first": half, "second": rows.withColumn("source", F.lit("again")), "none": None}, "a"), ({"first": rows.where("id % 2 <> 0")}, "b")):
        for q in C.start_all(streams, writer, None, f"{root}/{state}").values():
            _end(q)
    return spark.read.parquet(f"{root}/out").select("id", "source", "sentiment")


@query(
    "search_page_stream",
    "SELECT CAST(event_id AS VARCHAR) AS id, CAST(floor(value) AS BIGINT) AS retweets, user_id % 10 <> 0 AND user_id % 3 = 0 AS verified FROM events",
)
def search_page_stream(spark, sf):
    from moodquarry.queries.sources import _pages

    root = new_folder(spark, "pages")
    _pages(spark, sf).write.json(f"{root}/in")
    rows = flatten_search_pages(spark.readStream.schema(PAGE_SCHEMA).json(f"{root}/in"))
    _end(C.start_files(rows, "search_page_stream", f"{root}/out", None, f"{root}/state"))
    return spark.read.parquet(f"{root}/out").select("id", "retweets", "verified")


@query("land_search_pages", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source FROM events")
def land_search_pages(spark, sf):
    """Rows of search pages, landed in folders of the date and hour of arrival."""
    from moodquarry.queries.sources import _pages

    root = new_folder(spark, "landed")
    _pages(spark, sf).write.json(f"{root}/in")
    rows = flatten_search_pages(spark.readStream.schema(PAGE_SCHEMA).json(f"{root}/in"))
    _end(C.start_collector(rows, "land_search_pages", f"{root}/out", f"{root}/state", None))
    return spark.read.parquet(f"{root}/out").where("ingest_date IS NOT NULL AND ingest_hour BETWEEN 0 AND 23").select("id", "source")
