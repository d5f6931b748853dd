"""Text, time, label and record expressions."""

from pyspark.sql import functions as F

from moodquarry.functions import labels as L
from moodquarry.functions import records as R
from moodquarry.functions import text as X
from moodquarry.functions import times as TM
from moodquarry.operators import prepare as P
from moodquarry.queries import query
from moodquarry.queries.tables import (
    WORD, analyses, ntz, posts, sql, sql_clean, sql_label, sql_tokens_text, table, texts,
)
from moodquarry.sources.messages import parse_hashtags


@query("clean_text", sql("texts", f"SELECT key, {sql_clean('text', cut=False)} AS clean FROM texts"))
def clean_text(spark, sf):
    return texts(spark, sf).select("key", X.clean_text("text").alias("clean"))


@query("clean_text_cut", sql("texts", f"SELECT key, {sql_clean('text')} AS clean FROM texts"))
def clean_text_cut(spark, sf):
    """The cut is the feature here."""
    return texts(spark, sf).select("key", X.clean_text("text", X.MAX_CLEAN_LENGTH).alias("clean"))


@query("clean_text_keep_gap", sql("texts", f"SELECT key, {sql_clean('text', ' ', False)} AS clean FROM texts"))
def clean_text_keep_gap(spark, sf):
    return texts(spark, sf).select("key", X.clean_text_keep_gap("text").alias("clean"))


@query("clean_for_tokens", sql("texts", f"SELECT key, {sql_tokens_text('text')} AS clean FROM texts"))
def clean_for_tokens(spark, sf):
    return texts(spark, sf).select("key", X.clean_for_tokens("text").alias("clean"))


@query(
    "compound_to_label",
    sql("posts", f"SELECT id, compound_score, {sql_label('compound_score')} AS sentiment FROM posts"),
)
def compound_to_label(spark, sf):
    return posts(spark, sf).select("id", "compound_score", L.compound_to_label(F.col("compound_score")).alias("sentiment"))


@query("text_hash", sql("texts", "SELECT key, md5(text) AS md5, sha256(text) AS sha256 FROM texts"))
def text_hash(spark, sf):
    return texts(spark, sf).select("key", X.text_hash("text").alias("md5"), X.text_hash("text", "sha256").alias("sha256"))


@query(
    "cache_key", sql("texts", f"SELECT key, 'sentiment:full:' || md5({sql_clean('text', cut=False)}) AS cache_key FROM texts")
)
def cache_key(spark, sf):
    return texts(spark, sf).select("key", X.cache_key(X.clean_text("text"), "full").alias("cache_key"))


@query(
    "text_stats",
    sql(
        "texts",
        rf"""SELECT key, CAST(length(text) AS INT) AS text_length,
                    CAST(len(regexp_extract_all(text, '{WORD}')) AS INT) AS word_count FROM texts""",
    ),
)
def text_stats(spark, sf):
    return texts(spark, sf).select(
        "key", X.text_length("text").alias("text_length"), X.word_count("text").alias("word_count")
    )


def _sql_preview(n):
    return f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END"


@query(
    "preview", sql("texts", f"SELECT key, {_sql_preview(200)} AS result_view, {_sql_preview(100)} AS post_view FROM texts")
)
def preview(spark, sf):
    return texts(spark, sf).select(
        "key", X.preview("text", 200).alias("result_view"), X.preview("text", 100).alias("post_view")
    )


@query(
    "body_or_title",
    """SELECT page_id, CASE WHEN page_id % 3 = 0
                            THEN url ELSE html END AS body FROM pages""",
)
def body_or_title(spark, sf):
    # A third of the pages count as posts without a body.
    p = table(spark, sf, "pages").withColumn("body", F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("html")))
    return p.select("page_id", X.body_or_title("body", "url").alias("body"))


@query("article_text", "SELECT page_id, url || ' ' || substr(html, 1, 500) AS article FROM pages")
def article_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.article_text("url", "html").alias("article"))


@query(
    "parse_post_time",
    """SELECT event_id, date_trunc('second', ts) AS created_at FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'""",
)
def parse_post_time(spark, sf):
    written = F.date_format(F.col("ts").cast("timestamp"), "E MMM dd HH:mm:ss Z yyyy")
    broken = F.when(F.col("event_type") == "error", F.lit("no time")).otherwise(written)
    e = table(spark, sf, "events").select("event_id", TM.parse_post_time(broken).alias("created_at"))
    return e.select("event_id", ntz("created_at"))


@query(
    "time_buckets",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INT) AS hour,
              CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_bucket, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_bucket
       FROM events""",
)
def time_buckets(spark, sf):
    b = TM.time_buckets(F.col("ts"))
    e = table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in b.items()])
    return e.select("event_id", F.col("date").cast("string").alias("date"), "hour", ntz("hour_bucket"), ntz("day_bucket"))


@query(
    "normalize_labels",
    sql(
        "samples",
        """SELECT doc_id, CASE WHEN emotion IN ('joy', 'love') THEN 'positive' WHEN emotion = 'sadness' THEN 'negative'
                               ELSE 'neutral' END AS sentiment,
                  CASE WHEN emotion = 'love' THEN 'neutral' ELSE emotion END AS emotion FROM samples""",
    ),
)
def normalize_labels(spark, sf):
    from moodquarry.queries.tables import samples

    df = samples(spark, sf).select("doc_id", F.col("emotion").alias("label"))
    return P.normalize_labels(df, emotion="label").select("doc_id", "sentiment", "emotion")


@query(
    "normalize_codes",
    """SELECT id, CASE CAST(label % 6 AS VARCHAR) WHEN '0' THEN 'negative' WHEN '2' THEN 'positive' WHEN '4' THEN 'positive'
                  ELSE 'neutral' END AS sentiment,
              CASE label WHEN 0 THEN 'sadness' WHEN 1 THEN 'joy' WHEN 2 THEN 'joy' WHEN 3 THEN 'anger' WHEN 4 THEN 'fear'
                         WHEN 5 THEN 'surprise' ELSE 'neutral' END AS emotion
       FROM (SELECT event_id AS id, CAST(user_id % 10 AS INT) AS label FROM events)""",
)
def normalize_codes(spark, sf):
    df = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 10).cast("int").alias("label"),
        (F.col("user_id") % 10 % 6).cast("string").alias("code"),
    )
    return P.normalize_labels(df, sentiment="code", emotion="label").select("id", "sentiment", "emotion")


@query(
    "align_columns",
    sql("samples", "SELECT text, sentiment, emotion FROM samples WHERE text IS NOT NULL AND sentiment IS NOT NULL"),
)
def align_columns(spark, sf):
    from moodquarry.queries.tables import samples

    df = samples(spark, sf).withColumnsRenamed({"text": "body", "sentiment": "label"})
    return P.align_columns(df, "body", "label", "emotion")


@query(
    "scores_json",
    sql(
        "posts",
        """SELECT id, '{"positive":' || CAST(k AS VARCHAR) || ',"negative":' || CAST(100 - k AS VARCHAR) || '}' AS scores
           FROM posts""",
    ),
)
def scores_json(spark, sf):
    scores = F.create_map(F.lit("positive"), F.col("k"), F.lit("negative"), F.lit(100) - F.col("k"))
    return posts(spark, sf).select("id", R.scores_json(scores).alias("scores"))


@query(
    "parse_hashtags",
    sql(
        "posts",
        """SELECT id, CAST(1 AS INT) AS n, event_type AS tag FROM (
               SELECT id, k, split_part(keywords, ',', 1) AS event_type FROM posts) WHERE k % 10 > 1
           UNION ALL SELECT id, CAST(2 AS INT), 'k' || (k % 10) FROM posts WHERE k % 10 > 1""",
    ),
)
def parse_hashtags_(spark, sf):
    tags = posts(spark, sf).select("id", F.posexplode(parse_hashtags(F.col("hashtags"))).alias("n", "tag"))
    return tags.select("id", (F.col("n") + 1).alias("n"), "tag")


@query(
    "analysis_view",
    sql(
        "analyses",
        """SELECT id, user_id, source, sentiment, round(compound_score, 4) AS compound_score, round(positive_score, 4) AS positive,
                  round(negative_score, 4) AS negative, round(neutral_score, 4) AS neutral, primary_emotion,
                  round(confidence, 4) AS confidence, processing_time_ms, text_length, word_count,
                  strftime(created_at, '%Y-%m-%dT%H:%M:%S') ||
                      CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE '.' || strftime(created_at, '%f') END AS created_at,
                  input_text FROM analyses""",
    ),
)
def analysis_view(spark, sf):
    return R.analysis_view(analyses(spark, sf)).select(
        "*", "scores.positive", "scores.negative", "scores.neutral"
    ).drop("scores")


@query(
    "analysis_record",
    sql(
        "posts",
        """SELECT id, text AS input_text, 'web' AS source, CASE WHEN k < 50 THEN 'neutral' ELSE sentiment END AS sentiment,
                  compound_score, confidence AS positive_score, CAST(0 AS DOUBLE) AS negative_score,
                  CAST(0 AS DOUBLE) AS neutral_score, primary_emotion, confidence, CAST(0 AS INT) AS processing_time_ms,
                  CAST(length(text) AS INT) AS text_length, CAST(5 AS INT) AS word_count FROM posts""",
    ),
)
def analysis_record(spark, sf):
    result = F.struct(
        F.when(F.col("k") >= 50, F.col("sentiment")).alias("sentiment"),
        "compound_score",
        F.struct(F.col("confidence").alias("pos")).alias("scores"),
        "primary_emotion",
        "confidence",
    )
    return R.analysis_record(posts(spark, sf).select("id", "text", result.alias("result")), "text", "result")
