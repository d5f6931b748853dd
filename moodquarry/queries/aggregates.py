"""Aggregates, joins and keyed writes."""

from pyspark.sql import functions as F

from moodquarry.operators import stats as S
from moodquarry.operators import tables as T
from moodquarry.queries import query
from moodquarry.queries.tables import (
    AS_OF, END, START, analysed, analyses, datasets, epochs, jobs, models, ntz, posts, r6, samples, sql, stamp, table, users,
)
from moodquarry.sources.search_pages import attach_authors as attach

_LABELS = """count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'negative') AS negative_count,
             count(*) FILTER (sentiment = 'neutral') AS neutral_count"""
LABEL_COUNTS = ["positive_count", "negative_count", "neutral_count"]


@query(
    "sentiment_distribution",
    sql(
        "posts",
        f"""SELECT sentiment, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage
            FROM posts WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY sentiment""",
    ),
)
def sentiment_distribution(spark, sf):
    return S.sentiment_distribution(posts(spark, sf), stamp(START), stamp(END)).select("sentiment", "count", r6("percentage"))


_MEANS = " UNION ALL ".join(
    f"SELECT 'average', '{c}', count({c}), round(avg({c}), 4) FROM analysed" for c in S.SCORE_COLUMNS
)


@query(
    "batch_summary",
    sql(
        "analysed",
        f"""SELECT 'total' AS metric, 'records' AS key, count(*) AS count, CAST(NULL AS DOUBLE) AS value FROM analysed
            UNION ALL SELECT 'sentiment', s, count(*) FILTER (Sentiment = s),
                             round(count(*) FILTER (Sentiment = s) / count(*) * 100, 2)
            FROM analysed, (SELECT unnest(['positive', 'negative', 'neutral']) AS s) GROUP BY s
            UNION ALL SELECT 'emotion', Primary_Emotion, count(*), round(count(*) / (SELECT count(*) FROM analysed) * 100, 2)
            FROM analysed WHERE Primary_Emotion IS NOT NULL GROUP BY Primary_Emotion
            UNION ALL {_MEANS}""",
    ),
)
def batch_summary(spark, sf):
    return S.batch_summary(analysed(spark, sf))


def entries(counts: str):
    """All entries of a map of counts as text, to be compared."""
    pairs = F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), ",")


@query(
    "user_stats",
    sql(
        "analyses",
        f"""SELECT user_id, count(*) AS total_analyses, {_LABELS}, any_value(coalesce(emotions, '')) AS emotions,
                   coalesce(round(avg(confidence), 4), 0) AS average_confidence,
                   coalesce(round(avg(processing_time_ms), 2), 0) AS average_processing_time_ms
            FROM analyses LEFT JOIN (
                SELECT user_id, string_agg(primary_emotion || ':' || n, ',' ORDER BY primary_emotion || ':' || n) AS emotions
                FROM (SELECT user_id, primary_emotion, count(*) AS n FROM analyses WHERE primary_emotion IS NOT NULL GROUP BY 1, 2)
                GROUP BY 1) USING (user_id) GROUP BY user_id""",
    ),
)
def user_stats(spark, sf):
    return S.user_stats(analyses(spark, sf)).select(
        "user_id", "total_analyses", *LABEL_COUNTS, entries("emotion_distribution").alias("emotions"),
        "average_confidence", "average_processing_time_ms",
    )


@query(
    "hourly_stats",
    sql(
        "posts",
        """SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour, sentiment, count(*) AS tweet_count,
                  round(avg(confidence), 6) AS avg_confidence, count(DISTINCT author_id) AS unique_users,
                  CAST(sum(retweet_count) AS BIGINT) AS total_retweets, CAST(sum(like_count) AS BIGINT) AS total_favorites
           FROM posts GROUP BY 1, 2""",
    ),
)
def hourly_stats(spark, sf):
    return S.hourly_stats(posts(spark, sf)).select(
        ntz("hour"), "sentiment", "tweet_count", r6("avg_confidence"), "unique_users", "total_retweets", "total_favorites"
    )


@query(
    "daily_emotion",
    sql(
        "posts",
        """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, primary_emotion, count(*) AS emotion_count,
                  round(avg(confidence), 6) AS avg_confidence FROM posts GROUP BY 1, 2""",
    ),
)
def daily_emotion(spark, sf):
    return S.daily_emotion(posts(spark, sf)).select(ntz("day"), "primary_emotion", "emotion_count", r6("avg_confidence"))


@query(
    "hourly_source_stats",
    sql(
        "posts",
        f"""SELECT source, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket, count(*) AS total_count, {_LABELS},
                   round(avg(compound_score), 6) AS avg_compound_score, round(avg(confidence), 6) AS avg_confidence
            FROM posts GROUP BY 1, 2""",
    ),
)
def hourly_source_stats(spark, sf):
    return S.hourly_source_stats(posts(spark, sf)).select(
        "source", ntz("hour_bucket"), "total_count", *LABEL_COUNTS, r6("avg_compound_score"), r6("avg_confidence")
    )


_HOUR_EMOTIONS = sql(
    "posts",
    """SELECT source, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket,
              coalesce(primary_emotion, 'unknown') AS emotion, count(*) AS count FROM posts GROUP BY 1, 2, 3""",
)


@query("hourly_emotion_counts", _HOUR_EMOTIONS)
def hourly_emotion_counts(spark, sf):
    return S.hourly_emotion_counts(posts(spark, sf)).select("source", ntz("hour_bucket"), "emotion", "count")


@query("hourly_source_stats_map", _HOUR_EMOTIONS)
def hourly_source_stats_map(spark, sf):
    """The map of the hourly statistics, entry by entry."""
    return S.hourly_source_stats(posts(spark, sf)).select(
        "source", ntz("hour_bucket"), F.explode("emotion_counts").alias("emotion", "count")
    )


@query(
    "realtime_view",
    sql(
        "posts",
        f"""SELECT source, sentiment, primary_emotion, count(*) AS count, round(avg(compound_score), 6) AS avg_compound,
                   round(avg(confidence), 6) AS avg_confidence, max(created_at) AS last_update
            FROM posts WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR GROUP BY 1, 2, 3""",
    ),
)
def realtime_view(spark, sf):
    return S.realtime_view(posts(spark, sf), stamp(AS_OF)).select(
        "source", "sentiment", "primary_emotion", "count", r6("avg_compound"), r6("avg_confidence"), ntz("last_update")
    )


@query(
    "trending_hashtags",
    sql(
        "posts",
        f"""SELECT hashtag, count(*) AS tweet_count, {_LABELS}
            FROM (SELECT unnest(CAST(hashtags AS VARCHAR[])) AS hashtag, sentiment FROM
                      (SELECT replace(hashtags, '"', '') AS hashtags, sentiment, created_at FROM posts)
                  WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND hashtags <> '[]')
            GROUP BY hashtag ORDER BY tweet_count DESC, hashtag LIMIT 10""",
    ),
)
def trending_hashtags(spark, sf):
    return S.trending_hashtags(posts(spark, sf), stamp(START), stamp(END), 10)


def _profile_sql(rel: str, columns: dict[str, str], text: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, {c}::VARCHAR AS value FROM {rel}" for c, t in columns.items()
    )
    names = ", ".join(f"'{c}'" for c in text)
    return f"""
        SELECT "column", dtype, (SELECT count(*) FROM {rel}) AS n_rows, n_distinct, CAST(rank AS INT) AS rank, value, count FROM (
            SELECT "column", dtype, value, count(*) AS count, count(*) OVER (PARTITION BY "column") AS n_distinct,
                   row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, md5(value)) AS rank
            FROM ({cells}) WHERE value IS NOT NULL GROUP BY "column", dtype, value)
        WHERE rank <= 10 AND ("column" IN ({names}) OR n_distinct < 20)"""


@query(
    "profile_columns",
    _profile_sql(
        "documents",
        {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
        ["text", "lang", "source"],
    ),
)
def profile_columns(spark, sf):
    return S.profile_columns(table(spark, sf, "documents"))


@query(
    "profile_numbers",
    _profile_sql("labels", {"doc_id": "bigint", "quality": "int", "toxic": "int"}, ["-"]),
)
def profile_numbers(spark, sf):
    return S.profile_columns(table(spark, sf, "labels"))


@query("count_by_source", "SELECT source, count(*) AS count FROM documents GROUP BY source")
def count_by_source(spark, sf):
    return S.count_by_source(table(spark, sf, "documents"))


@query(
    "user_activity",
    sql(
        "users analyses jobs",
        """SELECT user_id, coalesce(a.n, 0) AS analyses_count, coalesce(j.n, 0) AS jobs_count FROM users
           LEFT JOIN (SELECT user_id, count(*) AS n FROM analyses GROUP BY 1) a USING (user_id)
           LEFT JOIN (SELECT user_id, count(*) AS n FROM jobs GROUP BY 1) j USING (user_id)""",
    ),
)
def user_activity(spark, sf):
    return S.user_activity(users(spark, sf), analyses(spark, sf), jobs(spark, sf))


@query(
    "top_keywords",
    sql(
        "posts",
        """SELECT source, hour_bucket, keyword, count, CAST(rank AS INT) AS rank FROM (
               SELECT *, row_number() OVER (PARTITION BY source, hour_bucket ORDER BY count DESC, keyword) AS rank FROM (
                   SELECT source, hour_bucket, keyword, count(*) AS count FROM (
                       SELECT source, CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket,
                              unnest(string_split(keywords, ',')) AS keyword FROM posts) GROUP BY 1, 2, 3))
           WHERE rank <= 3""",
    ),
)
def top_keywords(spark, sf):
    return S.top_keywords(posts(spark, sf), 3).select("source", ntz("hour_bucket"), "keyword", "count", "rank")


@query(
    "job_counters",
    sql(
        "analysed",
        """SELECT id % 100 AS job_id, count(*) AS processed_records,
                  count(*) FILTER (Sentiment = 'positive') AS positive_count, count(*) FILTER (Sentiment = 'negative') AS negative_count,
                  count(*) FILTER (Sentiment = 'neutral') AS neutral_count, count(*) FILTER (Sentiment IS NULL) AS failed_records,
                  any_value(coalesce(emotions, '')) AS emotions FROM analysed LEFT JOIN (
                      SELECT job, string_agg(e || ':' || n, ',' ORDER BY e || ':' || n) AS emotions
                      FROM (SELECT id % 100 AS job, Primary_Emotion AS e, count(*) AS n FROM analysed WHERE e IS NOT NULL GROUP BY 1, 2)
                      GROUP BY 1) ON job = id % 100 GROUP BY 1""",
    ),
)
def job_counters(spark, sf):
    df = analysed(spark, sf).select(
        (F.col("id") % 100).alias("job_id"), F.col("Sentiment").alias("sentiment"), F.col("Primary_Emotion").alias("primary_emotion")
    )
    return S.job_counters(df).select(
        "job_id", "processed_records", *LABEL_COUNTS, "failed_records",
        entries("emotion_counts").alias("emotions"),
    )


@query(
    "best_epoch",
    sql(
        "epochs",
        """SELECT run_id, epoch, val_loss, sentiment_acc, emotion_acc FROM (
               SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS r FROM epochs) WHERE r = 1""",
    ),
)
def best_epoch(spark, sf):
    return S.best_epoch(epochs(spark, sf))


@query(
    "model_comparison",
    sql(
        "models datasets",
        """SELECT m.name, version, architecture, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
                  round(f1_weighted, 6) AS f1_weighted, is_production, d.name AS dataset_name, coalesce(total_samples, -1) AS total_samples
           FROM models m LEFT JOIN datasets d ON training_dataset_id = d.id""",
    ),
)
def model_comparison(spark, sf):
    return T.model_comparison(models(spark, sf), datasets(spark, sf)).select(
        "name", "version", "architecture", r6("accuracy"), r6("f1_macro"), r6("f1_weighted"), "is_production",
        "dataset_name", F.coalesce("total_samples", F.lit(-1)).alias("total_samples"),
    )


@query(
    "nulls_last",
    sql("models", "SELECT name, round(f1_weighted, 6) AS f1_weighted FROM models ORDER BY f1_weighted DESC NULLS LAST, name"),
)
def nulls_last(spark, sf):
    rows = models(spark, sf).select("name", "f1_weighted")
    return rows.orderBy(F.col("f1_weighted").desc_nulls_last(), "name").select("name", r6("f1_weighted"))


@query(
    "attach_authors",
    """SELECT e.event_id AS id, e.user_id AS author_id, c.c_name AS author_name, 'u' || c.c_custkey AS username,
              coalesce(c.c_acctbal > 0, false) AS verified
       FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
)
def attach_authors(spark, sf):
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"), (F.col("c_acctbal") > 0).alias("verified"),
    )
    mail = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("author_id"))
    return attach(mail, people.unionByName(people))


def _hourly_rows(where: str) -> str:
    """All nine columns of the hourly table, the emotion counts as text."""
    hour = "CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket"
    return f"""
        SELECT * FROM (SELECT source, {hour}, count(*) AS total_count, {_LABELS}, round(avg(compound_score), 6) AS avg_compound_score,
                              round(avg(confidence), 6) AS avg_confidence FROM posts WHERE {where} GROUP BY 1, 2)
        JOIN (SELECT source, hour_bucket, string_agg(emotion || ':' || n, ',' ORDER BY emotion || ':' || n) AS emotion_counts
              FROM (SELECT source, {hour}, coalesce(primary_emotion, 'unknown') AS emotion, count(*) AS n FROM posts WHERE {where} GROUP BY 1, 2, 3)
              GROUP BY 1, 2) USING (source, hour_bucket)"""


def hourly_rows(df):
    return S.hourly_source_stats(df).select(
        "source", ntz("hour_bucket"), "total_count", *LABEL_COUNTS, r6("avg_compound_score"), r6("avg_confidence"),
        entries("emotion_counts").alias("emotion_counts"),
    )


UPSERTED = f"""SELECT * REPLACE (-total_count AS total_count) FROM ({_hourly_rows(f"created_at < TIMESTAMP '{END}'")}) WHERE hour_bucket < TIMESTAMP '{START}'
    UNION ALL SELECT * FROM ({_hourly_rows(f"created_at >= TIMESTAMP '{START}'")})"""


@query("upsert_hourly", sql("posts", UPSERTED))
def upsert_hourly(spark, sf):
    """Hours before END, marked by negative counts, renewed from START on."""
    old = hourly_rows(posts(spark, sf).where(F.col("created_at") < stamp(END))).withColumn("total_count", -F.col("total_count"))
    return T.upsert_hourly(old, hourly_rows(posts(spark, sf).where(F.col("created_at") >= stamp(START))))


@query("preview_rows", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 10")
def preview_rows(spark, sf):
    return S.preview_rows(table(spark, sf, "conversations"), 10, "conv_id", "turn")


_EXISTING = "SELECT DISTINCT user_id, source FROM posts WHERE k = 50"


@query(
    "insert_new",
    sql(
        "posts",
        f"""SELECT id, user_id, source FROM (SELECT id, user_id, source, row_number() OVER (PARTITION BY user_id, source ORDER BY id) AS r
               FROM posts) WHERE r = 1 AND (user_id, source) NOT IN ({_EXISTING})""",
    ),
)
def insert_new(spark, sf):
    p = posts(spark, sf).select("id", "user_id", "source", "k")
    have = p.where(F.col("k") == 50).select("user_id", "source").distinct()
    return T.insert_new(have, p.drop("k"), ["user_id", "source"], "id")


@query(
    "dedup_key",
    sql(
        "posts",
        """SELECT id, source, primary_emotion FROM (SELECT *, row_number() OVER (PARTITION BY author_id, source, k ORDER BY id) AS r FROM posts)
           WHERE r = 1""",
    ),
)
def dedup_key(spark, sf):
    return T.dedup_key(posts(spark, sf), ["author_id", "source", "k"], "id").select("id", "source", "primary_emotion")


@query(
    "union_samples",
    sql(
        "samples",
        """SELECT doc_id AS id, text, sentiment, source FROM samples
           UNION ALL SELECT conv_id, text, NULL, 'streamed' FROM conversations""",
    ),
)
def union_samples(spark, sf):
    drops = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", F.lit("streamed").alias("source"))
    static = samples(spark, sf).select(F.col("doc_id").alias("id"), "text", "sentiment", "source")
    return T.union_samples(static, drops)


@query(
    "count_over_emotion",
    sql("posts", "SELECT source, primary_emotion, count(*) AS emotion_cnt FROM posts GROUP BY 1, 2"),
)
def count_over_emotion(spark, sf):
    """The window count of an emotion per source, by grouping first."""
    counts = S.hourly_emotion_counts(posts(spark, sf)).groupBy("source", "emotion").agg(F.sum("count").alias("emotion_cnt"))
    return counts.select("source", F.nullif("emotion", F.lit("unknown")).alias("primary_emotion"), "emotion_cnt")
