"""Aggregates over scored posts, analyses, samples and jobs.

Every aggregate groups by what it reports and adds up partial results, so a hot key costs one
row per task. Maps of counts are built from rows already grouped by label, one entry per label;
labels and emotions are small domains.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from moodquarry.functions.labels import SENTIMENTS
from moodquarry.functions.times import day_of, hour_of
from moodquarry.operators.filters import last_interval, time_range

# Fixed value: score columns of an analysed table that are averaged.
SCORE_COLUMNS = ["Compound_Score", "Positive_Score", "Negative_Score", "Neutral_Score", "Emotion_Confidence"]


def _rows() -> Column:
    return F.count(F.lit(1))


def _count_labels(column: str = "sentiment", suffix: str = "_count") -> list[Column]:
    return [F.count_if(F.col(column) == s).alias(s + suffix) for s in SENTIMENTS]


def _mean(total: str, n: str) -> Column:
    return F.col(total) / F.nullif(F.col(n), F.lit(0))


def sentiment_distribution(df: DataFrame, start: Column, end: Column, ts: str = "created_at") -> DataFrame:
    """Count and share of each label found in the range, largest first."""
    counts = time_range(df, ts, start, end).groupBy("sentiment").agg(_rows().alias("count"))
    # The window sees one row per label.
    share = F.col("count") * 100.0 / F.sum("count").over(W.partitionBy())
    return counts.withColumn("percentage", share).orderBy(F.desc("count"), "sentiment")


def batch_summary(
    df: DataFrame, sentiment: str = "Sentiment", emotion: str = "Primary_Emotion", scores: list[str] | None = None
) -> DataFrame:
    """Rows (metric, key, count, value) about an analysed table.

    The three labels are always listed, emotions if they occur; percentages are of all rows and
    rounded to 2, means to 4. Without rows, percentages and means are null.
    """
    scores = [c for c in (scores or SCORE_COLUMNS) if c in df.columns]
    has_emotion = emotion in df.columns
    sums = [x for c in scores for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]
    by_emotion = df.groupBy((F.col(emotion) if has_emotion else F.lit(None).cast("string")).alias("emotion")).agg(
        _rows().alias("n"), *_count_labels(sentiment, ""), *sums
    )
    totals = by_emotion.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SENTIMENTS],
        *[F.sum(f"s_{c}").alias(f"s_{c}") for c in scores],
        *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"n_{c}") for c in scores],
        F.collect_list(F.when(F.col("emotion").isNotNull(), F.struct("emotion", "n"))).alias("emotions"),
    )

    def row(metric, key, count, value):
        return F.struct(
            F.lit(metric).alias("metric"), key.alias("key"), count.cast("bigint").alias("count"), value.cast("double").alias("value")
        )

    def percent(count):
        return F.round(count / F.nullif(F.col("n"), F.lit(0)) * 100, 2)

    none = F.lit(None)
    fixed = [row("total", F.lit("records"), F.col("n"), none)]
    if sentiment in df.columns:
        fixed += [row("sentiment", F.lit(s), F.col(s), percent(F.col(s))) for s in SENTIMENTS]
    fixed += [row("average", F.lit(c), F.col(f"n_{c}"), F.round(_mean(f"s_{c}", f"n_{c}"), 4)) for c in scores]
    found = F.transform("emotions", lambda e: row("emotion", e["emotion"], e["n"], percent(e["n"])))
    return totals.select(F.explode(F.concat(F.array(*fixed), found)).alias("r")).select("r.*")


def user_stats(df: DataFrame) -> DataFrame:
    """One row per user: totals, label counts, emotion counts as a map, mean confidence and time."""
    parts = df.groupBy("user_id", "primary_emotion").agg(
        _rows().alias("n"),
        *_count_labels(),
        F.sum("confidence").alias("conf"),
        F.count("confidence").alias("n_conf"),
        F.sum("processing_time_ms").alias("ms"),
        F.count("processing_time_ms").alias("n_ms"),
    )
    return (
        parts.groupBy("user_id")
        .agg(
            F.sum("n").alias("total_analyses"),
            *[F.sum(f"{s}_count").alias(f"{s}_count") for s in SENTIMENTS],
            F.map_from_entries(
                F.collect_list(F.when(F.col("primary_emotion").isNotNull(), F.struct("primary_emotion", "n")))
            ).alias("emotion_distribution"),
            F.sum("conf").alias("conf"), F.sum("n_conf").alias("n_conf"),
            F.sum("ms").alias("ms"), F.sum("n_ms").alias("n_ms"),
        )
        .select(
            "user_id", "total_analyses", *[f"{s}_count" for s in SENTIMENTS], "emotion_distribution",
            F.coalesce(F.round(_mean("conf", "n_conf"), 4), F.lit(0.0)).alias("average_confidence"),
            F.coalesce(F.round(_mean("ms", "n_ms"), 2), F.lit(0.0)).alias("average_processing_time_ms"),
        )
    )


def hourly_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per hour and sentiment: counts, mean confidence, distinct users, summed retweets and likes."""
    users = F.approx_count_distinct("author_id") if approximate else F.count_distinct("author_id")
    return df.groupBy(hour_of(F.col("created_at")).alias("hour"), "sentiment").agg(
        _rows().alias("tweet_count"),
        F.avg("confidence").alias("avg_confidence"),
        users.alias("unique_users"),
        F.sum(F.expr("try_cast(retweet_count AS BIGINT)")).alias("total_retweets"),
        F.sum(F.expr("try_cast(like_count AS BIGINT)")).alias("total_favorites"),
    )


def daily_emotion(df: DataFrame) -> DataFrame:
    return df.groupBy(day_of(F.col("created_at")).alias("day"), "primary_emotion").agg(
        _rows().alias("emotion_count"), F.avg("confidence").alias("avg_confidence")
    )


def _hour_parts(df: DataFrame) -> DataFrame:
    """Partial sums per source, hour and emotion; a missing emotion is 'unknown'."""
    return df.groupBy(
        "source",
        hour_of(F.col("created_at")).alias("hour_bucket"),
        F.coalesce("primary_emotion", F.lit("unknown")).alias("emotion"),
    ).agg(
        _rows().alias("n"),
        *_count_labels(),
        F.sum("compound_score").alias("comp"), F.count("compound_score").alias("n_comp"),
        F.sum("confidence").alias("conf"), F.count("confidence").alias("n_conf"),
    )


def hourly_source_stats(df: DataFrame) -> DataFrame:
    """Per source and hour: counts, label counts, means, and a map of emotion counts; all hours at once."""
    return (
        _hour_parts(df)
        .groupBy("source", "hour_bucket")
        .agg(
            F.sum("n").alias("total_count"),
            *[F.sum(f"{s}_count").alias(f"{s}_count") for s in SENTIMENTS],
            F.sum("comp").alias("comp"), F.sum("n_comp").alias("n_comp"),
            F.sum("conf").alias("conf"), F.sum("n_conf").alias("n_conf"),
            F.map_from_entries(F.collect_list(F.struct("emotion", "n"))).alias("emotion_counts"),
        )
        .select(
            "source", "hour_bucket", "total_count", *[f"{s}_count" for s in SENTIMENTS],
            _mean("comp", "n_comp").alias("avg_compound_score"),
            _mean("conf", "n_conf").alias("avg_confidence"),
            "emotion_counts",
        )
    )


def preview_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first `n` rows in an order, to look at."""
    return df.orderBy(*order).limit(n)


def hourly_emotion_counts(df: DataFrame) -> DataFrame:
    """The emotion counts of `hourly_source_stats` as one row per source, hour and emotion."""
    return _hour_parts(df).select("source", "hour_bucket", "emotion", F.col("n").alias("count"))


def realtime_view(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The last hour per source, sentiment and emotion, largest first."""
    return (
        last_interval(df, "created_at", as_of)
        .groupBy("source", "sentiment", "primary_emotion")
        .agg(
            _rows().alias("count"),
            F.avg("compound_score").alias("avg_compound"),
            F.avg("confidence").alias("avg_confidence"),
            F.max("created_at").alias("last_update"),
        )
        .orderBy(F.desc("count"), "source", "sentiment", "primary_emotion")
    )


def trending_hashtags(df: DataFrame, start: Column, end: Column, k: int = 10) -> DataFrame:
    """The `k` most frequent tags with counts per label. A tag given twice in a post counts twice."""
    tags = (
        time_range(df, "created_at", start, end)
        .where(F.col("hashtags").isNotNull() & (F.col("hashtags") != "[]"))
        .select(F.explode(F.from_json("hashtags", "array<string>")).alias("hashtag"), "sentiment")
    )
    counts = tags.groupBy("hashtag").agg(_rows().alias("tweet_count"), *_count_labels())
    return counts.orderBy(F.desc("tweet_count"), "hashtag").limit(k)


def profile_columns(df: DataFrame, k: int = 10, few: int = 20) -> DataFrame:
    """The `k` most frequent values of each text column and of each other column with fewer than
    `few` distinct values, with type, row count and rank.

    Values are counted by their hash, so long texts do not travel; the at most `k` values per
    column are read back at the end. Ties go by hash. Nulls are not counted.
    """
    plain = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    text = {f.name for f in plain if isinstance(f.dataType, T.StringType)}
    guess = [f.name for f in plain if f.name not in text]
    sizes = df.agg(_rows().alias("n"), *[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(guess)]).first()
    # Twice the bound leaves room for the error of the estimate; the exact count decides below.
    columns = [f for f in plain if f.name in text or sizes[f"d_{guess.index(f.name)}"] < 2 * few]
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value"))
                    for f in columns
                ]
            )
        ).alias("c")
    ).select("c.*", F.md5("c.value").alias("h")).where(F.col("value").isNotNull())
    counts = cells.groupBy("column", "h").agg(_rows().alias("count"))
    distinct = counts.groupBy("column").agg(_rows().alias("n_distinct"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "h"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(distinct), "column")
    top = top.where(F.col("column").isin(sorted(text)) | (F.col("n_distinct") < few))
    # At most `k` rows per column, computed once for both uses below.
    top = F.broadcast(df.sparkSession.createDataFrame(top.collect(), top.schema))
    values = cells.join(top.select("column", "h"), ["column", "h"], "left_semi")
    values = values.groupBy("column", "h").agg(F.any_value("value").alias("value"))
    types = F.create_map(*[F.lit(x) for f in columns for x in (f.name, f.dataType.simpleString())])
    return top.join(values, ["column", "h"]).select(
        "column", types[F.col("column")].alias("dtype"), F.lit(sizes["n"]).cast("bigint").alias("n_rows"),
        "n_distinct", "rank", "value", "count",
    )


def count_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(_rows().alias("count"))


def dataset_registry_row(df: DataFrame) -> DataFrame:
    """Totals of a split table: all, per split and per label."""
    return df.agg(
        _rows().alias("total_samples"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in ("train", "val", "test")],
        *_count_labels(),
    )


def user_activity(users: DataFrame, analyses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Analyses and jobs of each user, 0 if none."""
    a = analyses.groupBy("user_id").agg(_rows().alias("analyses_count"))
    j = jobs.groupBy("user_id").agg(_rows().alias("jobs_count"))
    return users.select("user_id").join(a, "user_id", "left").join(j, "user_id", "left").na.fill(
        0, ["analyses_count", "jobs_count"]
    )


def top_keywords(df: DataFrame, k: int = 10) -> DataFrame:
    """The `k` most frequent keywords of each source and hour."""
    words = df.select(
        "source", hour_of(F.col("created_at")).alias("hour_bucket"), F.explode(F.split("keywords", ",")).alias("keyword")
    ).where(F.col("keyword") != "")
    counts = words.groupBy("source", "hour_bucket", "keyword").agg(_rows().alias("count"))
    rank = F.row_number().over(W.partitionBy("source", "hour_bucket").orderBy(F.desc("count"), "keyword"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def job_counters(df: DataFrame, job: str = "job_id") -> DataFrame:
    """Per job: rows processed, label counts, failed rows (null or 'error'), emotion counts as a map."""
    failed = F.col("sentiment").isNull() | (F.col("sentiment") == "error")
    parts = df.groupBy(job, "primary_emotion").agg(
        _rows().alias("n"), *_count_labels(), F.count_if(failed).alias("failed")
    )
    return parts.groupBy(job).agg(
        F.sum("n").alias("processed_records"),
        *[F.sum(f"{s}_count").alias(f"{s}_count") for s in SENTIMENTS],
        F.sum("failed").alias("failed_records"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("primary_emotion").isNotNull(), F.struct("primary_emotion", "n")))
        ).alias("emotion_counts"),
    )


def best_epoch(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the epoch of the lowest validation loss, the first one on ties."""
    best = F.min_by(F.struct("epoch", "val_loss", "sentiment_acc", "emotion_acc"), F.struct("val_loss", "epoch"))
    return epochs.where(F.col("val_loss").isNotNull()).groupBy(run).agg(best.alias("b")).select(run, "b.*")
