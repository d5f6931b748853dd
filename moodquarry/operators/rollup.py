"""Hourly statistics kept as states that merge: from batches to hours, from hours to days, without the posts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.functions.labels import SENTIMENTS
from moodquarry.functions.times import hour_of

# 2^12 registers of a user sketch: a relative error of about 1.6 %, in 4 KB at most.
SKETCH_BITS = 12

KEYS = ["source", "hour_bucket", "sentiment", "emotion"]
SUMS = ["n", "compound", "n_compound", "confidence", "n_confidence", "retweets", "likes"]
STATE = (
    "source string, hour_bucket timestamp, sentiment string, emotion string, n bigint, compound double, n_compound bigint, "
    "confidence double, n_confidence bigint, retweets bigint, likes bigint, authors binary"
)


def hour_states(df: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One row for each source, hour, label and emotion of scored posts: counts, sums and a sketch of the authors.

    A missing emotion is 'unknown'; columns that posts do not have count as null. States of parts of the posts, in any order, merge to the
    state of all (`merge_states`).
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    rows = df.select(
        "source", hour_of(F.col("created_at")).alias("hour_bucket"), "sentiment",
        F.coalesce(have("primary_emotion", "string"), F.lit("unknown")).alias("emotion"),
        have("compound_score", "double").alias("compound"), have("confidence", "double").alias("confidence"),
        F.expr("try_cast(retweet_count AS BIGINT)").alias("retweets") if "retweet_count" in df.columns else F.lit(None).cast("bigint").alias("retweets"),
        F.expr("try_cast(like_count AS BIGINT)").alias("likes") if "like_count" in df.columns else F.lit(None).cast("bigint").alias("likes"),
        have("author_id", "string").alias("author"),
    )
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("compound").alias("compound"), F.count("compound").alias("n_compound"),
        F.sum("confidence").alias("confidence"), F.count("confidence").alias("n_confidence"),
        F.sum("retweets").alias("retweets"), F.sum("likes").alias("likes"),
        F.hll_sketch_agg("author", bits).alias("authors"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per key from any number of them."""
    return states.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS], F.hll_union_agg("authors").alias("authors"))


def _mean(total: str, n: str) -> Column:
    return F.col(total) / F.nullif(F.col(n), F.lit(0))


def source_hours(states: DataFrame) -> DataFrame:
    """`hourly_source_stats` from states: per source and hour counts, label counts, means and a map of emotion counts."""
    parts = states.groupBy("source", "hour_bucket", "emotion").agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.sum(F.when(F.col("sentiment") == s, F.col("n")).otherwise(0)).alias(f"{s}_count") for s in SENTIMENTS]
    )
    whole = parts.groupBy("source", "hour_bucket").agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.sum(f"{s}_count").alias(f"{s}_count") for s in SENTIMENTS],
        F.map_from_entries(F.collect_list(F.struct("emotion", "n"))).alias("emotion_counts"),
    )
    return whole.select(
        "source", "hour_bucket", F.col("n").alias("total_count"), *[f"{s}_count" for s in SENTIMENTS],
        _mean("compound", "n_compound").alias("avg_compound_score"), _mean("confidence", "n_confidence").alias("avg_confidence"), "emotion_counts",
    )


def spans(states: DataFrame, unit: str = "day", by: list[str] | None = None) -> DataFrame:
    """Totals of any span of hours, as `hourly_stats` has them for one: per span and the columns `by` (of KEYS), sentiment by default.

    `unique_users` is estimated from the hours' sketches, with a relative error of about 1.6 % by default; all else is exact.
    """
    by = ["sentiment"] if by is None else by
    return states.groupBy(F.date_trunc(unit, "hour_bucket").alias(unit), *by).agg(
        F.sum("n").alias("tweet_count"), F.sum("confidence").alias("c"), F.sum("n_confidence").alias("n_c"),
        F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("unique_users"),
        F.sum("retweets").alias("total_retweets"), F.sum("likes").alias("total_favorites"),
    ).select(unit, *by, "tweet_count", _mean("c", "n_c").alias("avg_confidence"), "unique_users", "total_retweets", "total_favorites")
