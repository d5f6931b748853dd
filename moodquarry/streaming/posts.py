"""Operators on streams of posts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.operators.scoring import score_guarded
from moodquarry.sources.schemas import SCORED

# Trend window, lateness of trends and of posts.
TREND_WIDTH, TREND_DELAY, POST_DELAY = "5 minutes", "10 minutes", "1 minute"


def score_stream(df: DataFrame, lexicons: tuple[DataFrame, DataFrame], **options) -> DataFrame:
    """Posts with their scores, in the columns of SCORED that apply.

    Lexicons small enough to be constants make this a stateless projection, so it runs on a stream
    as on a table. Larger ones are joined, which a stream does batch by batch: `control.start_fan_out` takes lexicons of any size. With
    `in_row` every task knows larger ones, too, as long as a worker's memory holds them, and the projection stays one.
    """
    scored = score_guarded(df, "text", lexicons, **options)
    return scored.select(*[f.name for f in SCORED.fields if f.name in scored.columns])


def trend_windows(df: DataFrame, watermark: str = TREND_DELAY, width: str = TREND_WIDTH) -> DataFrame:
    """Posts and mean confidence per window and label; later rows than `watermark` are dropped."""
    return (
        df.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", width), "sentiment")
        .agg(F.count(F.lit(1)).alias("tweet_count"), F.avg("confidence").alias("avg_confidence"))
    )


def flatten_trends(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "sentiment", "tweet_count", "avg_confidence",
    )


def dedup_stream(df: DataFrame, keys: list[str], ts: str = "created_at", delay: str = POST_DELAY) -> DataFrame:
    """The first row of each key; a key is remembered for `delay` of event time."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
