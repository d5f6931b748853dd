"""Message streams: JSON text to typed rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodquarry.functions.times import parse_post_time
from moodquarry.sources.schemas import MESSAGE


def parse_hashtags(c: Column) -> Column:
    """Elements of a JSON array of text; null if it is not one."""
    return F.from_json(c, "array<string>")


def parse_messages(df: DataFrame, value: str = "value", received: str | None = None, schema: T.StructType = MESSAGE) -> DataFrame:
    """The message fields of JSON text, with created_at as a timestamp. A broken message gives nulls."""
    fields = df.select(
        F.from_json(F.col(value).cast("string"), schema).alias("m"),
        *([F.col(received).alias("received_at")] if received else []),
    ).select("m.*", *(["received_at"] if received else []))
    return fields.withColumn("created_at", parse_post_time(F.col("created_at")))


def read_message_stream(
    spark: SparkSession, fmt: str, options: dict[str, str], max_per_trigger: int = 1000, schema: T.StructType = MESSAGE
) -> DataFrame:
    """Messages from `fmt`: kafka (if its jar is present) or text files with one message a line.

    Kafka starts at the latest offset and takes at most `max_per_trigger` messages a trigger;
    files take at most that many files.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", "maxOffsetsPerTrigger": str(max_per_trigger), **options}
        return parse_messages(reader.options(**options).load(), "value", "timestamp", schema)
    options = {"maxFilesPerTrigger": str(max_per_trigger), **options}
    path = options.pop("path")
    lines = reader.options(**options).load(path).withColumn("_at", F.current_timestamp())
    return parse_messages(lines, "value", "_at", schema)


def message_posts(df: DataFrame) -> DataFrame:
    """Messages under the column names of posts; counts that are not numbers become null."""
    return df.select(
        F.col("id").alias("tweet_id"),
        "text",
        F.col("user").alias("author_id"),
        "created_at",
        "lang",
        F.expr("try_cast(retweet_count AS BIGINT)").alias("retweet_count"),
        F.expr("try_cast(favorite_count AS BIGINT)").alias("like_count"),
        "hashtags",
    )
