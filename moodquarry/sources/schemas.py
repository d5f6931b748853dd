"""Fixed schemas of posts and messages."""

from pyspark.sql import types as T

POST = T.StructType(
    [
        T.StructField("tweet_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("author_id", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("like_count", T.LongType()),
    ]
)

SCORED = T.StructType(
    POST.fields
    + [
        T.StructField("sentiment", T.StringType(), False),
        T.StructField("compound_score", T.DoubleType(), False),
        T.StructField("primary_emotion", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("source", T.StringType(), False),
    ]
)

# Everything is text on the wire.
MESSAGE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("id", "text", "user", "created_at", "lang", "retweet_count", "favorite_count", "hashtags")
    ]
)

SAMPLE_COLUMNS = ["text", "sentiment", "emotion", "source"]
