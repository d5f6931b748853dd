"""Time expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: post times look like `Mon Dec 01 10:00:00 +0000 2025`.
POST_TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def parse_post_time(c: Column) -> Column:
    """Timestamp of a post time, null if it does not parse.

    The weekday is redundant and Spark does not parse it, so reading starts after it.
    """
    return F.try_to_timestamp(F.substring(c, 5, 1000), F.lit(POST_TIME_FORMAT))


def hour_of(c: Column) -> Column:
    return F.date_trunc("hour", c)


def day_of(c: Column) -> Column:
    return F.date_trunc("day", c)


def time_buckets(c: Column) -> dict[str, Column]:
    """The date and hour used for partition folders, and both truncated times."""
    return {"date": F.to_date(c), "hour": F.hour(c), "hour_bucket": hour_of(c), "day_bucket": day_of(c)}
