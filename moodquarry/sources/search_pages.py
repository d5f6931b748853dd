"""Search result pages: nested posts and users to flat rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.plans.skew import hot_join

PAGE_SCHEMA = """
    data array<struct<id:string,text:string,author_id:string,created_at:string,lang:string,source:string,
                      public_metrics:map<string,bigint>>>,
    includes struct<users:array<struct<id:string,name:string,username:string,verified:boolean>>>,
    meta struct<next_token:string,result_count:bigint>
"""


def attach_authors(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Left lookup of posts.author_id; an unknown author is null and not verified.

    `users` may repeat an id; one of its rows is kept. Posts of a hot author are split over tasks.
    """
    fields = [c for c in ("name", "username", "verified") if c in users.columns]
    one = users.groupBy(F.col("id").alias("author_id")).agg(F.min(F.struct(*fields)).alias("_u"))
    joined = hot_join(posts, one, "author_id")
    out = joined.select(
        *posts.columns,
        F.col("_u.name").alias("author_name") if "name" in fields else F.lit(None).cast("string").alias("author_name"),
        F.col("_u.username").alias("username") if "username" in fields else F.lit(None).cast("string").alias("username"),
        F.coalesce(F.col("_u.verified"), F.lit(False)).alias("verified")
        if "verified" in fields
        else F.lit(False).alias("verified"),
    )
    return out


def flatten_search_pages(pages: DataFrame, target_count: int | None = None) -> DataFrame:
    """One row per post; its author is looked up among the users of the same page, so nothing shuffles.

    Works on tables and streams; `target_count` is a limit of the search and is for tables only.
    """
    post = F.col("_p")
    users = F.coalesce(F.col("includes.users"), F.array().cast("array<struct<id:string,name:string,username:string,verified:boolean>>"))
    # The last of several users with one id wins, as when a dictionary is filled.
    author = F.element_at(F.filter(users, lambda u: u["id"] == F.col("_p.author_id")), -1)
    rows = (
        pages.select("includes", F.explode("data").alias("_p"))
        .withColumn("_a", F.when(F.size(F.filter(users, lambda u: u["id"] == F.col("_p.author_id"))) > 0, author))
        .select(
            post["id"].alias("id"),
            post["text"].alias("text"),
            post["created_at"].alias("created_at"),
            post["lang"].alias("lang"),
            post["source"].alias("source"),
            F.col("_a.id").alias("author_id"),
            F.col("_a.name").alias("author_name"),
            F.col("_a.username").alias("username"),
            F.coalesce(F.col("_a.verified"), F.lit(False)).alias("verified"),
            F.coalesce(post["public_metrics"]["retweet_count"], F.lit(0)).alias("retweets"),
            F.coalesce(post["public_metrics"]["like_count"], F.lit(0)).alias("likes"),
        )
    )
    return rows if target_count is None else rows.limit(target_count)


def with_ingest_time(df: DataFrame, at) -> DataFrame:
    """Partition columns of the time of arrival."""
    return df.withColumns({"ingest_date": F.date_format(at, "yyyy-MM-dd"), "ingest_hour": F.hour(at)})
