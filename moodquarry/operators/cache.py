"""Scores kept by text over many runs, in a table that joins without being moved."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.functions.text import cache_key, clean_text
from moodquarry.plans.scratch import children, make_folder, remove
from moodquarry.plans.session import settle
from moodquarry.plans.skew import hot_join

BUCKETS = 64


class ScoreCache:
    """A table of scores at `path`: cache_key, the columns of `kinds` (name and type) and stored_at.

    Its files are bucketed by the key, so a join by key reads each bucket where the other side's rows come to, and folders by the day of
    storing let old scores go without a look into younger ones. The files are all that lasts: any session takes them up
    again under a name of its catalog.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, kinds: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.columns = spark, name, path, list(kinds)
        make_folder(spark, path)
        columns = ", ".join(f"`{c}` {t}" for c, t in {"cache_key": "string", **kinds, "stored_at": "timestamp", "stored_day": "date"}.items())
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (stored_day) "
            f"CLUSTERED BY (cache_key) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def fresh(self, as_of: Column, ttl_seconds: int) -> DataFrame:
        """(cache_key, columns) stored less than `ttl_seconds` before `as_of`, the newest of each key; only days that may hold some are read."""
        since = as_of - F.make_interval(secs=F.lit(ttl_seconds))
        rows = self.spark.table(self.name).where((F.col("stored_day") >= F.to_date(since)) & (F.col("stored_at") > since) & (F.col("stored_at") <= as_of))
        newest = rows.groupBy("cache_key").agg(F.max_by(F.struct(*self.columns), "stored_at").alias("_r"))
        return newest.select("cache_key", "_r.*")

    def add(self, scores: DataFrame, stored_at: Column) -> None:
        """Append scores; a key may be there already, and its newest row counts."""
        rows = scores.select("cache_key", *self.columns, stored_at.cast("timestamp").alias("stored_at"))
        rows.withColumn("stored_day", F.to_date("stored_at")).write.insertInto(self.name)

    def expire(self, as_of: Column, ttl_seconds: int) -> list[str]:
        """Remove the days of which every score is too old; returns them. A repeat removes nothing more."""
        first = self.spark.range(1).select(F.to_date(as_of - F.make_interval(secs=F.lit(ttl_seconds)))).first()[0]
        days = [c.removeprefix("stored_day=") for c in children(self.spark, self.path) if c.startswith("stored_day=")]
        gone = [d for d in days if d < str(first)]
        for day in gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (stored_day = DATE '{day}')")
            remove(self.spark, f"{self.path}/stored_day={day}")
        return gone


def score_through_cache(
    df: DataFrame, text: str, kind: str, scorer: Callable[[DataFrame, str, str], DataFrame], cache: ScoreCache, ttl_seconds: int, as_of: Column
) -> DataFrame:
    """All rows with cache_key, the cache's columns and from_cache; texts that the cache does not have are scored once and added to it.

    Distinct texts are cleaned once and settled. They come to the cache's buckets; the cache itself stays where it is. Rows of a hot text are split
    over tasks. Null and empty texts are one text. `scorer(texts, key, text)` gets cleaned texts and returns the key and the cache's columns.
    """
    keyed = df.withColumn("_clean", clean_text(text, None))
    keyed = keyed.withColumn("cache_key", F.coalesce(cache_key("_clean", kind), F.lit("")))
    texts = settle(keyed.groupBy("cache_key").agg(F.any_value("_clean").alias("_clean"), F.count(F.lit(1)).alias("_n")))
    hits = settle(texts.select("cache_key").join(cache.fresh(as_of, ttl_seconds), "cache_key"))
    missing = settle(texts.drop("_n").join(hits.select("cache_key"), "cache_key", "left_anti"))
    scored = settle(scorer(missing, "cache_key", "_clean").select("cache_key", *cache.columns))
    cache.add(scored, as_of)
    known = hits.withColumn("from_cache", F.lit(True)).unionByName(scored.withColumn("from_cache", F.lit(False)))
    return hot_join(keyed.drop("_clean"), known, "cache_key", counts=texts.select("cache_key", "_n"))
