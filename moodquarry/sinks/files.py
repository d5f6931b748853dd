"""Tables written as files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.functions.times import time_buckets
from moodquarry.operators.prepare import split_metadata
from moodquarry.operators.tables import same_key, upsert
from moodquarry.plans.scratch import exists, from_url, remove
from moodquarry.plans.session import settle

# Fixed value: folders of the post archive.
POST_FOLDERS = ["source", "date", "hour"]


def _with_folders(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    missing = [c for c in by if c not in df.columns]
    buckets = time_buckets(F.col(ts)) if missing else {}
    return df.withColumns({c: buckets[c] for c in missing})


def write_partitioned(
    df: DataFrame, path: str, by: list[str] | None = None, ts: str = "created_at", mode: str = "append"
) -> None:
    """Parquet in one folder per value of `by`; date and hour are taken from `ts` if missing.

    The rebalance hint gathers the rows of a folder into few files and splits a folder too large
    for one task.
    """
    by = by or POST_FOLDERS
    _with_folders(df, by, ts).hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def write_result_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV part files with a header; read them back with `read_text_csv`."""
    df.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_splits(df: DataFrame, root: str, sources: DataFrame | None = None) -> DataFrame:
    """One folder per split, none for an empty one; returns the counts as rows."""
    df.write.mode("overwrite").partitionBy("split").parquet(root)
    return split_metadata(df.sparkSession.read.parquet(root), sources)


def write_upsert(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str], folder: str, order: str | None = None) -> None:
    """Insert or replace rows by key in a table with one folder per `folder`; a null folder is one, too.

    All folders are searched for the keys, by those columns only. The folders of `fresh` and those that hold one of its keys are read
    and written again, so a key that moves is left in its new folder alone.
    """
    old = spark.read.parquet(path)
    wanted = fresh.select(*keys).distinct().alias("new")
    held = old.select(*dict.fromkeys([*keys, folder])).alias("old").join(wanted, same_key(keys), "left_semi").select(folder)
    touched = settle(held.unionByName(fresh.select(folder)).distinct())
    part = old.alias("old").join(touched.alias("new"), same_key([folder]), "left_semi")
    merged = settle(upsert(part, fresh, keys, order).select(*old.columns))
    file = part.metadataColumn("_metadata").getField("file_path")
    one = part.select(file.alias("file")).groupBy(F.regexp_extract("file", "^(.*)/", 1).alias("folder")).agg(F.min("file").alias("file"))
    before = [(from_url(spark, r.folder), from_url(spark, r.file)) for r in one.collect()]  # a row for each folder read
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(path)
    for place, old_file in before:
        if exists(spark, old_file):  # not written again: the folder lost its last row
            remove(spark, place)
