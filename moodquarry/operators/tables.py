"""Joins and keyed writes between tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodquarry.plans.lookup import lookup_join


def model_comparison(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models with the dataset they were trained on, best weighted F1 first, unscored last."""
    names = datasets.select(
        F.col("id").alias("training_dataset_id"), F.col("name").alias("dataset_name"), "total_samples"
    )
    own = ["name", "version", "architecture", "accuracy", "f1_macro", "f1_weighted", "is_production"]
    return (
        lookup_join(models, names, "training_dataset_id", "left")
        .select(*own, "dataset_name", "total_samples")
        .orderBy(F.col("f1_weighted").desc_nulls_last(), "name", "version")
    )


def dedup_key(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the smallest `order`, any one without it.

    Spark drops further rows of a key before the shuffle, so a key with many rows costs one row
    per task, and columns that are not used later are not read.
    """
    if order is None:
        return df.dropDuplicates(keys)
    first = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")


def insert_new(existing: DataFrame, fresh: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of `fresh` to append: one per key, none whose key exists."""
    return dedup_key(fresh, keys, order).join(existing.select(*keys), keys, "left_anti")


def same_key(keys: list[str]) -> Column:
    """Equal keys of tables named old and new, where null equals null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    return same


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """`existing` with the rows of `fresh` inserted or put in place of rows with the same key; null is a key like any other.

    Of equal keys in `fresh` the one with the largest `order` counts, any one without it.
    """
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())) if order else None
    one = fresh.withColumn("_last", last).where(F.col("_last") == 1).drop("_last") if order else fresh.dropDuplicates(keys)
    new = one.select(*keys).alias("new")
    return existing.alias("old").join(new, same_key(keys), "left_anti").unionByName(one)


def upsert_hourly(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(existing, fresh, ["source", "hour_bucket"])


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables by column name; missing columns are null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_samples(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs)


def union_posts(*dfs: DataFrame) -> DataFrame:
    """Posts of several sources, tables or streams, in one schema."""
    return union_all(*dfs)
