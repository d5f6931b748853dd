"""Newest rows, top rows and pages. Every order ends in a key, so results are repeatable."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T


def recent(df: DataFrame, ts: str, n: int, key: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(key)).limit(n)


def top_k(df: DataFrame, value: str, k: int, key: str) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(key)).limit(k)


def sorted_scores(scores: Column) -> Column:
    """Entries of a score map, highest first, ties by name."""
    def order(a, b):
        return (
            F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
            .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        )

    return F.array_sort(F.map_entries(scores), order)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1); a page past the end is empty."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, ts: str, key: str, last: tuple | None, size: int) -> DataFrame:
    """The rows, newest first, that follow the last (time, key) of the page before.

    Unlike an offset this stays cheap at any depth, since the filter reaches the scan.
    """
    if last is not None:
        kind = df.schema[ts].dataType
        at = F.lit(str(last[0])).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(last[0])
        row = F.lit(last[1])
        df = df.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) > row)))
    return df.orderBy(F.col(ts).desc(), F.col(key)).limit(size)


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group. Spark drops later rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
