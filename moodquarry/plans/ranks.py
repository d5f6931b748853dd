"""Consecutive numbers over a sorted table, without one task that sees it all."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodquarry.plans.session import settle


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with numbers from 0 in the given order as column `name`.

    Rows are sorted by ranges and settled; the rows of each range are counted, and a row's number is its place in its range after all
    earlier ranges. Only a count for each range comes together.
    """
    placed = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before", "_at")
