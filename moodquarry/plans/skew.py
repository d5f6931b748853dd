"""A left join that splits hot keys.

Spark's own skew handling goes by bytes after compression, which equal rows hide. Here rows are counted.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.plans.session import settle

# Rows of one key that one task may get.
ROWS_PER_TASK = 1_000_000
# Tasks over which rows without a key are spread.
SPARE_KEYS = 10_000


def hot_keys(df: DataFrame, on: str, rows_per_task: int = ROWS_PER_TASK, counts: DataFrame | None = None) -> DataFrame | None:
    """All keys with more than `rows_per_task` rows, and the tasks each needs; None if there is none. `counts` are
    the rows (_n) of each key, if they are known."""
    if counts is None:
        counts = df.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    many = counts.where(F.col(on).isNotNull() & (F.col("_n") > rows_per_task))
    hot = settle(many.select(on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_tasks")))
    return None if hot.isEmpty() else hot


def hot_join(left: DataFrame, right: DataFrame, on: str, rows_per_task: int = ROWS_PER_TASK, counts: DataFrame | None = None) -> DataFrame:
    """Left join to `right`, which has one row per key. Rows of a hot key are dealt over several
    tasks by their place in the input, so that equal rows part, too, and its row on the right is repeated for each; rows
    without a key are spread. Every row is kept and the result is that of the plain join. `counts` as for `hot_keys`."""
    hot = hot_keys(left, on, rows_per_task, counts)
    own = F.xxhash64(F.monotonically_increasing_id())
    spare = F.when(F.col(on).isNull(), F.pmod(own, F.lit(SPARE_KEYS)))
    if hot is None:
        left = left.withColumn("_part", F.coalesce(spare, F.lit(0).cast("bigint")))
        return left.join(right.withColumn("_part", F.lit(0).cast("bigint")), [on, "_part"], "left").drop("_part")
    left = left.withColumn("_own", own).join(hot, on, "left")
    spare = F.when(F.col(on).isNull(), F.pmod("_own", F.lit(SPARE_KEYS)))
    left = left.withColumn("_part", F.coalesce(spare, F.pmod("_own", F.col("_tasks")), F.lit(0).cast("bigint"))).drop("_tasks", "_own")
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_tasks", F.lit(1)).cast("bigint") - 1)
    right = right.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_tasks")
    return left.join(right, [on, "_part"], "left").drop("_part")
