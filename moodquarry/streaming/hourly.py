"""The hourly table kept up from a stream: each batch adds its states, late rows included, and they fold into one table.

Below `root`, `parts` holds the states of each batch, once; `folded/generation=N` holds those of all batches folded so far and
which these are. A reader takes the last generation and the parts that it does not hold, so folding changes no result, and
nothing is counted twice if a batch is repeated, a fold breaks off or a repeated batch comes after its fold.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.operators.rollup import STATE, hour_states, merge_states
from moodquarry.plans.scratch import children, make_folder, remove, rename
from moodquarry.sinks.batches import Sink, batch_folder, write_once

_BATCH = ["query", "batch_id"]


def hourly_sink(root: str) -> Sink:
    """Adds the states of a batch of scored posts, one row per source, hour, label and emotion."""

    def write(df: DataFrame, batch_id: int, query: str = "") -> None:
        put = lambda rows, folder: rows.write.mode("overwrite").parquet(folder)
        write_once(hour_states(df), batch_folder(f"{root}/parts", batch_id, query), put)

    return write


def _generation(spark: SparkSession, root: str) -> int:
    found = [int(n.split("=")[1]) for n in children(spark, f"{root}/folded") if n.startswith("generation=")]
    return max(found, default=-1)


def _open_parts(spark: SparkSession, root: str, generation: int) -> DataFrame:
    """States of the batches that the generation does not hold, with their query and batch."""
    make_folder(spark, f"{root}/parts")
    parts = spark.read.schema(f"{STATE}, query string, batch_id bigint").parquet(f"{root}/parts")
    if generation < 0:
        return parts
    return parts.join(spark.read.parquet(f"{root}/folded/generation={generation}/batches"), _BATCH, "left_anti")


def read_hours(spark: SparkSession, root: str) -> DataFrame:
    """The merged states of all batches; make statistics of them by `rollup.source_hours` and `rollup.spans`."""
    generation = _generation(spark, root)
    states = _open_parts(spark, root, generation).drop(*_BATCH)
    if generation >= 0:
        states = states.unionByName(spark.read.schema(STATE).parquet(f"{root}/folded/generation={generation}/states"))
    return merge_states(states)


def fold_hours(spark: SparkSession, root: str) -> int:
    """Fold all parts into a new generation and return its number. One fold runs at a time; batches may go on coming.

    A generation takes its place whole, by a rename. The parts that the one before had folded, and older generations, are removed then,
    so readers of the last generation or of the one before it are not disturbed.
    """
    before = _generation(spark, root)
    parts = _open_parts(spark, root, before)
    stage = f"{root}/_staging/fold"
    remove(spark, stage)
    batches = parts.select(*_BATCH).distinct()
    if before >= 0:
        batches = batches.unionByName(spark.read.parquet(f"{root}/folded/generation={before}/batches"))
    batches.write.parquet(f"{stage}/batches")
    # The list is settled first: a batch that comes now belongs to the next fold.
    fresh = parts.join(spark.read.parquet(f"{stage}/batches"), _BATCH, "left_semi").drop(*_BATCH)
    if before >= 0:
        fresh = fresh.unionByName(spark.read.parquet(f"{root}/folded/generation={before}/states"))
    merge_states(fresh).write.parquet(f"{stage}/states")
    rename(spark, stage, f"{root}/folded/generation={before + 1}")
    if before >= 0:
        for query, batch in _folders(spark, root, before):
            remove(spark, f"{root}/parts/{query}/{batch}")
        for old in children(spark, f"{root}/folded"):
            if old.startswith("generation=") and int(old.split("=")[1]) < before:
                remove(spark, f"{root}/folded/{old}")
    return before + 1


def _folders(spark: SparkSession, root: str, generation: int):
    """Folders of the parts that a generation holds and that are still there, a few names for each batch since the last fold."""
    for query in children(spark, f"{root}/parts"):
        name = query.removeprefix("query=")
        there = [int(c.removeprefix("batch_id=")) for c in children(spark, f"{root}/parts/{query}") if c.startswith("batch_id=")]
        if there:
            held = spark.read.parquet(f"{root}/folded/generation={generation}/batches").where(F.col("query") == name)
            for r in held.where(F.col("batch_id").isin(there)).collect():
                yield query, f"batch_id={r.batch_id}"
