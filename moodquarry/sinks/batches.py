"""Writers of micro-batches. A batch may come twice after a failure, so each sink can repeat it.

A batch is known by the query that runs it and its number. `streaming.control.start` names the query by its name and the id in its
checkpoint, so streams that share a writer or a root, and a checkpoint begun anew, never touch each other's batches.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.plans.scratch import exists, rename
from moodquarry.sinks.files import POST_FOLDERS, write_partitioned
from moodquarry.sources.database import read_jdbc, write_jdbc

Sink = Callable[[DataFrame, int, str], None]


def batch_folder(path: str, batch_id: int, query: str = "") -> str:
    return f"{path}/query={query or 'none'}/batch_id={batch_id}"


def write_once(df: DataFrame, folder: str, write: Callable[[DataFrame, str], None]) -> None:
    """`write` a batch to its folder, unless an earlier try completed it.

    It is written beside, below `_staging`, which no reader looks into, and then takes its place by a rename: what reads the table as a
    stream sees a batch whole and once, whichever marks the session lets its writers leave.
    """
    spark = df.sparkSession
    if exists(spark, folder):
        return
    root, query, batch = folder.rsplit("/", 2)
    stage = f"{root}/_staging/{query}/{batch}"
    write(df, stage)
    rename(spark, stage, folder)


@dataclass(frozen=True)
class Counts:
    """Where a writer notes each batch: rows, late rows and the newest time so far, as a table below `root` with a row for each batch.

    A row is late as Spark's watermark has it: its time, or with `width` the end of its window, is not after the newest time less
    `delay`, of all batches but this and the last one. A batch is noted once its sinks are done, before the stream goes on, so
    a restart neither loses nor repeats a note, and the driver keeps nothing.
    """

    root: str
    ts: str = "created_at"
    delay: str = "10 minutes"
    width: str | None = None

    def _last(self, spark: SparkSession, batch_id: int, query: str):
        """The note of the batch right before, or else of the last one there is; None for a first batch."""
        before = batch_folder(self.root, batch_id - 1, query)
        if exists(spark, before):
            return spark.read.parquet(before).first()
        if not exists(spark, f"{self.root}/query={query or 'none'}"):
            return None
        noted = spark.read.schema(_NOTE).parquet(self.root)
        return noted.where((F.col("query") == (query or "none")) & (F.col("batch_id") < batch_id)).orderBy(F.desc("batch_id")).first()

    def measure(self, df: DataFrame, batch_id: int, query: str) -> DataFrame:
        """One row: rows, late_rows, newest, and newest_before without this batch."""
        last = self._last(df.sparkSession, batch_id, query)
        before, mark = (F.lit(last and last[c]).cast("timestamp") for c in ("newest", "newest_before"))
        seen = F.col(self.ts) if self.width is None else F.window(self.ts, self.width)["end"]
        marked = df.select(F.col(self.ts).alias("at"), (seen <= mark - F.expr(f"INTERVAL {self.delay}")).alias("late"))
        counted = marked.agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"), F.max("at").alias("newest"))
        return counted.withColumn("newest", F.greatest("newest", before)).withColumn("newest_before", before)


_NOTE = "rows bigint, late_rows bigint, newest timestamp, newest_before timestamp, query string, batch_id bigint"


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """(query, batch_id, rows, late_rows, newest) of every batch that a writer noted."""
    return spark.read.schema(_NOTE).parquet(root).select("query", "batch_id", "rows", "late_rows", "newest")


def parquet_sink(path: str, by: list[str] | None = None, ts: str = "created_at") -> Sink:
    """Each batch once in its own folder below `path`; read it as one table."""

    def write(df: DataFrame, batch_id: int, query: str = "") -> None:
        put = lambda rows, folder: write_partitioned(rows, folder, by or POST_FOLDERS, ts, mode="overwrite")
        write_once(df, batch_folder(path, batch_id, query), put)

    return write


def table_sink(path: str) -> Sink:
    """As `parquet_sink`, without further folders."""

    def write(df: DataFrame, batch_id: int, query: str = "") -> None:
        write_once(df, batch_folder(path, batch_id, query), lambda rows, folder: rows.write.mode("overwrite").parquet(folder))

    return write


def jdbc_sink(url: str, table: str, props: dict[str, str], keys: list[str]) -> Sink:
    """Append all rows of a batch with their query and batch_id; a repeated batch adds those whose keys are missing."""

    def write(df: DataFrame, batch_id: int, query: str = "") -> None:
        own = f"batch_id = {int(batch_id)} AND query = '{query.replace(chr(39), chr(39) * 2)}'"
        have = read_jdbc(df.sparkSession, url, f"(SELECT {', '.join(keys)} FROM {table} WHERE {own}) AS t", props)
        fresh = df.join(have, keys, "left_anti").withColumns({"query": F.lit(query), "batch_id": F.lit(batch_id)})
        write_jdbc(fresh, url, table, props)

    return write


def make_batch_writer(
    sinks: list[Sink], transform: Callable[[DataFrame], DataFrame] | None = None, counts: Counts | None = None
) -> Sink:
    """A writer that computes a batch once and gives it to every sink, and then notes it in `counts`.

    An empty batch is noted and goes to no sink. A sink that fails fails the query, which then repeats the batch.
    """

    def write(df: DataFrame, batch_id: int, query: str = "") -> None:
        out = (transform(df) if transform else df).persist()
        try:
            if not out.isEmpty():
                for sink in sinks:
                    sink(out, batch_id, query)
            if counts is not None:
                put = lambda rows, folder: rows.write.mode("overwrite").parquet(folder)
                write_once(counts.measure(out, batch_id, query), batch_folder(counts.root, batch_id, query), put)
        finally:
            out.unpersist()

    return write
