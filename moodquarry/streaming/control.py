"""Start, watch and stop streaming queries. A query is known by its name."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moodquarry.plans.scratch import make_folder
from moodquarry.sinks.batches import Counts, Sink, batch_folder, make_batch_writer, parquet_sink, read_counts, table_sink, write_once
from moodquarry.sinks.files import POST_FOLDERS
from moodquarry.sources.schemas import SCORED
from moodquarry.sources.search_pages import with_ingest_time
from moodquarry.streaming.flush import FLUSH_ROWS, FLUSH_SECONDS, flush_groups, state_of_many_columns
from moodquarry.streaming.posts import TREND_DELAY, TREND_WIDTH, flatten_trends, score_stream, trend_windows

# Trigger intervals of posts, of collectors and of flushes.
POST_TRIGGER, COLLECT_TRIGGER = "10 seconds", "30 seconds"
FLUSH_TRIGGER = "60 seconds"


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, by the query's last 100 reports; for all batches give its writer `Counts`."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _trigger(writer, trigger: str | None):
    return writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)


def start(
    df: DataFrame, name: str, writer: Sink, trigger: str | None, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run `writer` on each micro-batch, with its number and the query's name and id. The checkpoint lies under
    the stable `name`, so a restart goes on where the query stopped, under the same id. A trigger of None takes what is there and ends."""
    spark = df.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        writer(batch, batch_id, f"{name}.{_find(spark, name).id}")

    out = df.writeStream.queryName(name).outputMode(mode).foreachBatch(each)
    return _trigger(out.option("checkpointLocation", f"{checkpoint}/{name}"), trigger).start()


def start_files(
    df: DataFrame, name: str, path: str, trigger: str | None, checkpoint: str, by: list[str] | None = None
) -> StreamingQuery:
    """Append to Parquet files through Spark's own file sink."""
    out = df.writeStream.queryName(name).outputMode("append").format("parquet").option("path", path)
    if by:
        out = out.partitionBy(*by)
    return _trigger(out.option("checkpointLocation", f"{checkpoint}/{name}"), trigger).start()


def start_console(df: DataFrame, name: str, trigger: str | None, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Show a few columns of a stream."""
    columns = columns or ["tweet_id", "text", "sentiment", "primary_emotion"]
    out = df.select(*columns).writeStream.queryName(name).outputMode("append").format("console").option("truncate", False)
    return _trigger(out.option("checkpointLocation", f"{checkpoint}/{name}"), trigger).start()


def _find(spark: SparkSession, name: str) -> StreamingQuery | None:
    return next((q for q in spark.streams.active if q.name == name), None)


def status(spark: SparkSession, name: str) -> dict:
    query = _find(spark, name)
    if query is None:
        return {"error": f"no running stream {name}"}
    return {
        "name": query.name, "id": query.id, "is_active": query.isActive, "status": query.status,
        "recent_progress": query.lastProgress,
    }


def stop(spark: SparkSession, name: str) -> bool:
    query = _find(spark, name)
    if query is None:
        return False
    query.stop()
    return True


def stop_all(spark: SparkSession) -> list[str]:
    names = [q.name for q in spark.streams.active]
    for name in names:
        stop(spark, name)
    return names


def wait(spark: SparkSession, name: str | None = None, timeout: float | None = None) -> bool:
    """Wait for one stream, or for any; True if it ended within `timeout` seconds. 0 looks and does not wait; None waits on."""
    query = _find(spark, name) if name is not None else spark.streams
    if query is None:
        return True
    wait_for = query.awaitTermination if name is not None else query.awaitAnyTermination
    if timeout is None:
        wait_for()
        return True
    return bool(wait_for(max(timeout, 0.001)))


def start_all(streams: dict[str, DataFrame | None], writer: Sink, trigger: str | None, checkpoint: str) -> dict[str, StreamingQuery]:
    """Start those streams that are given."""
    return {n: start(df, n, writer, trigger, checkpoint) for n, df in streams.items() if df is not None}


def batch_counts(spark: SparkSession, root: str, query: str | None = None) -> DataFrame:
    """Rows and late rows per micro-batch that had any, as writers with `Counts` noted them below `root`, over all restarts.

    `query` picks the stream of a name."""
    noted = read_counts(spark, root).where("rows > 0")
    if query is not None:
        noted = noted.where(F.substring_index("query", ".", 1) == query)
    return noted.select("query", "batch_id", F.col("rows").alias("num_input_rows"), "late_rows")


def start_fan_out(
    posts: DataFrame, name: str, lexicons: tuple[DataFrame, DataFrame], root: str, trigger: str | None, checkpoint: str,
    sinks: list[Sink] | None = None, **options,
) -> StreamingQuery:
    """Score each batch once and give it to the archive below `root`/scored and to other `sinks`; rows and late rows are noted below
    `root`/counts. Lexicons may have any size, as each batch is scored as a table."""
    writer = make_batch_writer(
        [parquet_sink(f"{root}/scored"), *(sinks or [])], lambda df: score_stream(df, lexicons, **options),
        Counts(f"{root}/counts", "created_at", TREND_DELAY, TREND_WIDTH),
    )
    return start(posts, name, writer, trigger, checkpoint)


def start_trends(spark: SparkSession, name: str, root: str, trigger: str | None, checkpoint: str) -> StreamingQuery:
    """Trends of the scored archive below `root`, as a stream of its own that scores nothing again."""
    scored = f"{root}/scored"
    make_folder(spark, scored)  # a stream may start before its archive has a batch
    fields = [f for f in SCORED.fields if f.name in ("created_at", "sentiment", "confidence")]
    # Beside what trends need, the columns of the archive's folders.
    folders = ["query", "batch_id", *POST_FOLDERS]
    kinds = T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in folders)])
    stream = spark.readStream.schema(kinds).parquet(scored).drop(*folders)
    return start(flatten_trends(trend_windows(stream)), name, make_batch_writer([table_sink(f"{root}/trends")]), trigger, checkpoint)


def start_collector(df: DataFrame, name: str, root: str, checkpoint: str, trigger: str | None = FLUSH_TRIGGER) -> StreamingQuery:
    """Flush collected rows in folders of the date and hour of arrival at each trigger.

    The source bounds a flush by its rows or files per trigger. A batch is written once, in a folder of its query.
    """

    def write(batch: DataFrame, batch_id: int, query: str = "") -> None:
        stamped = with_ingest_time(batch, F.current_timestamp())
        put = lambda rows, folder: rows.write.mode("overwrite").partitionBy("ingest_date", "ingest_hour").parquet(folder)
        write_once(stamped, batch_folder(root, batch_id, query), put)

    return start(df, name, write, trigger, checkpoint)


def start_flushes(
    df: DataFrame, name: str, root: str, checkpoint: str, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS,
    trigger: str | None = "1 second", buffer: Column | None = None,
) -> StreamingQuery:
    """Land collected rows in flushes of `rows` rows, or of what came within `seconds`, whichever is first (`flush_groups`).

    Each flush lies whole in a folder of the date and hour at which it was made. `trigger` is how often rows are taken and timers
    looked at. A batch without a flush writes nothing.
    """

    def write(batch: DataFrame, batch_id: int, query: str = "") -> None:
        if not batch.isEmpty():
            put = lambda flushed, folder: flushed.write.mode("overwrite").partitionBy("ingest_date", "ingest_hour").parquet(folder)
            write_once(with_ingest_time(batch, F.current_timestamp()), batch_folder(root, batch_id, query), put)

    with state_of_many_columns(df.sparkSession):
        return start(flush_groups(df, rows, seconds, buffer), name, make_batch_writer([write]), trigger, checkpoint)
