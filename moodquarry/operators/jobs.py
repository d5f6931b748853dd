"""Jobs and training runs as tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.plans.scratch import make_folder, remove_all
from moodquarry.plans.session import settle

# Job states, days to keep records and files, columns of the run tables.
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
KEEP_RECORDS_DAYS, KEEP_FILES_DAYS = 30, 7
RUN_COLUMNS = [
    "id", "run_name", "dataset_name", "status", "best_val_loss", "best_sentiment_acc", "best_emotion_acc",
    "test_sentiment_acc", "test_emotion_acc", "started_at", "finished_at", "notes",
]
EPOCH_COLUMNS = ["epoch", "phase", "train_loss", "val_loss", "sentiment_acc", "emotion_acc", "created_at"]


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def job_metrics(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add progress_percent, duration_seconds (to `as_of` while running) and records_per_second."""
    done = (F.col("processed_records") / F.nullif(F.col("total_records"), F.lit(0)) * 100).cast("int")
    end = F.coalesce(F.col("completed_at").cast("timestamp"), _now(as_of).cast("timestamp"))
    seconds = (F.unix_micros(end) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return df.withColumns(
        {
            "progress_percent": F.least(F.lit(100), F.coalesce(done, F.lit(0))),
            "duration_seconds": seconds,
        }
    ).withColumn(
        "records_per_second",
        F.when(F.col("duration_seconds") > 0, F.col("processed_records") / F.col("duration_seconds")),
    )


def expired_jobs(df: DataFrame, days: int = KEEP_RECORDS_DAYS, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(expired, kept): completed jobs that ended more than `days` ago, and all others."""
    old = (F.col("status") == COMPLETED) & (F.col("completed_at") < _now(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    old = F.coalesce(old, F.lit(False))
    return df.where(old), df.where(~old)


def expire_files(spark: SparkSession, jobs: DataFrame, root: str, days: int = KEEP_FILES_DAYS, as_of: Column | None = None) -> DataFrame:
    """Remove result folders `root`/job_id=<id> of completed jobs whose newest file is over `days` old; (job_id, files, bytes) of each.

    The folders are listed by Spark, by the time of their files. Folders of jobs that are pending, processing or failed, or that
    nothing is known of, stay, and so does a folder with a younger file, as when a job ran again. The removed ones are returned
    as a settled table; call it after the records are rewritten. A repeat finds nothing more and changes nothing.
    """
    make_folder(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    named = files.withColumn("job_id", F.regexp_extract("path", r"/job_id=([^/]+)/", 1)).where(F.col("job_id") != "")
    folders = named.groupBy("job_id").agg(F.max("modificationTime").alias("newest"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    done = jobs.where(F.col("status") == COMPLETED).select(F.col("job_id").cast("string").alias("job_id")).distinct()
    old = folders.where(F.col("newest") < _now(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")).join(done, "job_id", "left_semi")
    gone = settle(old.select("job_id", "files", "bytes"))
    remove_all(spark, (f"{root}/job_id={r.job_id}" for r in gone.select("job_id").toLocalIterator()))  # a name for each folder that goes
    return gone


def active_jobs(df: DataFrame) -> DataFrame:
    """Pending and processing jobs of each user that has any."""
    return df.where(F.col("status").isin(PENDING, PROCESSING)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("active_jobs")
    )


def log_run(df: DataFrame, path: str) -> None:
    """Append run rows to the run table."""
    df.write.mode("append").parquet(path)


def finish_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """`runs` with the columns that `results` has for their id, such as status, metrics and finished_at; null there changes nothing.

    `results` has one row per id. Write the outcome with `write_upsert`, or over the run table's next version.
    """
    new = [c for c in results.columns if c != "id"]
    joined = runs.alias("r").join(results.alias("n"), "id", "left")
    own = [F.coalesce(f"n.{c}", f"r.{c}").alias(c) if c in new else F.col(c if c == "id" else f"r.{c}") for c in runs.columns]
    return joined.select(*own, *(F.col(f"n.{c}") for c in new if c not in runs.columns))


def log_epoch(df: DataFrame, path: str) -> None:
    """Append epoch rows, with their run id, to the epoch table."""
    df.write.mode("append").parquet(path)


def run_history(df: DataFrame, n: int = 25) -> DataFrame:
    """The newest runs, with those of RUN_COLUMNS that the table has."""
    have = [c for c in RUN_COLUMNS if c in df.columns]
    order = [F.col(c).desc() for c in ("started_at", "id") if c in have]
    return df.select(*have).orderBy(*order).limit(n)


def epoch_series(df: DataFrame, run) -> DataFrame:
    """The epochs of one run in order, with those of EPOCH_COLUMNS that the table has."""
    have = [c for c in EPOCH_COLUMNS if c in df.columns]
    order = [c for c in ("epoch", "phase") if c in have]
    return df.where(F.col("training_run_id") == run).select(*have).orderBy(*order)
