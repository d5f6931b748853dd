"""Session settings and the shared checkpoint folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE merges small shuffle partitions and splits skewed ones at run time, so the
# initial number can be generous on a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.ui.enabled": "false",
}


def build_session(master: str, name: str = "moodquarry", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    A machine-local folder is used only in local mode, where driver and executors
    share one disk; elsewhere a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="moodquarry-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it in the shared folder, so later uses survive lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    # Shuffles of what was settled before are read no more; Spark removes them from the disks once the driver's JVM has collected their plans.
    spark.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)
