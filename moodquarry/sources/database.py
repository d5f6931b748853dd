"""Tables in a database over JDBC. Secrets come only from the caller's properties."""

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, props: dict[str, str], partition: dict | None = None) -> dict[str, str]:
    """Reader or writer options; `partition` has column, lower, upper and count, all or none."""
    options = {"url": url, "dbtable": table, **props}
    if partition:
        missing = {"column", "lower", "upper", "count"} - set(partition)
        if missing:
            raise ValueError(f"partition lacks {sorted(missing)}")
        options |= {
            "partitionColumn": str(partition["column"]),
            "lowerBound": str(partition["lower"]),
            "upperBound": str(partition["upper"]),
            "numPartitions": str(partition["count"]),
        }
    return options


def read_jdbc(
    spark: SparkSession, url: str, table: str, props: dict[str, str], partition: dict | None = None
) -> DataFrame:
    """Without `partition` the whole table is read by one task, so give it for any large table."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, props, partition)).load()


def write_jdbc(df: DataFrame, url: str, table: str, props: dict[str, str], mode: str = "append") -> None:
    df.write.format("jdbc").options(**jdbc_options(url, table, props)).mode(mode).save()
