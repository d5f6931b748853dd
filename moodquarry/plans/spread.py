"""Even work for inputs that come in a few large pieces."""

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores if the input has fewer pieces than cores.

    Meant before costly work per row. A large table has far more pieces than there are cores, and
    is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
