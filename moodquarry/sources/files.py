"""Files as tables: CSV uploads, datasets by suffix, trees of Parquet samples."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.sources.schemas import SAMPLE_COLUMNS

# Fixed value: names of a text column, best first; upper and lower case differ.
TEXT_COLUMNS = [
    "text", "Text", "content", "Content", "message", "Message", "review", "Review", "comment", "Comment",
]


def find_text_column(columns: list[str]) -> str | None:
    return next((name for name in TEXT_COLUMNS if name in columns), None)


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV with a header and doubled quotes; all columns are text.

    With `line_breaks` quoted fields may hold line breaks, and a file is read by one task. Without
    them a large file is split over many.
    """
    return spark.read.csv(path, header=True, multiLine=line_breaks, quote='"', escape='"')


def read_text_csv(
    spark: SparkSession, path: str, text_column: str | None = None, line_breaks: bool = True
) -> tuple[DataFrame, str]:
    """The table and the name of its text column; null text becomes ''."""
    df = read_csv(spark, path, line_breaks)
    name = text_column or find_text_column(df.columns)
    if name not in df.columns:
        raise ValueError(f"no text column in {df.columns}")
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(""))), name


def read_dataset(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A dataset by its suffix; `line_breaks` is that of `read_csv`."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return read_csv(spark, path, line_breaks)
    if suffix in (".json", ".jsonl"):
        return spark.read.json(path)
    raise ValueError(f"unsupported dataset format: {path}")


def read_sample_tree(spark: SparkSession, roots: list[str], default_source: str | None = "static") -> DataFrame:
    """All Parquet files under `roots` with the columns text, sentiment, emotion and source.

    Missing columns are null; a missing source is `default_source`, or the root's name if None.
    """
    parts = []
    for root in roots:
        df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(root)
        source = default_source or os.path.basename(root.rstrip("/"))
        for name in SAMPLE_COLUMNS:
            if name not in df.columns:
                df = df.withColumn(name, F.lit(source if name == "source" else None).cast("string"))
        parts.append(df.select(*SAMPLE_COLUMNS))
    if not parts:
        raise ValueError("no roots given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_listing(df: DataFrame) -> DataFrame:
    """Rows and bytes of each file behind a file-based table."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def count_by_directory(df: DataFrame) -> DataFrame:
    """Files, rows and bytes of each directory behind a file-based table."""
    directory = F.regexp_replace("file_path", F.lit("/[^/]*$"), F.lit(""))
    return file_listing(df).groupBy(directory.alias("directory")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("file_size").alias("n_bytes")
    )
