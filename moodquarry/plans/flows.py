"""Whole jobs made of the operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.operators.prepare import SPLIT_70, dedup_text, stratified_split
from moodquarry.operators.scoring import analyze_table
from moodquarry.operators.screen import complete_rows
from moodquarry.operators.stats import batch_summary
from moodquarry.plans.scratch import new_folder
from moodquarry.sinks.files import write_result_csv, write_splits
from moodquarry.sources.files import read_csv, read_sample_tree, read_text_csv


def csv_to_parquet(spark: SparkSession, source: str, target: str, text_column: str = "text", line_breaks: bool = True) -> DataFrame:
    """Text, and sentiment, emotion and split if present, of a CSV as Parquet; without `line_breaks` in fields, many tasks read a file."""
    df = read_csv(spark, source, line_breaks)
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column!r} in {df.columns}")
    rest = [c for c in ("sentiment", "emotion", "split") if c in df.columns]
    df.select(F.col(text_column).alias("text"), *rest).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def score_csv(
    spark: SparkSession, source: str, target: str, lexicons: tuple[DataFrame, DataFrame], emotions: bool = True,
    line_breaks: bool = True, **options,
) -> DataFrame:
    """Score an uploaded CSV, write the result as CSV, and return the summary rows.

    The result is computed once: the summary reads what was written. Without `line_breaks` in fields, many tasks read a file.
    """
    df, text = read_text_csv(spark, source, line_breaks=line_breaks)
    write_result_csv(analyze_table(df, None, text, lexicons, emotions, **options), target)
    scored = read_csv(spark, target, line_breaks)
    numbers = [c for c in scored.columns if c.endswith("_Score") or c == "Emotion_Confidence"]
    return batch_summary(scored.withColumns({c: F.col(c).cast("double") for c in numbers}))


def prepare_dataset(spark: SparkSession, roots: list[str], target: str, rules: dict | None = None) -> DataFrame:
    """Merge sample trees, drop incomplete, short and repeated texts, split, write; returns the counts.

    The distinct samples are written once to the shared folder and read from there by the split,
    which passes over them more than once.
    """
    merged = read_sample_tree(spark, roots)
    labelled = complete_rows(merged, ["text", "sentiment"]).withColumns(
        {"sentiment": F.lower("sentiment"), "emotion": F.lower("emotion")}
    )
    # The files have no row number; the smallest row of equal texts is kept, whatever the file order.
    labelled = labelled.withColumn("_row", F.md5(F.to_json(F.struct("text", "sentiment", "emotion", "source"))))
    folder = new_folder(spark, "distinct")
    dedup_text(labelled, "_row", "text", algo="sha256").drop("_row").write.parquet(folder)
    distinct = spark.read.parquet(folder)
    return write_splits(stratified_split(distinct, "sentiment", "text_hash", **(rules or SPLIT_70)), target, merged)
