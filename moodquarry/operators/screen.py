"""Checks that accept, reject or report rows, batches and files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.functions.text import SPACES, TAG_PATTERN, strip
from moodquarry.sources.files import TEXT_COLUMNS, find_text_column

# Limits and the patterns that make a text suspicious.
MAX_TEXT = 5000
MAX_BATCH = 1000
MAX_ROWS = 100_000
MAX_BYTES = 100 * 1024 * 1024
SUSPICIOUS = [
    r"<script",
    r"javascript:",
    rf"on[\p{{L}}\p{{N}}_]+[{SPACES}]*=",
    rf"eval[{SPACES}]*\(",
    r"document\.",
    r"window\.",
    r"location\.",
]


def min_length(df: DataFrame, text: str, min_len: int = 4) -> DataFrame:
    """Rows whose trimmed text has at least `min_len` characters."""
    return df.where(F.length(strip(text)) >= min_len)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def screen_text(df: DataFrame, text: str, max_len: int | None = None) -> DataFrame:
    """Add valid, reason (null if valid) and clean (the text without tags, null if not valid)."""
    kept = df.columns
    df = df.withColumn("_t", strip(text))
    df = df.withColumn("_c", strip(F.regexp_replace("_t", F.lit(TAG_PATTERN), F.lit(""))))
    reason = F.when(F.col(text).isNull() | (F.col(text) == ""), "missing").when(F.col("_t") == "", "blank")
    if max_len is not None:
        reason = reason.when(F.length("_t") > max_len, "too long")
    reason = reason.when(F.col("_c").rlike("(?i)" + "|".join(f"(?:{p})" for p in SUSPICIOUS)), "suspicious")
    return df.withColumn("reason", reason).select(
        *kept,
        F.col("reason").isNull().alias("valid"),
        "reason",
        F.when(F.col("reason").isNull(), F.col("_c")).alias("clean"),
    )


def screen_batch(
    df: DataFrame, batch: str, position: str, text: str, max_texts: int | None = None, max_len: int | None = None
) -> DataFrame:
    """One row per batch: its size, whether it is valid, and the first reason and position if not. Limits of None are off."""
    found = screen_text(df, text, max_len).groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.min(F.when(~F.col("valid"), F.struct(F.col(position).alias("at"), "reason"))).alias("_bad"),
    )
    large = F.lit(False) if max_texts is None else F.col("n_texts") > max_texts
    return found.select(
        batch,
        "n_texts",
        (~large & F.col("_bad").isNull()).alias("valid"),
        F.when(large, "too many texts").otherwise(F.col("_bad.reason")).alias("reason"),
        F.when(~large, F.col("_bad.at")).alias("bad_position"),
    )


def validate_dataset(
    df: DataFrame, name: str, size_bytes: int | None = None, max_rows: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """One row: valid, reason, row_count, text_column and columns of an upload read as a table.

    Limits are off unless they are given; MAX_ROWS and MAX_BYTES are those of an upload.
    """
    column = find_text_column(df.columns)
    checks = [
        (F.lit(not name.lower().endswith(".csv")), "not a CSV file"),
        (F.lit(max_bytes is not None and size_bytes is not None and size_bytes > (max_bytes or 0)), "file too large"),
        (F.lit(size_bytes == 0), "file is empty"),
        (F.col("row_count") == 0, "no data"),
        (F.lit(column is None), "no text column, expected one of " + ", ".join(TEXT_COLUMNS)),
    ]
    if max_rows is not None:
        checks.append((F.col("row_count") > max_rows, "too many rows"))
    reason = F.coalesce(*[F.when(test, F.lit(text)) for test, text in checks])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        reason.isNull().alias("valid"),
        reason.alias("reason"),
        "row_count",
        F.lit(column).cast("string").alias("text_column"),
        F.lit(",".join(df.columns)).alias("columns"),
    )
