"""Analysis records: from a score result to a row, and from a row to what is shown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.functions.text import text_length, word_count


def iso_time(c: Column) -> Column:
    """ISO text of a timestamp; the fraction only if there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def scores_json(scores: Column) -> Column:
    """A score map as JSON."""
    return F.to_json(scores)


def analysis_record(df: DataFrame, text: str, result: str, source: str = "web") -> DataFrame:
    """Flatten the struct column `result` into analysis columns, with defaults for what it lacks.

    `result` may have sentiment, compound_score, scores (pos, neg, neu), primary_emotion,
    emotion_scores, confidence and processing_time_ms.
    """
    kind = df.schema[result].dataType
    fields = set(kind.names)
    inner = set(kind["scores"].dataType.names) if "scores" in fields else set()

    def of(name: str, default=None) -> Column:
        value = F.col(f"{result}.{name}") if name in fields else F.lit(None)
        return value if default is None else F.coalesce(value, F.lit(default))

    def score(name: str) -> Column:
        value = F.col(f"{result}.scores.{name}") if name in inner else F.lit(None).cast("double")
        return F.coalesce(value, F.lit(0.0))

    return df.select(
        *[c for c in df.columns if c not in (text, result)],
        F.col(text).alias("input_text"),
        F.lit(source).alias("source"),
        of("sentiment", "neutral").alias("sentiment"),
        of("compound_score", 0.0).alias("compound_score"),
        score("pos").alias("positive_score"),
        score("neg").alias("negative_score"),
        score("neu").alias("neutral_score"),
        of("primary_emotion").cast("string").alias("primary_emotion"),
        *([of("emotion_scores").alias("emotion_scores")] if "emotion_scores" in fields else []),
        of("confidence").cast("double").alias("confidence"),
        of("processing_time_ms", 0).cast("int").alias("processing_time_ms"),
        text_length(text).alias("text_length"),
        word_count(text).alias("word_count"),
    )


def analysis_view(df: DataFrame, include_text: bool = True) -> DataFrame:
    """Analysis rows as shown: scores rounded to 4 and grouped, time as ISO text."""
    return df.select(
        "id", "user_id", "source", "sentiment",
        F.round("compound_score", 4).alias("compound_score"),
        F.struct(
            F.round("positive_score", 4).alias("positive"),
            F.round("negative_score", 4).alias("negative"),
            F.round("neutral_score", 4).alias("neutral"),
            F.round("compound_score", 4).alias("compound"),
        ).alias("scores"),
        "primary_emotion",
        *(["emotion_scores"] if "emotion_scores" in df.columns else []),
        F.round("confidence", 4).alias("confidence"),
        "processing_time_ms", "text_length", "word_count",
        iso_time(F.col("created_at")).alias("created_at"),
        *(["input_text"] if include_text else []),
    )
