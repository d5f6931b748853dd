"""Label domains and label expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label domains, score bounds and label tables.
SENTIMENTS = ["positive", "negative", "neutral"]
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
POSITIVE_FROM = 0.05
NEGATIVE_TO = -0.05
SENTIMENT_CODES = {"0": "negative", "1": "neutral", "2": "positive", "4": "positive"}
EMOTION_CODES = {0: "sadness", 1: "joy", 2: "joy", 3: "anger", 4: "fear", 5: "surprise"}
SENTIMENT_OF_EMOTION = {
    "joy": "positive",
    "love": "positive",
    "surprise": "neutral",
    "trust": "positive",
    "neutral": "neutral",
    "anticipation": "positive",
    "sadness": "negative",
    "anger": "negative",
    "disgust": "negative",
    "fear": "negative",
}


def compound_to_label(c: Column, pos: float = POSITIVE_FROM, neg: float = NEGATIVE_TO) -> Column:
    """Both bounds are inclusive."""
    return F.when(c >= pos, "positive").when(c <= neg, "negative").otherwise("neutral")


def map_values(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Replace the values named in `mapping`; anything else becomes `default` (null if not given)."""
    out = None
    for value, label in mapping.items():
        test = c == F.lit(value)
        out = F.when(test, label) if out is None else out.when(test, label)
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out


def within(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(default)
