"""Quality of texts by how well dictionaries of good and of bad text compress them."""

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.language import held_out

DICTIONARY_BYTES = 112_640
LEVEL = 3
PIECE = 1024  # bytes compressed at a time, so that the dictionary tells as much in a long text as in a short one
SAMPLE_ROWS = 1000  # labelled rows of each class for the dictionaries, and as many others to calibrate
SAMPLE_CHARS = 1 << 15  # longer texts are not taken into the sample
THRESHOLD = 0.7


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(texts: list[str]) -> bytes:
    """A trained zstandard dictionary; of a few texts, which cannot be trained on, their raw content."""
    import zstandard

    samples = [p for t in texts for p in _pieces(t.encode("utf-8", "surrogatepass"))]
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@functools.lru_cache(maxsize=8)
def _compressor(data: bytes):
    import zstandard

    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False
    )


@dataclass
class Quality:
    """Dictionaries of good and bad text, and the line that turns the size difference into log odds."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def difference(self, text: str) -> float:
        """How many bytes the good dictionary saves against the bad one, per byte of text; 0 for the empty text."""
        data = text.encode("utf-8", "surrogatepass")
        if not data or not self.good or not self.bad:
            return 0.0
        good, bad = _compressor(self.good).compress, _compressor(self.bad).compress
        return sum(len(bad(p)) - len(good(p)) for p in _pieces(data)) / len(data)

    def score(self, texts: list[str]) -> np.ndarray:
        odds = self.slope * np.array([self.difference(t) for t in texts]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a slight pull to 0 that keeps separable samples finite."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        gradient = a.T @ (weight * (p - y)) + [1e-2 * w[0], 0]
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6]), gradient)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def learn_quality(
    df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS
) -> Quality:
    """A classifier from `labels` (id, label 1 or 0) and their texts in `df`.

    It is fitted on a bounded sample: of each class the first 2 * `sample_rows` ids by hash, texts of at most `sample_chars`, half of
    them for the dictionary and half to calibrate, where rows weigh as their class has among all labels. Null ids, labels and
    texts teach nothing. Without both classes every score is the share of good labels, or one half without any label.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).dropna().filter("label in (0, 1)")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    odds = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6)))
    if len(counts) < 2:
        return Quality(b"", b"", 0.0, odds)
    order = F.xxhash64("id")
    chosen = [known.filter(F.col("label") == v).withColumn("order", order).orderBy("order", "id").limit(2 * sample_rows) for v in (0, 1)]
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.length("text").between(1, sample_chars))
    got = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("order", "id", "label", "text").collect()
    got.sort()
    own = {v: [r.text for r in got if r.label == v] for v in (0, 1)}
    if min(map(len, own.values())) < 2:
        return Quality(b"", b"", 0.0, odds)
    model = Quality(dictionary(own[1][::2]), dictionary(own[0][::2]), 0.0, odds)
    x = {v: np.array([model.difference(t) for t in own[v][1::2]]) for v in own}
    y = np.concatenate([np.full(len(x[v]), v) for v in x])
    weight = np.concatenate([np.full(len(x[v]), counts[v] / len(x[v])) for v in x])
    model.slope, model.intercept = _logistic(np.concatenate(list(x.values())), y, weight * len(y) / weight.sum())
    return model


def quality_of(model: Quality, text: str | Column) -> Column:
    """The score of each whole text, from 0 to 1; null as the empty text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score([t or "" for t in texts]))

    return score(text)


def score_quality(df: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, **options) -> DataFrame:
    """(id, held_out, score, predicted) for each row, learned from the labels that are not held out.

    Held out is a quarter of the ids, by CRC-32. Equal texts get equal scores, empty and null texts the score of no difference.
    Columns beside the id and the text are not read. An empty table gives no row.
    """
    model = learn_quality(df, labels.filter(~held_out(id_col, 4, 2)), id_col, text, label, **options)
    out = df.select(F.col(id_col), held_out(id_col, 4, 2).alias("held_out"), quality_of(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
