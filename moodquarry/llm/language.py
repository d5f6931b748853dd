"""Language identification by hyperdimensional profiles of letter trigrams."""

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.tables import give_back, keep, small_batches, tidy

DIMENSIONS = 1024
MAX_LANGUAGES = 2000  # rows of the model, which the driver and every task hold
UNDETERMINED = "und"
_SCALE = 1 << 20  # a document's vector in integers, so that sums are exact in any order
_GROUP_CHARS = 1 << 19
_BOUND = 1 << 23  # components of bound triples, or of letters, that are held at once
SEEN_PART = 1000  # a unit is known to a language if one in so many of its documents has it
SEEN_BITS = 24  # of a unit's hash
_SYLLABLES = 0x2E80  # from here on a letter is an ideograph or a syllable


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=4096)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, or of a word's edge (0), the same everywhere."""
    return np.random.default_rng([code, dimensions]).integers(0, 2, dimensions, np.int8) * 2 - 1


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter triples and the text each comes from: lower-cased letters, and one 0 for what stands between words or at an edge."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts).lower() + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    text = np.cumsum(codes == 0)
    start = np.flatnonzero(~letter & np.append(True, letter[:-1]))  # runs of other characters
    end = np.append(np.flatnonzero(~letter & np.append(letter[1:], True)), [])[: len(start)].astype(np.int64)
    parts = text[end] > np.where(start > 0, text[start - 1], 0)  # a run that parts two texts gives two edges
    n = letter.astype(np.int64)
    n[start] = 1 + parts
    at = np.repeat(np.arange(len(codes)), n)
    symbol = np.where(letter, codes, 0)[at].astype(np.int64)
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    whole = ((a > 0) | (b > 0)) & ((b > 0) | (c > 0))
    source = np.where(b > 0, text[at[1:-1]], text[at[:-2]])[whole] - 1
    return np.stack([a[whole], b[whole], c[whole]], axis=1), source


def _trigram_parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`_trigrams` in parts of bounded size: a single long text goes slice by slice, each led by the last two symbols before it."""
    if len(texts) != 1 or len(texts[0]) <= _GROUP_CHARS:
        yield _trigrams(texts)
        return
    lowered, before = texts[0].replace("\0", " ").lower(), np.zeros(1, np.int64)
    for at in range(0, len(lowered) + 1, _GROUP_CHARS):
        codes = np.frombuffer((lowered[at : at + _GROUP_CHARS] + " " * (at + _GROUP_CHARS > len(lowered))).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        one = letter | np.append(before[-1] > 0, letter[:-1])  # of other characters, the first in a row
        symbol = np.concatenate([before, np.where(letter, codes, 0)[one].astype(np.int64)])
        a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
        whole = ((a > 0) | (b > 0)) & ((b > 0) | (c > 0))
        yield np.stack([a[whole], b[whole], c[whole]], axis=1), np.zeros(whole.sum(), np.int64)
        before = symbol[-2:]


def vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundle of each text: the sum, over its letter triples, of the product of the letters' vectors, each turned by its place."""
    return sum((_bundle(len(texts), *part, dimensions) for part in _trigram_parts(texts)), np.zeros((len(texts), dimensions), np.float32))


def _bundle(n: int, triples: np.ndarray, source: np.ndarray, dimensions: int) -> np.ndarray:
    """What these triples of `n` texts add to the texts' vectors."""
    seen = np.zeros(0x110000, bool)
    seen[triples.ravel()] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    small = number[triples]
    grams = (small[:, 0] * len(letters) + small[:, 1]) * len(letters) + small[:, 2]
    if len(letters) ** 3 <= 1 << 23:
        found = np.zeros(len(letters) ** 3, bool)
        found[grams] = True
        kinds = np.flatnonzero(found)
        place = np.zeros(len(found), np.int64)
        place[kinds] = np.arange(len(kinds))
        grams = place[grams]
    else:
        kinds, grams = np.unique(grams, return_inverse=True)
    out = np.zeros((n, dimensions), np.float32)
    if not len(kinds):
        return out
    own = np.stack([_letter_vector(int(c), dimensions) for c in letters])
    turned = [np.roll(own, k, axis=1) for k in (2, 1)] if own.size <= _BOUND else None
    x, y, z = kinds // len(letters) ** 2, kinds // len(letters) % len(letters), kinds % len(letters)
    step = max(1, min((1 << 22) // n, _BOUND // dimensions))
    for at in range(0, len(kinds), step):
        some = slice(at, at + step)
        first, second = (t[k[some]] if turned else np.roll(own[k[some]], n, axis=1) for t, k, n in zip(turned or "  ", (x, y), (2, 1)))
        bound = (first * second * own[z[some]]).astype(np.float32)
        here = (grams >= at) & (grams < at + step) if step < len(kinds) else slice(None)
        counts = np.bincount(source[here] * len(bound) + grams[here] - at, minlength=n * len(bound))
        out += counts.reshape(n, len(bound)).astype(np.float32) @ bound
    return out


def _units(triples: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit around each letter, as a hash of SEEN_BITS bits, and the text it comes from.

    A unit is the letter with its two neighbours. An ideograph or syllable is one by itself: texts of thousands of letters seldom
    share triples.
    """
    inner = triples[:, 1] > 0
    triples, source = triples[inner].astype(np.uint64), source[inner]
    beside = np.where(triples[:, 1] < _SYLLABLES, triples[:, 0] << np.uint64(42) | triples[:, 2], np.uint64((1 << 64) - (1 << 42)))
    unit = beside | triples[:, 1] << np.uint64(21)
    return (unit * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SEEN_BITS)).astype(np.int64), source


def _known_units(known: bytes, unit: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """How many units of each of `n` texts are known, and how many there are."""
    hit = np.frombuffer(known, np.uint8)[unit >> 3] >> (7 - (unit & 7)).astype(np.uint8) & 1
    return np.stack([np.bincount(source, hit, n), np.bincount(source, minlength=n)])


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > _GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


@dataclass
class Profiles:
    """Languages in order, and their prototypes: unit vectors of the sum of their documents' unit vectors."""

    languages: list[str]
    prototypes: np.ndarray
    dimensions: int

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language whose prototype has the largest cosine, the first of equal ones, and that cosine, or 0 if negative."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str], known: bytes | None = None) -> tuple[list[str], list[float], list[float]]:
        """`predict`, and the share of each text's units that are `known`: 0 for a text without a letter; none if not asked for."""
        names, scores, shares = [], [], []
        for group in _grouped(texts):
            whole, units = np.zeros((len(group), self.dimensions), np.float32), np.zeros((2, len(group)))
            for part in _trigram_parts(group):
                whole += _bundle(len(group), *part, self.dimensions)
                if known is not None:
                    units += _known_units(known, *_units(*part), len(group))
            if known is not None:
                shares.extend((units[0] / np.maximum(units[1], 1)).tolist())
            unit = _unit(whole)
            if not self.languages:
                names.extend([UNDETERMINED] * len(group))
                scores.extend([0.0] * len(group))
                continue
            cosines = unit @ self.prototypes.T
            best = cosines.argmax(axis=1)
            some = unit.any(axis=1)
            names.extend(self.languages[k] if s else UNDETERMINED for k, s in zip(best, some))
            scores.extend(np.where(some, np.clip(cosines.max(axis=1), 0, 1), 0).astype(float).tolist())
        return names, scores, shares


def learn_profiles(df: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from all rows with a text that has a letter and a language; each document counts alike, whatever its length.

    A task adds up its documents by language; the sums are added in two steps, and only the model, a row for each language,
    comes to the driver. No such row gives a model that knows no language.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "text"):
            labels, at = np.array(batch.column("lang").to_pylist(), object), 0
            for group in _grouped(batch.column("text").to_pylist()):
                whole = np.rint(_unit(vectors(group, dimensions)) * _SCALE).astype(np.int64)
                own, at = labels[at : at + len(group)], at + len(group)
                for name in set(own):
                    sums[name] = sums.get(name, 0) + whole[own == name].sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))}
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return group.head(1).assign(v=[np.sum(np.stack(group["v"].to_numpy()), axis=0)])

    parts = rows.mapInArrow(tidy(bundle), "lang string, v array<bigint>").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(64)))
    some = parts.groupBy("lang", "part").applyInPandas(add, "lang string, v array<bigint>, part bigint")
    sums = some.groupBy("lang").applyInPandas(add, "lang string, v array<bigint>, part bigint").drop("part")
    got = sorted((r for r in sums.limit(MAX_LANGUAGES + 1).collect() if any(r.v)), key=lambda r: r.lang)
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    prototypes = _unit(np.array([r.v for r in got], np.float64).reshape(len(got), dimensions)).astype(np.float32)
    return Profiles([r.lang for r in got], prototypes, dimensions)


def language_of(profiles: Profiles, text: str | Column) -> Column:
    """struct(lang_pred, score) of each whole text: `und` and 0 for null and for a text without a letter."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = profiles.predict([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        give_back()

    return predict(text)


def learn_seen(df: DataFrame, text: str, lang: str) -> bytes:
    """A bit for each hash of a unit: whether one in SEEN_PART documents of some language has it, so one of fewer documents.

    All rows with a text and a language count. Only hashes come to the driver; there are no more than bits. Units that share a hash
    are known together.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        parts, size = [], 0

        def added() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            known = np.array(list(names), object)[codes >> (SEEN_BITS + 1)]
            unit = codes & ((2 << SEEN_BITS) - 1)
            return pa.RecordBatch.from_pydict({"lang": pa.array(known, pa.string()), "unit": pa.array(unit), "n": pa.array(n, pa.int64())})

        for batch in small_batches(batches, "text"):
            labels, at = batch.column("lang").to_pylist(), 0
            for group in _grouped(batch.column("text").to_pylist()):
                own = np.array([names.setdefault(x, len(names)) for x in labels[at : at + len(group)]], np.int64)
                at += len(group)
                once = np.unique(np.concatenate([np.unique(source << SEEN_BITS | unit) for unit, source in (_units(*part) for part in _trigram_parts(group))]))
                documents = own[np.unique(once >> SEEN_BITS)] << (SEEN_BITS + 1) | 1 << SEEN_BITS
                parts += [own[once >> SEEN_BITS] << (SEEN_BITS + 1) | once & ((1 << SEEN_BITS) - 1), documents]
                size += len(once) + len(documents)
                if size > _GROUP_CHARS:
                    yield added()
                    parts, size = [], 0
        if parts:
            yield added()

    counts = keep(rows.mapInArrow(tidy(count), "lang string, unit bigint, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n")), "seen")
    documents = counts.filter(F.col("unit") == 1 << SEEN_BITS).select("lang", F.col("n").alias("documents"))
    common = counts.filter(F.col("unit") < 1 << SEEN_BITS).join(F.broadcast(documents), "lang").filter(F.col("n") * SEEN_PART >= F.col("documents"))
    known = np.zeros(1 << SEEN_BITS, bool)
    known[common.select("unit").distinct().toPandas()["unit"].to_numpy(np.int64)] = True
    return np.packbits(known).tobytes()


def language_and_share(profiles: Profiles, known: bytes, text: str | Column) -> Column:
    """`language_of` with `seen`, the share of each whole text's units that are known; both in one pass over the letters."""

    @F.pandas_udf("lang_pred string, score double, seen double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, shares = profiles.judge([t or "" for t in texts], known)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "seen": shares})
        give_back()

    return judge(text)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves `part` when divided by `parts`; a null id is as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def predict_languages(df: DataFrame, id_col: str, text: str, lang: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row, learned from the rows that are not held out.

    Held out is a third of the ids, by CRC-32. Null languages teach nothing. Equal rows get equal answers; columns beside the id,
    the text and, to learn, the language are not read. An empty table gives no row.
    """
    out = held_out(id_col, 3, 1)
    profiles = learn_profiles(df.filter(~out), text, lang, dimensions)
    found = df.select(F.col(id_col), out.alias("held_out"), language_of(profiles, F.col(text)).alias("found_"))
    return found.select(id_col, "held_out", "found_.*")
