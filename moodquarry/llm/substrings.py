"""Repeated word passages by locally consistent recompression."""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.tables import joined_words, keep, numbered_words, small_batches, tidy

WINDOW = 50
ROUNDS = 3

_LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(words: Iterable[bytes], lane: int | None = None) -> np.ndarray:
    """A 128-bit hash of each word in two lanes, or one of them."""
    lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return lanes if lane is None else lanes[:, lane]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs, from the names of their halves; the same on every executor."""
    return _mixed(_mixed(a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + b)


def edge(rounds: int = ROUNDS) -> int:
    """How many words from a passage's ends its symbols may differ between two texts: one for runs, then 1, 2, 4, ... a round."""
    return 1 << rounds


def parse(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """For each word the key of the symbol that starts there, or the largest number; `first` marks where a text begins.

    Runs of an equal word become one symbol, named by the word alone, which takes part in no pair; each of its words has its key.
    Then in each round every symbol gets a side by its name, and a left one followed by a right one becomes a pair, named by both. A
    decision looks at the next symbols only, so in equal passages all symbols are equal but for `edge` words at the ends, and
    none but a run is longer than 2 ** rounds words. A key sorts longer symbols first, for they tell more, and runs last.
    """
    n = len(words)
    same = np.zeros(n + 1, bool)
    same[1:n] = (words[1:] == words[:-1]) & ~first[1:]
    in_run = same[:n] | same[1:]
    start = np.flatnonzero(~same[:n])
    run = in_run[start]
    name = np.where(run, _joined(words[start], np.uint64(0)), _mixed(words[start]))
    for k in range(rounds):
        left = (_mixed(name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name) + 1, bool)  # at the right half
        pair[1 : len(name)] = left[:-1] & ~left[1:] & ~run[:-1] & ~run[1:] & ~first[start[1:]]
        head = np.flatnonzero(pair[1:])
        name[head] = _joined(name[head], name[head + 1])
        stay = ~pair[: len(name)]
        name, start, run = name[stay], start[stay], run[stay]
    length = np.diff(np.append(start, n))
    rank = np.where(run, (1 << rounds) + 1, (1 << rounds) - np.minimum(length, 1 << rounds)).astype(np.uint64)
    bits = np.uint64(rounds + 2)
    key = (rank << (np.uint64(64) - bits)) | (name >> bits)
    keys = np.full(n, _LARGEST)
    keys[start] = key
    of = np.searchsorted(start, np.flatnonzero(in_run), side="right") - 1
    keys[in_run] = key[of]
    return keys


def window_keys(words: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """For each place the smallest key of a symbol that is surely equal in all texts that have the window beginning there.

    Such symbols begin and end at least `edge` words from the window's ends. Places without a whole window in the batch are
    left out; windows that reach into the next text mean nothing.
    """
    margin, longest = edge(rounds), 1 << rounds
    width = window - 2 * margin - longest + 1
    low = parse(words, first, rounds)[margin:]
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return low[: max(0, len(words) - window + 1)]


@dataclass
class _Batch:
    """The words of some texts after one another, as numbers and as hashes of two lanes; where each text begins and the last ends."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: pa.Array
    lanes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "_Batch":
        codes, offsets, distinct = numbered_words(texts)
        first = np.zeros(len(codes), bool)
        begins = offsets[:-1]
        first[begins[begins < len(codes)]] = True
        return cls(codes, offsets, distinct, word_hashes(distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return self.lanes[:, lane][self.codes]

    def whole(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a whole window begins, and the text of each."""
        counts = np.maximum(np.diff(self.offsets) - window + 1, 0)
        of = np.repeat(np.arange(len(counts)), counts)
        return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.offsets[of], of

    def joined(self, stay: np.ndarray | None = None) -> pa.Array:
        """The words of each text, or those that stay, joined by one space."""
        if stay is None:
            return joined_words(self.codes, self.offsets, self.distinct)
        return joined_words(self.codes[stay], np.concatenate([[0], np.cumsum(stay)])[self.offsets], self.distinct)


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of `n` rows; `of` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def symbols(rows: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """`rows` (id, mark, text) as (id, mark, n_words, sha, keys): the distinct high-level symbols that stand for its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            some = _Batch.of([t or "" for t in batch.column("text").to_pylist()])
            at, of = some.whole(window)
            keys = window_keys(some.hashes(), some.first, window, rounds)[at]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            keys, of = keys[new], of[new]
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("mark"), pa.array(np.diff(some.offsets), pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in some.joined().cast(pa.binary()).to_numpy(zero_copy_only=False)], pa.string()),
                    _lists(keys[new].view(np.int64), of[new], batch.num_rows, pa.int64()),
                ],
                ["id", "mark", "n_words", "sha", "keys"],
            )

    return rows.mapInArrow(tidy(run), "id bigint, mark bigint, n_words bigint, sha string, keys array<bigint>")


def _window_hashes(words: np.ndarray, at: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Multilinear hashes of the windows that begin at `at`."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, window, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for i, factor in enumerate(factors):
        out += words[at + i] * factor
    return _mixed(out)


def candidate_windows(rows: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(no, id, at, h1, h2) for each window of `rows` (no, id, text, shared) whose symbol is among the row's shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            some = _Batch.of(batch.column("text").to_pylist())
            at, of = some.whole(window)
            words = some.hashes()
            keys = window_keys(words, some.first, window, rounds)[at].view(np.int64)
            shared = batch.column("shared").to_pylist()
            hit = np.zeros(len(at), bool)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                hit[a:b] = np.isin(keys[a:b], shared[i])
            at, of = at[hit], of[hit]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("no").take(pa.array(of)), batch.column("id").take(pa.array(of)),
                    pa.array(at - some.offsets[of], pa.int32()),
                    pa.array(_window_hashes(words, at, window, 1).view(np.int64)), pa.array(_window_hashes(some.hashes(1), at, window, 2).view(np.int64)),
                ],
                ["no", "id", "at", "h1", "h2"],
            )

    return rows.mapInArrow(tidy(run), "no bigint, id bigint, at int, h1 bigint, h2 bigint")


def cut(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, mark, kept): the words of `rows` (id, mark, text, at) outside the windows that begin at `at`, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            some, places = _Batch.of(batch.column("text").to_pylist()), batch.column("at")
            at = places.flatten().to_numpy() + np.repeat(some.offsets[:-1], pc.list_value_length(places).to_numpy())
            change = np.bincount(at, minlength=len(some.codes) + 1) - np.bincount(at + window, minlength=len(some.codes) + 1)
            kept = some.joined(np.cumsum(change)[:-1] == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), kept], ["id", "mark", "kept"])

    return rows.mapInArrow(tidy(run), "id bigint, mark bigint, kept string")


def _marked(df: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def find_repeats(rows: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """From `rows` (id, mark, text): (id, mark, n_words, sha, least) of each, and (id, mark, kept) of those with repeated windows.

    `least` is the smallest id with the same words; a text that is not its own class's first needs no search. Of the first ones, all
    symbols that stand for a window meet by name, and those of two ids or more reveal where a repeat may be. Only the windows
    under such symbols are then hashed whole, with 128 bits, and meet by hash: that verifies them. `kept` is what a row keeps
    beside the windows that a smaller id has, too. A hot symbol, window or class is pre-aggregated and its joins read written
    tables, so Spark can split them. Windows are made anew for their second use, as that takes less room than to write them.
    """
    every = symbols(rows.select("id", "mark", "text"), window, rounds).withColumn("row", F.monotonically_increasing_id())
    every = keep(every, "symbols")
    classes = keep(every.groupBy("sha").agg(F.min("id").alias("least")), "classes")
    info = keep(every.drop("keys", "row").join(classes, "sha"), "texts")
    firsts = every.join(classes, "sha").filter("id = least").select("row", "id", F.explode("keys").alias("key"))
    anchors = keep(firsts, "anchors")
    common = anchors.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    hits = anchors.select("row", "key").join(keep(common, "shared_symbols"), "key")
    shared = hits.groupBy("row").agg(F.collect_set("key").alias("shared"))
    shared = keep(shared.join(every.select("row", "id", "mark"), "row").drop("row").dropDuplicates(["id", "mark"]), "shared")
    some = keep(rows.join(shared, ["id", "mark"]).withColumn("no", F.monotonically_increasing_id()), "suspects")
    found = candidate_windows(some.select("no", "id", "text", "shared"), window, rounds)
    least = found.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    later = found.join(keep(least, "repeated_windows"), ["h1", "h2"]).filter("id > lo")
    later = keep(later.groupBy("no").agg(F.sort_array(F.collect_set("at")).alias("at")), "places")
    part = cut(some.join(later, "no").select("id", "mark", "text", "at"), window)
    return info, keep(part.dropDuplicates(["id", "mark"]), "cut_texts")


def drop_repeats(df: DataFrame, id_col: str, text: str, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row, without the words of windows that a smaller id has, too.

    A window is `window` consecutive words, as they are, between ASCII white space; all are judged on the input. Null and wordless
    texts have no word, and texts shorter than a window lose none. Rows of one id never remove each other's words; rows with a
    null id neither remove nor lose any. Equal rows give equal rows. Other columns are not read; an empty table gives no row.
    """
    rows = _marked(df, id_col, text)
    info, part = find_repeats(rows, window, rounds)
    gone = (F.col("id") > F.col("least")) & (F.col("n_words") >= window)
    left = F.when(gone, F.lit("")).otherwise(F.col("kept"))
    n_left = F.when(left.isNull(), F.col("n_words")).when(left == "", 0).otherwise(F.size(F.split(left, " ")))
    return info.join(part, ["id", "mark"], "left").select(
        F.col("id").alias(id_col), "n_words", (F.col("n_words") - n_left).cast("bigint").alias("n_removed"),
        F.coalesce(F.sha2(left, 256), F.col("sha")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, id_col: str, text: str, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """`df` with the same columns, its texts without repeated passages, by the rules of `drop_repeats`.

    A text that loses words becomes the kept ones, joined by one space; one that loses them all goes with its row. All other texts stay
    as they are, to the last space.
    """
    rows = _marked(df, id_col, text)
    info, part = find_repeats(rows, window, rounds)
    whole = info.filter((F.col("id") > F.col("least")) & (F.col("n_words") >= window)).select("id", "mark", F.lit("").alias("kept_"))
    changed = keep(whole.unionByName(part.withColumnRenamed("kept", "kept_")).dropDuplicates(["id", "mark"]), "changed")
    key = changed.toDF("id_", "mark_", "kept_")
    same = (df[id_col] == key["id_"]) & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == key["mark_"])
    kept = df.join(key, same, "left").filter(key["kept_"].isNull() | (key["kept_"] != ""))
    return kept.select(*(F.coalesce(key["kept_"], df[c]).alias(c) if c == text else df[c] for c in df.columns))
