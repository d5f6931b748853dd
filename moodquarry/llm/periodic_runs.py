"""Runs of words that repeat with a period, caught online by their squares."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.tables import joined_words, numbered_words, small_batches, tidy

LEAST = 24  # words of a run at least
EXPONENT = 3  # periods of a run at least

_FIRST = 3  # log2 of the smallest block
_STEP = 1 << 18  # suffixes that are compared at once
_BASE = 0x9E3779B97F4A7C15


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ends(spans: list[tuple[int, int]], old: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ends after `old` of suffixes of at least `least` words within the spans, a part at a time, and where their spans begin."""
    begin, last = np.array(spans, np.int64).reshape(-1, 2).T
    first = np.maximum(old, begin + least - 1) + 1
    size = np.maximum(last + 1 - first, 0)
    upto = np.cumsum(size)
    for at in range(0, int(upto[-1]) if len(upto) else 0, _STEP):
        low, high = np.clip(at - upto + size, 0, size), np.clip(at + _STEP - upto + size, 0, size)
        n = high - low
        some = np.flatnonzero(n)
        n = n[some]
        before = np.cumsum(n) - n
        yield np.repeat((first + low)[some] - before, n) + np.arange(n.sum()), np.repeat(begin[some], n)


class SquareCatcher:
    """Finds all runs of a growing sequence of word numbers: stretches of `least` words and `exponent` (3 or more) periods at least.

    The sequence is cut into completed blocks of every power of two, 8 at least. A block of size B is a catcher of periods from B
    to 2B, the smallest one of all periods below 16. With each appended word, on each level, the suffix as long as a block is
    compared to the one block (two on the smallest level) that lies such a period before it. A run of 3 periods holds a whole block that its period
    repeats, so no run can be missed. Hashes of prefixes compare in one step, and all words of one `append` are
    compared together. Where a block comes again, words are compared one by one, back and forth, until the period breaks: that is the
    square's whole stretch. Stretches at the end stay open and go on with the next words. Squares of one stretch merge, and
    a stretch found with several periods has the smallest.

    Blocks within a stretch of short period recur many times. Against another such stretch only shifts that bring the two stretches'
    starts or ends together can belong to a run, so no other one is looked at.
    """

    def __init__(self, least: int = LEAST, exponent: int = EXPONENT):
        self.least, self.exponent = least, exponent
        self.n = 0
        self.words, self.prefix, self.powers = np.empty(0, np.int64), np.zeros(1, np.uint64), np.ones(1, np.uint64)
        self.periods: dict[tuple[int, int], int] = {}  # of closed stretches
        self.open: dict[int, int] = {}  # period and start of stretches that reach the end
        self.opened: dict[int, list[tuple[int, int]]] = {}

    def append(self, words: np.ndarray, spans: list[tuple[int, int]] | None = None) -> None:
        """Take the next words. `spans` are parts of the whole sequence, as begin and end, outside and across which no run can be."""
        old, new = self.n, self.n + len(words)
        self._grow(np.asarray(words, np.int64))
        self.n = new
        for period, start in list(self.open.items()):
            end = self._right(old - period, period)
            if end < new:
                del self.open[period]
                self._close(start, end, period)
        level, spans = _FIRST, [(0, new)] if spans is None else spans
        while spans := [(a, b) for a, b in spans if b - a >= max(self.least, 3 << level)]:
            self._level(level, old, spans)
            level += 1

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of all words so far, by start and period."""
        known = dict(self.periods)
        for period, start in self.open.items():
            known[start, self.n] = min(period, known.get((start, self.n), period))
        found = ((a, b - a, p) for (a, b), p in known.items())
        return sorted((a, n, p) for a, n, p in found if n >= max(self.least, self.exponent * p))

    def _grow(self, words: np.ndarray) -> None:
        need = self.n + len(words)
        if need > len(self.words):
            room = max(need, 2 * len(self.words)) if self.n else need
            for name, extra in (("words", 0), ("prefix", 1), ("powers", 1)):
                old = getattr(self, name)
                array = np.empty(room + extra, old.dtype)
                array[: self.n + extra] = old[: self.n + extra]
                setattr(self, name, array)
        a, b = self.n, need
        self.words[a:b] = words
        if b > a:
            steps = np.full(b - a, _BASE, np.uint64)
            steps[:1] *= self.powers[a : a + 1]
            self.powers[a + 1 : b + 1] = np.cumprod(steps)
            weighted = _mixed(words.view(np.uint64)) * self.powers[a:b]
            weighted[:1] += self.prefix[a : a + 1]
            self.prefix[a + 1 : b + 1] = np.cumsum(weighted)

    def _close(self, start: int, end: int, period: int) -> None:
        self.periods[start, end] = min(period, self.periods.get((start, end), period))

    def _right(self, at: int, period: int) -> int:
        """The end of the stretch with the period from `at` on: the first place whose word is not that of a period before."""
        at, step = max(at, 0), 64
        words, n = self.words, self.n
        while at + period < n:
            size = min(step, n - at - period)
            differ = words[at : at + size] != words[at + period : at + period + size]
            k = int(differ.argmax())
            if differ[k]:
                return at + k + period
            at, step = at + size, step * 2
        return n

    def _left(self, at: int, period: int) -> int:
        """The start of the stretch with the period that holds `at`."""
        step, words = 64, self.words
        while at > 0:
            size = min(step, at)
            differ = (words[at - size : at] != words[at - size + period : at + period])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                return at - k
            at, step = at - size, step * 2
        return 0

    def _level(self, level: int, old: int, spans: list[tuple[int, int]]) -> None:
        size = 1 << level
        starts, shifts = [], []
        least = size + 1 if level == _FIRST else 2 * size
        for end, begin in _ends(spans, old, least):
            if level == _FIRST:
                block = (end - size - 1) // size * size
                pairs = [(end, block), (end, block - size)]
            else:
                pairs = [(end, (end - 2 * size) // size * size)]
            for e, s in pairs:
                shift = e - size - s
                good = (s >= begin) & (shift < 2 * size)
                if not good.all():
                    e, s, shift = e[good], s[good], shift[good]
                same = (self.prefix[s + size] - self.prefix[s]) * self.powers[shift] == self.prefix[e] - self.prefix[e - size]
                starts.append(s[same])
                shifts.append(shift[same])
        if starts:
            self._verify(np.concatenate(starts), np.concatenate(shifts), size)

    def _stretch_of(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which known stretch of a third of `size` as period at most holds the block at each place (-1: none); all starts and ends."""
        known = {**self.periods, **{(a, self.n): p for p, a in self.open.items()}}
        some = sorted((a, b) for (a, b), p in known.items() if 3 * p <= size <= b - a)
        if not some:
            return np.full(len(at), -1), np.empty(0, np.int64), np.empty(0, np.int64)
        begin, end = np.array(some).T
        of = np.searchsorted(begin, at, side="right") - 1
        return np.where((of >= 0) & (at + size <= end[of]), of, -1), begin, end

    def _verify(self, starts: np.ndarray, shifts: np.ndarray, size: int) -> None:
        if size >= max(self.least, 32) and len(starts):
            here, begin, end = self._stretch_of(starts, size)
            there = self._stretch_of(starts + shifts, size)[0]
            if len(begin):
                both = (here >= 0) & (there >= 0)
                aligned = (begin[there] - begin[here] == shifts) | (end[there] - end[here] == shifts) | (end[there] == self.n)
                keep = ~both | ((here != there) & aligned)
                starts, shifts = starts[keep], shifts[keep]
        order = np.lexsort((starts, shifts))
        starts, shifts = starts[order], shifts[order]
        edges = np.flatnonzero(np.diff(shifts, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(shifts)]):
            period = int(shifts[a])
            while a < b:
                start = int(starts[a])
                if period in self.open and self.open[period] <= start:
                    break
                if not np.array_equal(self.words[start : start + size], self.words[start + period : start + period + size]):
                    a += 1  # only the hashes agree
                    continue
                left, right = self._left(start, period), self._right(start + size, period)
                if right == self.n:
                    self.open[period] = left
                    break
                self._close(left, right, period)
                a += int(np.searchsorted(starts[a:b], right - period - size, side="right"))


def runs_of_texts(texts: list[str], least: int = LEAST, exponent: int = EXPONENT) -> tuple[list[list[tuple[int, int, int]]], pa.Array, list[int]]:
    """The runs of each text, its words without their repeats, joined by one space, and how many words it has.

    One catcher reads all texts after one another, with a word of its own between two, so no square spans texts.
    """
    codes, offsets, distinct = numbered_words(texts)
    n = len(texts)
    stream = np.empty(len(codes) + n, np.int64)
    begins = offsets[:-1] + np.arange(n)
    is_word = np.ones(len(stream), bool)
    ends = offsets[1:] + np.arange(n)
    is_word[ends] = False
    stream[is_word], stream[ends] = codes, -1 - np.arange(n)
    catcher = SquareCatcher(least, exponent)
    catcher.append(stream, list(zip(begins.tolist(), ends.tolist())))
    found = catcher.runs()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    change = np.zeros(len(stream) + 1, np.int64)
    for (start, length, period), of in zip(found, np.searchsorted(begins, [r[0] for r in found], side="right") - 1):
        out[of].append((start - int(begins[of]), length, period))
        change[start + period] += 1
        change[start + length] -= 1
    stay = np.cumsum(change[:-1])[is_word] == 0
    edges = np.concatenate([[0], np.cumsum(stay)])[offsets]
    return out, joined_words(codes[stay], edges, distinct), np.diff(offsets).tolist()


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse_runs(df: DataFrame, id_col: str, text: str | Column, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, n_words, runs, kept) for each row: the runs of its words and its text without what they repeat.

    A word is what stands between ASCII white space. A run is a stretch of words with a smallest period q, of at least `least` words and
    `exponent` periods, that no neighbouring word extends; `runs` has start (word number from 0), length and period, by
    start and period. `kept` has the words that no run holds after its first q words, joined by one space. Null and empty texts
    have no word, no run and an empty `kept`. Every row is judged by itself: null ids, ties and repeated rows are as any other, and
    whole texts of any length are read. Columns beside the id and the text are not read. No row gives no row.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found, kept, n = runs_of_texts(batch.column("text").to_pylist(), least, exponent)
            some = [[dict(zip(("start", "length", "period"), r)) for r in one] for one in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(some, shape), kept], ["id", "n_words", "runs", "kept"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, n_words bigint, runs {RUNS}, kept string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact exponent, the first of equal ones; null without a run."""
    stronger = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, b: F.when(stronger(a, b), b).otherwise(a))
