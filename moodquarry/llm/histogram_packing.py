"""Shortest-pack-first packing over the histogram of lengths, which pads nothing."""

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodquarry.llm.tables import keep, small_batches, tidy
from moodquarry.llm.tokens import forget_words, word_tokenizer

CAPACITY = 2048

PIECES = "part int, no bigint, nth bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@dataclass
class Pattern:
    """`count` packs alike: each has `runs` of (length, times) from offset 0 on, and `space` left."""

    count: int
    space: int
    runs: tuple[tuple[int, int], ...]


def _power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def shortest_pack_first(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns for `counts[l]` items of each length l, placed longest first.

    Items of a length go to the packs with the most space, one each, and a new pack is opened only if none of the open ones has
    enough. All packs of a pattern take an item at once, so the work follows the patterns, not the items: a length splits one pattern
    at most and opens two, so there are never more than three for each length.
    """
    by_space: dict[int, list[Pattern]] = {}
    spaces: list[int] = []  # a heap of negative spaces

    def put(pattern: Pattern) -> None:
        if pattern.space not in by_space:
            by_space[pattern.space] = []
            heapq.heappush(spaces, -pattern.space)
        by_space[pattern.space].append(pattern)

    def more(pattern: Pattern, count: int, length: int, times: int = 1) -> Pattern:
        runs, space = pattern.runs, pattern.space - length * times
        if runs and runs[-1][0] == length:
            runs, times = runs[:-1], runs[-1][1] + times
        return Pattern(count, space, (*runs, (length, times)))

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            if not spaces or -spaces[0] < length:
                fit = capacity // length
                fresh = Pattern(0, capacity, ())
                if n >= fit:
                    put(more(fresh, n // fit, length, fit))
                if n % fit:
                    put(more(fresh, 1, length, n % fit))
                break
            same = by_space[-spaces[0]]
            pattern = same.pop()
            if not same:
                del by_space[-heapq.heappop(spaces)]
            taken = min(n, pattern.count)
            if taken < pattern.count:
                put(Pattern(pattern.count - taken, pattern.space, pattern.runs))
            put(more(pattern, taken, length))
            n -= taken
    return [p for _, same in sorted(by_space.items()) for p in same]


class Plan:
    """Where the item with a rank among those of its length goes.

    Packs that are full, or full to a power of two, stay as they are. Of the others, the emptiest are dissolved, as many as all their
    spaces make up together: their contents, one after another, pour into the spaces of the rest, largest first, cut where a
    space ends. What is left is less than a pack and goes to sequences of falling powers of two. So no sequence needs padding,
    whatever the lengths.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        patterns = shortest_pack_first(counts, capacity)
        tight = [p for p in patterns if not p.space or _power(capacity - p.space)]
        loose = [p for p in patterns if p.space and not _power(capacity - p.space)]
        dissolve = -(-sum(p.count * p.space for p in loose) // capacity)
        stay, poured = [], []
        for p in sorted(loose, key=lambda p: -p.space):
            n = min(dissolve, p.count)
            dissolve -= n
            if n:
                poured.append(Pattern(n, p.space, p.runs))
            if p.count > n:
                stay.append(Pattern(p.count - n, p.space, p.runs))
        # For each length: first ranks, and for each of them (first sequence or place in the stream, times, offset, size, poured).
        self.starts: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.places: list[list[tuple[int, int, int, int, bool]]] = [[] for _ in range(capacity + 1)]
        used = [0] * (capacity + 1)
        self.gaps: list[tuple[int, int, int, int]] = []  # first place in the stream, space, first sequence, offset
        sequence = stream = place = 0
        for pattern, pours in [*((p, False) for p in tight + stay), *((p, True) for p in poured)]:
            fill, offset = capacity - pattern.space, 0
            for length, times in pattern.runs:
                self.starts[length].append(used[length])
                self.places[length].append((stream if pours else sequence, times, offset, fill, pours))
                used[length] += pattern.count * times
                offset += length * times
            if pours:
                stream += pattern.count * fill
            else:
                if pattern.space and not _power(fill):
                    self.gaps.append((place, pattern.space, sequence, fill))
                    place += pattern.count * pattern.space
                sequence += pattern.count
        rest = stream - place
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                self.gaps.append((place, 1 << bit, sequence, 0))
                place, sequence = place + (1 << bit), sequence + 1
        self.sequences = sequence
        self.gap_starts = [g[0] for g in self.gaps]

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each item, or its place in the stream, else -1."""
        n = len(lengths)
        sequence, offset, stream = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], n]):
            some = order[a:b]
            length = int(lengths[some[0]])
            starts = np.array(self.starts[length])
            of = np.searchsorted(starts, ranks[some], side="right") - 1
            first, times, begin, size, pours = np.array(self.places[length], np.int64)[of].T
            copy, turn = np.divmod(ranks[some] - starts[of], times)
            at = begin + turn * length
            sequence[some] = np.where(pours, -1, first + copy)
            offset[some] = np.where(pours, -1, at)
            stream[some] = np.where(pours, first + copy * size + at, -1)
        return sequence, offset, stream

    def pour(self, stream: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(begin, length, sequence, offset) of the parts of an item that begins at a place in the stream."""
        done = 0
        while done < length:
            place, space, sequence, offset = self.gaps[bisect_right(self.gap_starts, stream + done) - 1]
            copy, within = divmod(stream + done - place, space)
            size = min(length - done, space - within)
            yield done, size, sequence + copy, offset + within
            done += size


def ranked_pieces(rows: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """`rows` (id, text) as pieces of up to `capacity` ids: id, `PIECES`, and `ids` as bytes, null for full pieces.

    `part` is the task that wrote a piece, `no` its number there, and `nth` counts the task's pieces of the same length, so that ranks
    over all tasks need one number for each task and length only. Write it before use: a task run again may number its rows anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, end = word_tokenizer(path), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        seen, no = [0] * (capacity + 1), 0
        for batch in small_batches(batches, "text"):
            of, out = [], []
            for row, ids in enumerate(tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    data = ids if total <= capacity else ids[4 * start : 4 * (start + capacity)]
                    length = len(data) // 4
                    of.append(row)
                    out.append((part, no, seen[length], start, length, zlib.crc32(data), total, data if length < capacity else None))
                    seen[length] += 1
                    no += 1
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            ids = batch.column("id").take(pa.array(of, pa.int64()))
            names = ["id", *(c.split()[0] for c in PIECES.split(", ")), "ids"]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(zip(*out), types))], names)

    return rows.mapInArrow(tidy(run, forget_words), f"id {rows.schema['id'].dataType.simpleString()}, {PIECES}, ids binary")


def _with_ranks(pieces: DataFrame, capacity: int) -> tuple[DataFrame, np.ndarray]:
    """Pieces without ids but with their rank among all of the same length, and how many there are of each length."""
    counts = keep(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "length_counts")
    of_length = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length, no more than `capacity`
        of_length[r.length] = r.n
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    ranked = pieces.drop("ids").join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.drop("before", "nth"), of_length


def pack_by_histogram(df: DataFrame, id_col: str, text: str, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): pieces of all whole texts, packed without padding.

    A text's ids are those of a word tokenizer's file, then `end_id`. Longer ones than `capacity` are cut into full pieces and a rest.
    The pieces are counted by length; the driver packs the counts, never the pieces, and each piece finds its place by its rank
    among those of its length. Only the pieces of dissolved packs are cut again, to fill the spaces of others (`Plan`); their ids
    come from the written pieces. Every id lies in exactly one piece; sequences are full or a power of two long.

    Null and empty texts are one piece of the end id. Equal rows, ties of length and null ids are packed like any others. No row
    gives no row. Columns beside the id and the text are not read, so their names cannot clash. A length that a third of all
    rows share is counted and ranked in parts, one for each task that read them.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    pieces = keep(ranked_pieces(rows, path, end_id, capacity), "ranked_pieces")
    ranked, counts = _with_ranks(pieces, capacity)
    plan = Plan(counts, capacity)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    shape = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset, stream = plan.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            known = [batch.column(c) for c in names[:5]]
            some = [pa.array(sequence), pa.array(offset), pa.array(stream), batch.column("part"), batch.column("no")]
            yield pa.RecordBatch.from_arrays([*known, *some], [*names, "stream", "part", "no"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("start", "stream", "ids"))
            for row, (start, stream, ids) in enumerate(zip(*columns)):
                for begin, size, sequence, offset in plan.pour(stream, len(ids) // 4):
                    of.append(row)
                    out.append((start + begin, size, zlib.crc32(ids[4 * begin : 4 * (begin + size)]), sequence, offset))
            at = pa.array(of, pa.int64())
            start, size, crc, sequence, offset = (pa.array(v, pa.int64()) for v in (zip(*out) if out else [()] * 5))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), start, size, crc, batch.column("doc_tokens").take(at), sequence, offset], names)

    placed = keep(ranked.mapInArrow(place, f"{shape}, stream bigint, part int, no bigint"), "placed_pieces")
    poured = placed.filter("stream >= 0").join(pieces.filter("ids is not null").select("part", "no", "ids"), ["part", "no"])
    again = poured.select("id", "start", "doc_tokens", "stream", "ids").mapInArrow(cut, shape)
    return placed.filter("stream < 0").select(*names).unionByName(again).withColumnRenamed("id", id_col)
