"""Sum-of-squares packing of tokenised documents into sequences."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.tables import keep, small_batches, tidy
from moodquarry.llm.tokens import forget_words, word_tokenizer

CAPACITY = 4096
GROUP_PIECES = 20_000  # pieces that one task packs together

PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    df: DataFrame, text: str, path: str, end_id: int, capacity: int = CAPACITY, carry: tuple[str, ...] = (), ids: bool = False
) -> DataFrame:
    """A row for each piece of each row's ids: those of the whole text by a word tokenizer's file, then `end_id`.

    Only ids beyond `capacity` are cut, into full pieces and a rest. Null text is the empty text: one piece, the end alone. The
    columns in `carry` are repeated; `ids` adds the ids as little-endian unsigned 32-bit bytes.
    """
    kept = df.select(*carry, F.col(text).alias("text_"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text_").schema), PIECE, *["ids binary"] * ids])
    names = [*carry, "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        end = end_id.to_bytes(4, "little")
        for batch in small_batches(batches, "text_"):
            rows, out = [], []
            for at, got in enumerate(tokenizer.encode([t or "" for t in batch.column("text_").to_pylist()])):
                got += end
                for piece, start in enumerate(range(0, len(got) // 4, capacity)):
                    data = got[4 * start : 4 * (start + capacity)]
                    rows.append(at)
                    out.append((piece, start, len(data) // 4, zlib.crc32(data), data)[: 4 + ids])
            kept = batch.drop_columns(["text_"]).take(pa.array(rows, pa.int64()))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, t) for v, t in zip(zip(*out), types))], names)

    return kept.mapInArrow(tidy(run, forget_words), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed in the given order.

    An item goes where the sum over residual gaps of the squared number of open bins with that gap becomes smallest: to an open bin
    or to a new one. Full bins count no more. Of equal places it takes the one that leaves the smaller gap. Once there are
    as many bins as all items need at least, a new one is opened only for what fits nowhere.
    """
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 stays 0, for a full bin is no open one
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    least = -(-int(lengths.sum()) // capacity)
    for i, size in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - size changes the sum by 2 (n[g - size] - n[g]) + 2; a full bin adds nothing.
        change = 2 * (open_bins[: capacity + 1 - size] - open_bins[size:]) + 2
        change[0] -= 1
        change[-1] -= size < capacity  # a new bin only adds its gap
        usable = open_bins[size:] > 0
        usable[-1] = made < least or not usable.any()
        left = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        gap = left + size
        if gap == capacity:
            bins[i], made = made, made + 1
        else:
            bins[i] = stacks[gap].pop()
            open_bins[gap] -= 1
        offsets[i] = capacity - gap
        if left:
            stacks[left].append(bins[i])
            open_bins[left] += 1
    return bins, offsets


def packing_order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The given order, but the shortest, with a tenth of all tokens, last and by falling length: they fill what is left."""
    by_size = np.argsort(lengths, kind="stable")
    small = by_size[: np.searchsorted(np.cumsum(lengths[by_size]), lengths.sum() / 10, side="right")]
    first = np.ones(len(lengths), bool)
    first[small] = False
    return np.concatenate([np.flatnonzero(first), small[::-1]])


def dealt(pieces: DataFrame, weight: int, most: int) -> DataFrame:
    """`pieces`, a written table, with a column `group` that deals the rows evenly over as many groups as `weight` needs."""
    groups = max(1, -(-weight // most))
    return pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset: each piece's place, gapless from 0, in sequences of at most `capacity`.

    `pieces` needs a `length` of 1 to `capacity`, no null, and is best a written table; other columns stay as they are, so equal
    rows, null ids and ties of length are placed like any others. Rows are dealt by hash over groups of about
    `group_pieces`, each packed in one task, so a group's last sequences may stay part empty. No row gives no row.
    """
    made = dealt(pieces, pieces.count(), group_pieces)

    def place(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        order = packing_order(lengths, capacity)
        bins, offsets = sum_of_squares(lengths[order], capacity)
        out = group.drop_columns(["group"]).take(pa.array(order))
        first = group.column("group")[0].as_py() << 32
        return out.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return made.groupBy("group").applyInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(
    df: DataFrame, id_col: str, text: str, path: str, end_id: int, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): the pieces of all whole texts and their places.

    Null and empty texts are one piece of the end id. Columns beside the id and the text are not read, so their names cannot
    clash. Only the lengths move; `token_pieces` with `ids=True` gives the ids of the same pieces.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    pieces = keep(token_pieces(rows, "text", path, end_id, capacity, ("id",)), "pieces")
    return pack(pieces, capacity, group_pieces).withColumnRenamed("id", id_col)
