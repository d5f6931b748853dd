"""Packed id matrices for training: best-fit-decreasing packing, cumulative segment lengths and position resets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.packing import CAPACITY, token_pieces
from moodquarry.llm.tables import keep

GROUP_CHARS = 16 << 20  # characters whose ids one task packs together
MATRIX_ROWS = 64
MOST_EQUAL = 1000  # equal rows that are dealt together

MATRIX = (
    "matrix_id bigint, n_rows int, n_cols int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, pieces array<int>, starts array<bigint>"
)
MATRIX_NAMES = [column.split()[0] for column in MATRIX.split(", ")]
ARROW = [
    pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()),
    pa.list_(pa.int64()),
]


class GapTree:
    """Numbers of open bins by gap, under a segment tree that finds the smallest gap of at least a size."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)

    def add(self, gap: int, n: int) -> None:
        at = gap + self.base
        while at:
            self.tree[at] += n
            at >>= 1

    def smallest(self, size: int) -> int:
        """The smallest gap >= size that an open bin has, or -1."""
        at, tree = size + self.base, self.tree
        while not tree[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
            if not at:
                return -1
            at += 1
        while at < self.base:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self.base


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: by falling length, each goes to the open bin with the least gap that holds it."""
    tree, stacks = GapTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gap = tree.smallest(size)
        if gap < 0:
            gap, bins[i], made = capacity, made, made + 1
        else:
            bins[i] = stacks[gap].pop()
            tree.add(gap, -1)
        offsets[i] = capacity - gap
        if gap > size:
            stacks[gap - size].append(bins[i])
            tree.add(gap - size, 1)
    return bins, offsets


def _dealt(rows: DataFrame, group_chars: int) -> DataFrame:
    """`rows` (id, text) with a `group` of about `group_chars` characters that depends on the row's content alone.

    So a task that is run again deals its rows as before, whatever order they come in, and none is lost or doubled. Rows that are there
    more than `MOST_EQUAL` times are counted, and their copies dealt over groups by number.
    """
    hashed = rows.withColumn("hash", F.xxhash64("id", "text"))
    sizes = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars"))
    sizes = keep(sizes, "row_sizes")
    chars = sizes.agg(F.sum("chars")).first()[0] or 1
    groups = F.lit(-(-chars // group_chars))
    hot = sizes.filter(F.col("n") > MOST_EQUAL).select("hash")
    if hot.isEmpty():
        return hashed.withColumn("group", F.pmod("hash", groups)).drop("hash")
    copies = hashed.join(hot, "hash", "left_semi").groupBy("hash", "id", "text").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    dealt = copies.select("id", "text", F.pmod(F.xxhash64("hash", "copy"), groups).alias("group"))
    return hashed.join(hot, "hash", "left_anti").withColumn("group", F.pmod("hash", groups)).drop("hash").unionByName(dealt)


def packed_matrices(
    df: DataFrame, id_col: str, text: str, path: str, end_id: int, pad_id: int = 0, capacity: int = CAPACITY,
    matrix_rows: int = MATRIX_ROWS, dtype: str = "<u2", group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """A row for each matrix of up to `matrix_rows` sequences of `capacity` ids; all ids of all whole texts are in them.

    `ids` has n_rows x n_cols ids of `dtype`, rows after one another. `cu_seqlens` has the cumulative lengths of the segments of the
    flat matrix, from 0 to n_rows x n_cols; a row's padding is a segment of its own. `position_resets` are the flat places where
    position ids begin at 0 again, the start of every segment. `doc_ids`, `pieces` and `starts` name each segment: its id, its
    piece and how many ids of its document come before; all null for padding. A text longer than `capacity` is cut
    into pieces that join up to all its ids.

    Null and empty texts are one segment of the end id; equal rows are packed each; a null id is a null in `doc_ids`. Ids that
    `dtype` cannot hold are an error. No row gives no row. Columns beside the id and the text are not read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    salted = _dealt(rows, group_chars)
    pieces = token_pieces(salted, "text", path, end_id, capacity, ("id", "group"), ids=True).drop("ids_crc32")

    def build(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        order = np.lexsort((offsets, bins))
        ids, doc, piece, start = (group.column(c).to_pylist() for c in ("ids", "id", "piece", "start"))
        n, first = int(bins.max()) + 1, group.column("group")[0].as_py() << 32
        out = []
        ends = np.searchsorted(bins[order], np.arange(0, n + matrix_rows, matrix_rows))
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            some, n_rows = order[a:b], min(matrix_rows, n - k * matrix_rows)
            flat = np.full(n_rows * capacity, pad_id, dtype)
            at = (bins[some] - k * matrix_rows) * capacity + offsets[some]
            for i, place in zip(some.tolist(), at.tolist()):
                flat[place : place + lengths[i]] = np.frombuffer(ids[i], "<u4").astype(dtype, casting="unsafe")
                if int(np.frombuffer(ids[i], "<u4").max()) > np.iinfo(dtype).max:
                    raise ValueError(f"ids beyond {dtype}")
            filled = np.bincount(bins[some] - k * matrix_rows, lengths[some], n_rows).astype(np.int64)
            pads = np.flatnonzero(filled < capacity)
            starts = np.concatenate([at, pads * capacity + filled[pads]])
            who = np.concatenate([some, np.full(len(pads), -1)])[np.argsort(starts)]
            starts = np.sort(starts)
            name = lambda values: [None if i < 0 else values[i] for i in who]
            out.append((first + k, n_rows, capacity, flat.tobytes(), [*starts.tolist(), n_rows * capacity], starts.tolist(), name(doc), name(piece), name(start)))
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), ARROW)], MATRIX_NAMES)

    return pieces.groupBy("group").applyInArrow(build, MATRIX)
