"""Rows gathered into flushes by number or by time, with state that outlives a restart.

Rows come and go in pieces: some rows of one buffer as one binary value, so that the task of a buffer moves bytes and counts, not rows.
"""

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Its code goes along to the tasks, which need not have this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
# Spark's default store keeps one kind of value for each key; a buffer has several.
PLAIN_STORE, STORE_OF_MANY = (
    f"org.apache.spark.sql.execution.streaming.state.{name}StateStoreProvider" for name in ("HDFSBacked", "RocksDB")
)
# Rows and seconds until a flush.
FLUSH_ROWS, FLUSH_SECONDS = 1000, 60


@contextmanager
def state_of_many_columns(spark: SparkSession) -> Iterator[None]:
    """Streams started within have a state store that can hold buffers, whatever the session was built with.

    A stream takes the session's settings as it starts, and a restart those of its checkpoint; other streams keep theirs.
    """
    before = spark.conf.get(STORE, PLAIN_STORE)
    if not before.endswith(PLAIN_STORE.rsplit(".", 1)[1]):
        yield
        return
    spark.conf.set(STORE, STORE_OF_MANY)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


PIECE = 1 << 16  # bytes of rows that go together, by the mean row of a batch

_PIECES = "_buffer string, n bigint, piece binary"
_FLUSHED = "_buffer string, flush bigint, flush_rows bigint, flush_cause string, piece binary"


def _packed(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(piece: bytes | pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(piece).read_next_batch()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows, whose last column names the buffer, as pieces."""
    for batch in batches:
        if not len(batch):
            continue
        keys, rows = batch.column(batch.num_columns - 1).dictionary_encode(), batch.select(batch.schema.names[:-1])
        codes, most = keys.indices.to_numpy(zero_copy_only=False), max(1, PIECE * len(rows) // max(1, rows.nbytes))
        if len(keys.dictionary) > 1:
            order = np.argsort(codes, kind="stable")
            rows, codes = rows.take(pa.array(order)), codes[order]
        ends = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(rows)]
        cuts = [(i, min(i + most, end)) for begin, end in zip([0, *ends], ends) for i in range(begin, end, most)]
        yield pa.RecordBatch.from_arrays(
            [
                keys.dictionary.take(pa.array([codes[i] for i, _ in cuts])), pa.array([j - i for i, j in cuts], pa.int64()),
                pa.array([_packed(rows.slice(i, j - i)) for i, j in cuts], pa.binary()),
            ],
            ["_buffer", "n", "piece"],
        )


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of flushed pieces, with their buffer and flush."""
    for batch in batches:
        *marks, pieces = batch.columns
        for i in range(len(batch)):
            rows = _unpacked(pieces[i].as_buffer())
            name, flush, size, cause = (m[i].as_py() for m in marks)
            more = ((int(name) if name else None, pa.int32()), (flush, pa.int64()), (size, pa.int64()), (cause, marks[3].type))
            columns = [*rows.columns, *(pa.repeat(pa.scalar(v, kind), len(rows)) for v, kind in more)]
            yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "buffer", "flush", "flush_rows", "flush_cause"])


class _Buffer(StatefulProcessor):
    """One buffer: the pieces not flushed yet, how many rows they have, and the number of the next flush."""

    def __init__(self, rows: int, seconds: float):
        self.limit, self.millis = rows, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "n bigint, piece binary")
        self.mark = handle.getValueState("mark", "size bigint, number bigint")

    def _mark(self) -> tuple[int, int]:
        return tuple(map(int, self.mark.get())) if self.mark.exists() else (0, 0)

    def _taken(self) -> list[bytes]:
        """What is held, which is held no more."""
        pieces = [bytes(piece) for _, piece in self.held.get()]
        self.held.clear()
        return pieces

    def _wait_anew(self, now: int, any_left: bool) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
        if any_left:
            self.handle.registerTimer(now + self.millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, number = self._mark()
        held, anew, fresh = size > 0, size == 0, []
        for frame in rows:
            done = []
            for n, piece in zip(frame["n"].tolist(), frame["piece"]):
                if size + n >= self.limit:
                    whole, at = _unpacked(piece), 0
                    while size + n - at >= self.limit:
                        end = at + self.limit - size
                        before = (self._taken() if held else []) + [p for _, p in fresh]
                        done += [(key[0], number, self.limit, "rows", p) for p in (*before, _packed(whole.slice(at, end - at)))]
                        held, anew, fresh, size, number, at = False, True, [], 0, number + 1, end
                    n, piece = n - at, _packed(whole.slice(at))
                if n:
                    fresh.append((n, piece))
                    size += n
            if done:
                yield _frame(done)
        if fresh:
            self.held.appendList(fresh)
        if anew:  # what is held now begins in this batch
            self._wait_anew(timerValues.getCurrentProcessingTimeInMs(), size > 0)
        self.mark.update((size, number))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, number = self._mark()
        if size:
            yield _frame([(key[0], number, size, "time", piece) for piece in self._taken()])
            self.mark.update((0, number + 1))

    def close(self) -> None:
        pass


def _frame(pieces: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(pieces, columns=["_buffer", "flush", "flush_rows", "flush_cause", "piece"])


def flush_groups(df: DataFrame, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS, buffer: Column | None = None) -> DataFrame:
    """A stream's rows as they are flushed, with the buffer, the flush's number in it from 0, its rows and its cause, rows or time.

    A buffer flushes when it holds `rows` rows, or `seconds` after the first row that it holds came, whichever is first; a batch of
    many rows gives several flushes. What is held lies in the query's state and its timer goes on after a restart, so no row
    is lost and none comes twice. `buffer` says which buffer a row goes to, one for all by default; a buffer is filled by one task,
    which moves pieces of rows that other tasks pack and unpack, so spread a very fast stream only, as by a hash of its id. Timers fire
    in the batch after they are due, which a trigger by processing time always starts; a trigger that takes what is there and ends leaves the rest for the next start.
    """
    buffer_name = F.coalesce((F.lit(0) if buffer is None else buffer).cast("int").cast("string"), F.lit(""))
    pieces = df.withColumn("_buffer", buffer_name).mapInArrow(_pack, _PIECES)
    flushed = pieces.groupBy("_buffer").transformWithStateInPandas(_Buffer(rows, seconds), _FLUSHED, "append", "ProcessingTime")
    more = {"buffer": T.IntegerType(), "flush": T.LongType(), "flush_rows": T.LongType(), "flush_cause": T.StringType()}
    out = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more.items())])
    return flushed.repartition(df.sparkSession.sparkContext.defaultParallelism, "_buffer", "flush").mapInArrow(_unpack, out)
