"""Tables kept in the cluster's shared folder, and Arrow batches of bounded size."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from moodquarry.plans.scratch import new_folder, remove

_KEPT: list[str] = []

MAX_BATCH_BYTES = 4 << 20  # of one column, in what a function gets at once; a longer text comes alone


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once, written to the folder that `spark.checkpoint.dir` names and read again.

    It survives lost executors, and Spark knows its size. `forget` removes what was kept.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    _KEPT.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept() -> list[str]:
    """Folders of the tables that are kept now."""
    return list(_KEPT)


def forget(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Remove these kept tables, or all; call it when no result that reads them is needed any more."""
    for folder in kept() if folders is None else folders:
        if folder in _KEPT:
            remove(spark, folder)
            _KEPT.remove(folder)


def tidy(fn: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """`fn` for a task, which at its end calls `forget` and gives memory back: a worker outlives its task, and other operators use it next."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            for one in forget:
                one()
            give_back()

    return run


def give_back() -> None:
    """Return the memory that Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most MAX_BATCH_BYTES of a text column, or of one row."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        step = batch.num_rows if sizes <= MAX_BATCH_BYTES else max(1, batch.num_rows * MAX_BATCH_BYTES // sizes)
        for at in range(0, batch.num_rows, step or 1):
            yield batch.slice(at, step)


def numbered_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts between ASCII white space, as numbers; where each text begins and the last ends; the distinct words."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = lists.values.dictionary_encode()
    codes, offsets, distinct = words.indices.to_numpy(), lists.offsets.to_numpy(), words.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # before leading and after trailing white space
        real = codes != empty
        codes, offsets = codes[real], np.concatenate([[0], np.cumsum(real)])[offsets]
    return codes, offsets, distinct


def joined_words(codes: np.ndarray, edges: np.ndarray, distinct: pa.Array) -> pa.Array:
    """The words of each text, numbered as by `numbered_words`, joined by one space; text i has those from `edges[i]` to `edges[i + 1]`."""
    lists = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), distinct.take(pa.array(codes)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def map_text(df: DataFrame, column: str, fn: Callable[[list], dict], schema: str) -> DataFrame:
    """`fn` takes the texts of a batch, null as the empty text, and gives a new column for each; other columns stay.

    `schema` lists the new columns, whose names must be free.
    """
    full = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.drop(column).schema)}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            got = fn([t or "" for t in batch.column(column).to_pylist()])
            kept = batch.drop_columns([column])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *(v if isinstance(v, pa.Array) else pa.array(v) for v in got.values())], [*kept.schema.names, *got]
            )

    return df.mapInArrow(tidy(run), full)
