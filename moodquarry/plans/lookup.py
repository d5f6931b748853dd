"""Lookups into small tables whose size is checked, with a shuffle join beyond the bound."""

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.plans.skew import hot_join

# Largest table that may be sent to every executor.
MAX_LOOKUP_ROWS = 200_000
# Largest table that may be written into a plan as a constant.
MAX_LITERAL_ROWS = 50_000


def small_copy(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame | None:
    """`df` as a local table if it has at most `max_rows` rows, else None.

    Computes `df` once, and reads at most one row more than the bound.
    """
    rows = df.limit(max_rows + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= max_rows else None


def lookup_join(
    df: DataFrame, table: DataFrame, on, how: str = "left", max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Join to a lookup table with one row per key: broadcast if its size allows, else a shuffle
    join, which splits hot keys when it is a left or inner join by one column."""
    small = small_copy(table, max_rows)
    if small is not None:
        return df.join(F.broadcast(small), on, how)
    if not isinstance(on, str) or how not in ("left", "inner"):
        return df.join(table, on, how)
    if how == "left":
        return hot_join(df, table, on)
    found = hot_join(df, table.withColumn("_known", F.lit(True)), on)
    return found.where(F.col("_known")).drop("_known")


def small_map(table: DataFrame, key: str, value: str, max_rows: int = MAX_LITERAL_ROWS) -> dict | None:
    """`table` as a dictionary, or None beyond the bound. Of equal keys one keeps its value: the smallest number or text."""
    pairs = table.select(F.col(key).alias("k"), F.col(value).alias("v")).where(F.col("k").isNotNull())
    rows = pairs.limit(max_rows + 1).select("k", F.to_json(F.struct("v"))).collect()
    if len(rows) > max_rows:
        return None
    found: dict = {}
    for k, text in rows:
        v = json.loads(text).get("v")
        if k not in found or (isinstance(v, (int, float, str)) and v < found[k]):
            found[k] = v
    return found


def constant_lookup(values: dict, kind: str) -> Callable[[Column], Column]:
    """A function `Column -> Column` that looks a text key up in `values`, whose type is `kind`.

    The dictionary becomes one constant: an array of small maps addressed by the key's checksum,
    because Spark searches a single map from end to end. It can be used inside array functions and
    on streams, and needs neither a shuffle nor a Python worker.
    """
    size = max(16, 1 << max(0, len(values).bit_length() - 2))  # 2 to 4 keys a map: every task reads the constant anew, and many maps are slow to read
    maps: list[dict] = [{} for _ in range(size)]
    for key, value in values.items():
        maps[zlib.crc32(key.encode()) % size][key] = value
    packed = F.from_json(F.lit(json.dumps(maps)), f"array<map<string,{kind}>>")

    def lookup(term: Column) -> Column:
        return F.get(packed, F.pmod(F.crc32(term), F.lit(size)).cast("int"))[term]

    return lookup


def lookup_column(
    table: DataFrame, key: str, value: str, max_rows: int = MAX_LITERAL_ROWS
) -> Callable[[Column], Column] | None:
    """`constant_lookup` of a table, or None if it has more than `max_rows` rows."""
    values = small_map(table, key, value, max_rows)
    return None if values is None else constant_lookup(values, table.schema[value].dataType.simpleString())


BITS = 1 << 22


def may_have(values: DataFrame, column: str, bits: int = BITS) -> Callable[[Column], Column]:
    """A test that all texts in `column` pass and few others: whether the bit of a text's hash is set. It takes bits / 8 bytes, whatever the rows."""
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(bits))
    places = values.select(at(F.col(column)).alias("_at"))
    found = places.groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(F.expr("1L << cast(_at % 64 as int)")).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in found:
        words[r.word] = r.bits
    packed = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    return lambda t: F.getbit(F.get(packed, F.shiftright(at(t), 6).cast("int")), F.pmod(F.xxhash64(t), F.lit(64)).cast("int")) == 1
