"""SimHash near-duplicates by tiled exact comparison of all fingerprints."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.components import components
from moodquarry.llm.tables import keep, map_text

SHINGLE = 4
RADIUS = 4
TILE_ROWS = 1 << 17  # fingerprints in a slice of a tile; a pair of slices is one task's unit
_SPACE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_BLOCK = 1 << 16  # hashes whose bits are counted at once


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 (seed 42) have it; no word: 0."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").translate(_SPACE).split())
    if not data:
        return 0
    cut = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.append(0, cut + 1), np.append(cut, len(data))
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def add_fingerprint(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint of each whole text as a long in place of the text; null and wordless texts get 0."""
    return map_text(df, text, lambda texts: {name: pa.array([simhash(t, shingle) for t in texts], pa.int64())}, f"`{name}` bigint")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a tile: every node is compared once with all that no tree has yet."""
    if len(values) <= 512:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        if near.sum() == len(values):
            return []
    links, left = [], np.arange(len(values))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(values[left] ^ values[at]) <= radius
            if hit.any():
                found, left = left[hit], left[~hit]
                links.extend((at, int(x)) for x in found)
                queue.extend(found.tolist())
    return links


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal tile keys; the rows come sorted by key, and the last run of a batch waits for the next."""
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)

    def link(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(keys)) + 1
        pairs = []
        for part in (p for p in np.split(values.view(np.uint64), edges) if len(p) > 1):
            found = np.array(forest(part, radius), np.int64).reshape(-1, 2)
            pairs.append(part[found].view(np.int64))
        both = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("tile").to_numpy()])
        values = np.concatenate([values, batch.column("f").to_numpy()])
        if len(keys) and (last := int(np.searchsorted(keys, keys[-1]))):
            yield link(keys[:last], values[:last])
            keys, values = keys[last:], values[last:]
    if len(keys):
        yield link(keys, values)


def near_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that join distinct fingerprints `f` as all pairs at `radius` bits or fewer would; `radius` is below 64.

    The 64 bits are cut into radius + 1 fields; a linked pair agrees on one field at least, so each field deals the
    fingerprints out by its value. A tile is one value and one band of population counts, radius + 1 wide; it meets itself
    and the next band, and tiles further apart are skipped, as their counts differ by more than the radius. A tile of more
    than `tile_rows` is sliced by hash and its slices meet in pairs. Within a tile pair, numpy compares all exactly and gives a
    spanning forest of the links, so groups of copies give no square.
    """
    width = radius + 1
    cuts = [64 * i // width for i in range(width + 1)]
    fields = [
        F.xxhash64(F.lit(i), F.shiftrightunsigned(F.shiftleft("f", 64 - hi), 64 - hi + lo)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    dealt = prints.select("f", (F.bit_count("f") / width).cast("int").alias("band"), F.explode(F.array(*fields)).alias("value"))
    sizes = dealt.groupBy("value", "band").count().filter(F.col("count") > tile_rows)
    hot = keep(sizes.select("value", "band", F.ceil(F.col("count") / tile_rows).alias("slices")), "hot_tiles")
    if not hot.isEmpty():
        widest = hot.groupBy("value").agg(F.max("slices").alias("slices"))
        dealt = dealt.join(widest, "value", "left")
    else:
        dealt = dealt.withColumn("slices", F.lit(None).cast("bigint"))
    dealt = dealt.withColumn("own", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("f"), "slices")).otherwise(F.lit(0).cast("bigint")))
    last = F.coalesce(F.col("slices") - 1, F.lit(0).cast("bigint"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    met = met.withColumn("low", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    tile = F.xxhash64("value", "low", F.least("own", "other"), F.greatest("own", "other")).alias("tile")
    return met.select("f", tile).repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda b: _compare(b, radius), "a bigint, b bigint")


def near_duplicates(
    df: DataFrame, id_col: str, text: str, shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(id, fingerprint, component_id) for each row: the smallest id among rows that links of `radius` bits reach.

    Whole texts are read. Null, empty and wordless texts share fingerprint zero and link like others. Rows with the same text,
    the same id or all columns equal each give a row. Null ids are reached but never smallest; a component of null ids only has
    a null component_id. An empty table gives an empty result. Other columns are not read.
    """
    rows = keep(add_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "f", shingle), "simhash")
    member = _least_of_group(rows, F.col("id"), radius, tile_rows).withColumnRenamed("least", "component_id")
    return rows.join(member, "f").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _least_of_group(rows: DataFrame, value: Column, radius: int, tile_rows: int) -> DataFrame:
    """(f, least): for each fingerprint `f` of `rows`, the smallest `value` among the rows that links reach from it."""
    classes = keep(rows.groupBy("f").agg(F.min(value).alias("least")), "fingerprints")
    linked = components(near_links(classes.select("f"), radius, tile_rows), "a", "b")
    named = classes.join(linked, classes.f == linked.node, "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = keep(named, "components")
    least = keep(named.groupBy("root").agg(F.min("least").alias("least")), "smallest")
    return keep(named.drop("least").join(least, "root").select("f", "least"), "members")


def without_near_duplicates(
    df: DataFrame, id_col: str, text: str, shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """`df` with one row of each group that links of `radius` bits join: the one with the smallest id, null last, and of these the first.

    Rows are told apart by their number in a written copy of the table, so repeated rows, null ids and rows that share an id but not
    a text are each decided by their own text. Columns stay as they are, whatever their names.
    """
    numbered = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at")
    )
    numbered = keep(numbered, "numbered")
    texts = numbered.select("id", "at", F.col("row").getField(text).alias("text"))
    rows = keep(add_fingerprint(texts, "text", "f", shingle), "simhash")
    first = _least_of_group(rows, F.struct(F.col("id").isNull().alias("last"), "id", "at"), radius, tile_rows)
    gone = keep(rows.join(first, "f").filter("at <> least.at").select("at"), "near_copies")
    return numbered.join(gone, "at", "left_anti").select("row.*")
