"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodquarry.llm.tables import keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_SIZE = 1 << 16  # of a block, or a millionth of all sizes if that is more
SHARD_DRAWS = 64  # block draws in an output shard
MATRIX = 1 << 22  # entries of a part of the tree that one task holds
SEED = 42


@dataclass
class Mix:
    """How to mix: `sources` has source, source_no, source_size, target and blocks; `draws` has source_no, block and its draws."""

    sources: DataFrame
    draws: DataFrame


def words(text: str | Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash(*parts: Column) -> Column:
    """60 bits of an MD5, as other engines give it too."""
    text = F.concat_ws("|", F.lit(str(SEED)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """`df` with consecutive numbers from 0 in the given order: sorted by ranges, then counted by partition."""
    placed = keep(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), name)
    part = F.shiftright("at_", 33).alias("part_")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n_"))  # a row for each partition
    before = counts.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).select("part_", "before_")
    joined = placed.withColumn("part_", part).join(before, "part_")
    return joined.withColumn(name, F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).drop("part_", "before_", "at_")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with source_no in code-point order, null last, and the target of each source.

    Targets share `share` of all sizes by the repeating weights. Where one would be above `most` times its source's size it stops
    there, and what is over goes to the others by weight, until none is above. Each round is one aggregate over the sources.
    """
    known = keep(numbered(sizes, F.col("source").asc_nulls_last(), name="source_no"), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    known = known.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    level, above = None, -1
    while True:
        over = F.col("most") < F.col("weight") * F.lit(level) if level is not None else F.lit(False)
        got = known.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if got[2] is None or got[3] == above:
            break
        level, above = (share * got[0] - (got[1] or 0)) / got[2], got[3]
    target = F.col("most").cast("double") if level is None or got[2] is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return known.withColumn("target", target).drop("weight", "most")


def split_tree(quotas: np.ndarray, capacities: np.ndarray, seed: list[int]) -> np.ndarray:
    """How many of each quota go to each shard, as if all were shuffled and dealt in order.

    A node of the tree has a range of shards and the quotas that fall to it; what its left half gets is drawn from the multivariate
    hypergeometric distribution, the rest goes right. Rows sum to the quotas and columns to the capacities, exactly.
    """
    out = np.zeros((len(quotas), len(capacities)), np.int64)

    def split(a: int, b: int, own: np.ndarray) -> None:
        if b - a == 1:
            out[:, a] = own
            return
        half = (a + b) // 2
        rng = np.random.default_rng([*seed, a, b])
        left = rng.multivariate_hypergeometric(own, int(capacities[a:half].sum()), method="marginals")
        split(a, half, left)
        split(half, b, own - left)

    split(0, len(capacities), quotas)
    return out


def _shards(quotas: DataFrame, total: int, seed: int) -> DataFrame:
    """(source_no, position, shard) for each draw of each source; `quotas` has source_no and n.

    Sources are taken in groups, so that no task holds the whole matrix: one tree splits the groups' sums, and then each group's sums
    are the capacities of a tree of its own.
    """
    shards = max(1, -(-total // SHARD_DRAWS))
    per_group = max(1, MATRIX // shards)
    even = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    grouped = quotas.withColumn("group", F.floor(F.col("source_no") / per_group))

    def outer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group")
        dealt = split_tree(rows["n"].to_numpy(), even, [seed])
        return pd.DataFrame({"group": rows["group"].to_numpy(), "sums": list(dealt)})

    sums = grouped.groupBy("group").agg(F.sum("n").alias("n")).groupBy(F.lit(0).alias("all")).applyInPandas(outer, "group bigint, sums array<bigint>")

    def inner(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no")
        dealt = split_tree(rows["n"].to_numpy(), np.asarray(rows["sums"].iloc[0]), [seed, 1, int(rows["group"].iloc[0])])
        source, shard = np.nonzero(dealt)
        before = (np.cumsum(dealt, axis=1) - dealt)[source, shard]
        return pd.DataFrame({"source_no": rows["source_no"].to_numpy()[source], "shard": shard, "first": before, "n": dealt[source, shard]})

    parts = grouped.join(sums, "group").groupBy("group").applyInPandas(inner, "source_no bigint, shard bigint, first bigint, n bigint")
    return parts.select("source_no", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("position"), "shard")


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` with its source's columns and the block of each row by the hash of its id."""
    known = sources.withColumnRenamed("source", "known_")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("known_")), "left").drop("known_")
    return joined.withColumn("hash", _hash(F.col("id"))).withColumn("block", F.pmod("hash", "blocks"))


def plan_mix(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_size: int = BLOCK_SIZE, seed: int = SEED
) -> Mix:
    """The mix of `rows`, a written table with id, source and size.

    A source's rows fall into blocks of about equal size by the hash of their id. The blocks are drawn in a random order of each pass,
    whole passes first, until the source's target is reached; in the last block the rows go by hash up to the one that comes
    nearest. `most` passes are never exceeded. The tree then says how many of a source's draws each output shard gets, and
    the shards take them in order, which gives each disjoint random blocks.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = targets(sizes, weights, share, most)
    total = known.agg(F.sum("source_size")).first()[0] or 0
    block = max(block_size, -(-total // 1_000_000))
    known = keep(known.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block))), "targets")
    placed = _placed(rows, known)
    blocks = keep(placed.groupBy("source_no", "block").agg(F.sum("size").alias("block_size")), "blocks")

    passes = F.sequence(F.lit(0), F.floor(F.col("target") / F.col("source_size")).cast("int"))
    each = blocks.join(known.filter("target > 0").drop("source"), "source_no").withColumn("pass", F.explode(passes))
    order = Window.partitionBy("source_no", "pass").orderBy(_hash(F.col("source_no"), F.col("block"), F.col("pass")), "block")
    each = each.select(
        "source_no", "block", "pass", "block_size", (F.col("target") - F.col("pass") * F.col("source_size")).alias("rest"),
        (F.col("pass") * F.col("blocks") + F.row_number().over(order) - 1).alias("drawn_at"),
        (F.sum("block_size").over(order) - F.col("block_size")).alias("before"),
    )
    drawn = keep(each.filter("before < rest").withColumn("rest", F.col("rest") - F.col("before")).drop("before"), "draws")

    cut = drawn.filter("block_size > rest").select("source_no", "block", "pass", "rest")
    within = Window.partitionBy("source_no", "pass").orderBy("hash")
    near = placed.select("source_no", "block", "hash", "size").join(cut, ["source_no", "block"])
    near = near.groupBy("source_no", "pass", "rest", "hash").agg(F.sum("size").alias("size"))  # equal ids go together
    near = near.withColumn("before", F.sum("size").over(within) - F.col("size")).filter("size > 0 and before + size / 2 <= rest")
    cuts = keep(near.groupBy("source_no", "pass").agg(F.max("hash").alias("cut")), "cuts")

    position = Window.partitionBy("source_no").orderBy("drawn_at")
    drawn = drawn.withColumn("position", (F.row_number().over(position) - 1).cast("bigint"))
    count = drawn.count()
    quotas = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"))
    dealt = drawn.join(_shards(quotas, count, seed), ["source_no", "position"]) if count else drawn.withColumn("shard", F.lit(None).cast("bigint"))
    dealt = dealt.join(cuts, ["source_no", "pass"], "left").withColumn(
        "cut", F.when(F.col("block_size") > F.col("rest"), F.coalesce("cut", F.lit(-1))).otherwise(F.lit((1 << 60)))
    )
    draws = dealt.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "cut"))).alias("draws"))
    return Mix(known, keep(draws, "drawn_blocks"))


def add_draws(rows: DataFrame, mix: Mix) -> DataFrame:
    """`rows`, with id and source, with source_no, source_size, target and `draws`: an array of (pass, shard), empty if not drawn."""
    placed = _placed(rows, mix.sources).join(mix.draws, ["source_no", "block"], "left")
    taken = F.filter(F.coalesce("draws", F.expr("array()")), lambda d: d["cut"] >= F.col("hash"))
    return placed.withColumn("draws", F.transform(taken, lambda d: F.struct(d["pass"], d["shard"]))).drop("block", "blocks")


def mixed_sizes(df: DataFrame, id_col: str, source: str, size: Column, **options) -> DataFrame:
    """(id, size, source_size, target, taken) for each row: `taken` is its size times the draws of the mix.

    A null source is a source of its own, the last. Null and empty texts have size 0, are drawn with their block and take nothing. A
    source of size 0 has target 0. Rows with the same id are drawn alike; other columns are not read. An empty table gives no row.
    """
    rows = keep(df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size")), "sizes")
    mix = plan_mix(rows, **options)
    got = add_draws(rows, mix)
    return got.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken")
    )


def mixed_rows(df: DataFrame, id_col: str, source: str, size: Column, **options) -> DataFrame:
    """The mix itself: `df`'s rows, repeated as drawn, dealt to their output shards and shuffled within each.

    A partition holds whole shards. Columns stay as they are, whatever their names. The rules are those of `mixed_sizes`.
    """
    rows = keep(df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size")), "sizes")
    mix = plan_mix(rows, **options)
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.col(source).alias("source"))
    drawn = add_draws(whole, mix).select("row", "hash", F.explode("draws").alias("draw"))
    shuffled = drawn.select("row", "draw.shard", _hash(F.col("hash"), F.col("draw.pass"), F.col("draw.shard")).alias("order"))
    return shuffled.repartition("shard").sortWithinPartitions("shard", "order").select("row.*")
