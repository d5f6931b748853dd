"""Training samples: labels, copies, splits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from moodquarry.functions.labels import (
    EMOTION_CODES, EMOTIONS, SENTIMENT_CODES, SENTIMENT_OF_EMOTION, SENTIMENTS, map_values, within,
)
from moodquarry.functions.text import strip, text_hash
from moodquarry.operators.tables import dedup_key
from moodquarry.plans.lookup import lookup_join
from moodquarry.plans.session import settle

# Shares, smallest class and seed of the two split rules.
SPLIT_70 = {"ratios": (0.7, 0.15), "min_class": 10}
SPLIT_80 = {"ratios": (0.8, 0.1), "min_class": 0}
SEED = 42

# A class is cut by counting its rows in this many hash ranges.
RANGES = 65_536


def align_columns(
    df: DataFrame, text: str = "text", sentiment: str = "sentiment", emotion: str = "emotion", default: str = "neutral"
) -> DataFrame:
    """text, sentiment and emotion under these names; emotion is `default` if there is no such
    column; rows with a null are dropped."""
    missing = [c for c in (text, sentiment) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    feeling = F.col(emotion) if emotion in df.columns else F.lit(default)
    out = df.select(F.col(text).alias("text"), F.col(sentiment).alias("sentiment"), feeling.alias("emotion"))
    return out.na.drop()


def _mapped(df: DataFrame, column: str, mapping: dict | None) -> Column:
    """Values as text, after `mapping` if given; values it does not name stay."""
    raw = F.col(column).cast("string")
    return map_values(F.col(column), mapping, raw) if mapping else raw


def normalize_labels(
    df: DataFrame,
    sentiment: str | None = None,
    emotion: str | None = None,
    derive: bool = True,
    maps: dict[str, dict] | None = None,
    codes: dict[str, str] | None = SENTIMENT_CODES,
    default_emotion: str = "neutral",
) -> DataFrame:
    """Set sentiment and emotion to labels of the two domains.

    `sentiment` and `emotion` name the columns to read. `maps` may hold a map for either; without
    one, an integer emotion column uses EMOTION_CODES. Without a sentiment column the sentiment
    follows from the emotion, before unknown emotions become neutral. `codes` are sentiment codes.
    """
    maps = maps or {}
    feeling = F.lit(default_emotion)
    if emotion and emotion in df.columns:
        mapping = maps.get("emotion")
        if mapping is None and isinstance(df.schema[emotion].dataType, T.IntegralType):
            mapping = EMOTION_CODES
        feeling = _mapped(df, emotion, mapping)
    if sentiment and sentiment in df.columns:
        mood = _mapped(df, sentiment, maps.get("sentiment"))
    elif derive:
        mood = map_values(F.lower(feeling), SENTIMENT_OF_EMOTION, F.lit("neutral"))
    else:
        raise ValueError("no sentiment column, and it may not be derived from the emotion")
    mood = F.lower(mood)
    if codes:
        mood = map_values(mood, codes, mood)
    return df.withColumns(
        {"sentiment": within(mood, SENTIMENTS, "neutral"), "emotion": within(F.lower(feeling), EMOTIONS, "neutral")}
    )


def dedup_text(df: DataFrame, key: str, text: str = "text", min_len: int = 4, algo: str = "md5") -> DataFrame:
    """Trim, drop short texts, add text_hash, keep the row with the smallest key of each hash, null last.

    Only hashes and keys are grouped, with partial counts, and the rows are then picked by both; no text is ranked. Where the smallest key
    itself has equal texts, which unique keys never have, one of them stays.
    """
    trimmed = df.withColumn(text, strip(text)).where(F.length(text) >= min_len).withColumn("text_hash", text_hash(text, algo))
    counts = trimmed.groupBy(F.col("text_hash").alias("_hash"), F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    least = F.min(F.struct(F.col("_key").isNull().alias("null"), F.col("_key").alias("key"), F.col("_n").alias("n")))
    first = settle(counts.groupBy("_hash").agg(least.alias("_first")))
    same = (F.col("text_hash") == F.col("_hash")) & F.col(key).eqNullSafe(F.col("_first.key"))
    pick = lambda some: trimmed.join(some, same, "left_semi")
    doubled = first.where("_first.n > 1")
    if doubled.isEmpty():
        return pick(first)
    return pick(first.where("_first.n = 1")).unionByName(pick(doubled).dropDuplicates(["text_hash"]))


def _place(df: DataFrame, key: str, seed: int) -> Column:
    """A random-looking place of a row in its class that depends only on key and seed, or on the whole row if it has no key."""
    whole = F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), whole.cast("string")), F.lit(f":{seed}")))


def _split_at(
    df: DataFrame, label: str, key: str, shares: dict[str, float], last: str, min_class: int, seed: int, mode: str
) -> DataFrame:
    """Add split. `shares` holds the parts in order with the share of rows up to their end; the rest is `last`.

    No class is ever sorted: its rows are counted in hash ranges, only the ranges that hold a cut
    are ranked, and every row is then compared to the few cut places of its class.
    """
    placed = df.where(F.col(label).isNotNull()).withColumn("_place", _place(df, key, seed))
    split = None
    if mode == "hash":
        position = F.conv(F.substring("_place", 1, 8), 16, 10).cast("double") / float(1 << 32)
        for part, share in shares.items():
            split = F.when(position < share, part) if split is None else split.when(position < share, part)
        return placed.withColumn("split", split.otherwise(last)).drop("_place")
    bucket = F.conv(F.substring("_place", 1, 4), 16, 10).cast("int")
    # Read twice below; the input, which may be costly, is computed once for it.
    narrow = settle(placed.select(F.col(label).alias("_label"), "_place", bucket.alias("_bucket")))
    # At most RANGES rows per class.
    counts = narrow.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = W.partitionBy("_label").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumns(
        {"_upto": F.sum("_n").over(ordered), "_total": F.sum("_n").over(W.partitionBy("_label"))}
    )
    small = F.col("_total") < min_class
    wanted = [
        F.struct(
            F.lit(part).alias("part"),
            F.when(small, F.col("_total")).otherwise(F.floor(F.col("_total") * share)).cast("bigint").alias("want"),
        )
        for part, share in shares.items()
    ]
    before = (F.col("_upto") - F.col("_n")).alias("_before")
    cuts = counts.select("_label", "_bucket", before, "_upto", F.explode(F.array(*wanted)).alias("c"))
    cuts = cuts.select("_label", "_bucket", "_before", "_upto", "c.*")
    cuts = cuts.where((F.col("want") > F.col("_before")) & (F.col("want") <= F.col("_upto"))).drop("_upto")
    # The ranked places are one of RANGES parts of a class; rows of one place are counted first.
    edges = lookup_join(narrow, cuts, ["_label", "_bucket"], "inner")
    edges = edges.groupBy("_label", "part", "_before", "want", "_place").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("_label", "part").orderBy("_place")) + F.col("_before")
    edges = edges.withColumn("_upto", upto).where(F.col("_upto") >= F.col("want"))
    edges = edges.groupBy(F.col("_label").alias(label)).agg(
        *[F.min(F.when(F.col("part") == part, F.col("_place"))).alias(f"_{part}") for part in shares]
    )
    # A part without rows has no cut place, and no place is below ''.
    for part in shares:
        inside = F.col("_place") <= F.coalesce(f"_{part}", F.lit(""))
        split = F.when(inside, part) if split is None else split.when(inside, part)
    out = lookup_join(placed, edges, label, "left")
    return out.select(*df.columns, split.otherwise(last).alias("split"))


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    ratios: tuple[float, float] = (0.7, 0.15),
    min_class: int = 10,
    seed: int = SEED,
    mode: str = "exact",
) -> DataFrame:
    """Add split: train, val or test. Rows without a label are dropped; `key` should be unique, and
    rows that share one stay together.

    exact: of the n rows of a class in the order of their places, the first int(n * r1) train, up
    to int(n * (r1 + r2)) validate, the rest test; a class below `min_class` only trains.
    hash: each row goes by its own place, so sizes are approximate and nothing is counted.
    """
    shares = {"train": ratios[0], "val": ratios[0] + ratios[1]}
    return _split_at(df, label, key, shares, "test", min_class, seed, mode)


def random_split(df: DataFrame, ratio: float = 0.9, key: str = "text_hash", seed: int = SEED, mode: str = "exact") -> DataFrame:
    """Add split: int(n * ratio) rows train and the others validate; `key` should be unique."""
    whole = df.withColumn("_all", F.lit("all"))
    return _split_at(whole, "_all", key, {"train": ratio}, "val", 0, seed, mode).drop("_all")


def split_metadata(df: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Rows (metric, key, count): rows per split, per source, and per label of the train split.

    Sources are counted in `sources` if given, for counts before copies are dropped.
    """
    counts = df.groupBy("split", "source", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    row = lambda metric, key: F.struct(F.lit(metric).alias("metric"), F.col(key).alias("key"))
    rows = [row("split", "split"), F.when(F.col("split") == "train", row("train_sentiment", "sentiment"))]
    if sources is None:
        rows.append(row("source", "source"))
    out = (
        counts.select("n", F.explode(F.array(*rows)).alias("r"))
        .where(F.col("r").isNotNull())
        .groupBy("r.metric", "r.key")
        .agg(F.sum("n").alias("count"))
    )
    if sources is not None:
        found = sources.groupBy(F.lit("source").alias("metric"), F.col("source").alias("key"))
        out = out.unionByName(found.agg(F.count(F.lit(1)).alias("count")))
    return out
