"""Tokens, vocabulary and encoded texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodquarry.functions.text import clean_for_tokens
from moodquarry.plans.lookup import MAX_LITERAL_ROWS, lookup_column, lookup_join
from moodquarry.plans.ranks import numbered
from moodquarry.plans.session import settle
from moodquarry.plans.skew import hot_join

# Reserved tokens and the stop words.
RESERVED = {"<PAD>": 0, "<UNK>": 1, "<BOS>": 2, "<EOS>": 3}
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "as", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "should", "could", "may", "might", "must", "can",
]


def tokenize(c: Column | str, stop: list[str] | None = None, lower: bool = True) -> Column:
    """Words of the cleaned text; `stop` names words to leave out."""
    # Single blanks part the words, so only a text without any has an empty one, and the array ends there.
    words = F.array_remove(F.split(clean_for_tokens(c, lower), " "), "")
    return words if not stop else F.filter(words, lambda w: ~w.isin(stop))


def token_counts(df: DataFrame, text: str, stop: list[str] | None = None) -> DataFrame:
    return df.select(F.explode(tokenize(text, stop)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, text: str, max_size: int = 50_000, min_freq: int = 2, stop: list[str] | None = None) -> DataFrame:
    """Rows (token, id, n): the reserved tokens, then the most frequent ones; ties by token.

    Tokens are counted once. A histogram of the counts tells the least count that still has a place, so rarer tokens go before
    anything is sorted, and the rest is numbered by ranges: no task gets all candidates.
    """
    room = max(0, max_size - len(RESERVED))
    counts = settle(token_counts(df, text, stop).where(F.col("n") >= min_freq))
    # A row for each count that occurs, merged at once; the counts of a corpus have few values.
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))
    above = steps.withColumn("before", F.sum("tokens").over(W.orderBy(F.desc("n"))) - F.col("tokens")).where(F.col("before") < room)
    least = above.agg(F.min("n")).first()[0]
    frequent = counts.where(F.col("n") >= F.lit(least)) if least is not None else counts.where(F.lit(False))
    ranked = numbered(frequent, [F.desc("n"), F.col("token")], "place").where(F.col("place") < room)
    number = (F.col("place") + len(RESERVED)).cast("int").alias("id")
    reserved = df.sparkSession.createDataFrame([(t, i, None) for t, i in RESERVED.items()], "token string, id int, n bigint")
    return reserved.unionByName(ranked.select("token", number, "n"))


def encode(
    df: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int | None = 160, special: bool = True,
    stop: list[str] | None = None, max_literal: int = MAX_LITERAL_ROWS,
) -> DataFrame:
    """Rows (key, input_ids, attention_mask) of `max_len` numbers each.

    Longer texts lose their end, the closing token included; shorter ones are padded. Without
    `max_len` the longest text sets it. The vocabulary is looked up inside the row; one too large for a constant is joined to the
    words of the distinct texts first. Keys may be null or repeated: each row keeps its own.
    """
    df = df.select(key, tokenize(text, stop).alias("_t"))
    extra = 2 if special else 0
    if max_len is None:
        max_len = (df.agg(F.max(F.size("_t"))).first()[0] or 0) + extra
    df = df.withColumn("_t", F.slice("_t", 1, max_len))
    unknown = F.lit(RESERVED["<UNK>"])
    lookup = lookup_column(vocab, "token", "id", max_literal)
    if lookup is not None:
        df = df.withColumn("_ids", F.transform("_t", lambda t: F.coalesce(lookup(t), unknown)))
    else:
        numbers = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_number"))
        df = df.withColumn("_h", F.coalesce(F.md5(F.to_json("_t")), F.lit("")))
        words = df.select("_h", "_t").dropDuplicates(["_h"]).select("_h", F.explode(F.array_distinct("_t")).alias("_token"))
        # At most `max_len` words of a text come together.
        maps = lookup_join(words, numbers, "_token", "inner").groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("_token", "_number"))).alias("_m"))
        df = hot_join(df, maps, "_h").withColumn("_ids", F.transform("_t", lambda t: F.coalesce(F.col("_m")[t], unknown)))
    if special:
        df = df.withColumn("_ids", F.concat(F.array(F.lit(RESERVED["<BOS>"])), "_ids", F.array(F.lit(RESERVED["<EOS>"]))))
    df = df.withColumn("_ids", F.slice("_ids", 1, max_len))
    gap = F.lit(max_len) - F.size("_ids")
    return df.select(
        key,
        F.concat("_ids", F.array_repeat(F.lit(RESERVED["<PAD>"]), gap)).alias("input_ids"),
        F.concat(F.transform("_ids", lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )
