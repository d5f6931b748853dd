"""A corpus from raw documents: stages that each call one operator of `moodquarry.llm`, written and read in between."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.llm.language import UNDETERMINED, language_and_share, learn_profiles, learn_seen
from moodquarry.llm.mixing import mixed_rows, words
from moodquarry.llm.packing import pack_documents
from moodquarry.llm.simhash import without_near_duplicates
from moodquarry.llm.substrings import without_repeats
from moodquarry.llm.tables import forget, keep, kept

LEAST_SEEN = 0.5  # at scale 0.01, 300 Latin letters drawn by chance have up to 0.22 of their units known, a document 0.97 or more


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names; those with no letter, or like none of them, go.

    A document is like one of them if half of its letters, each with its neighbours, are as in one in a thousand documents of a
    language. That holds for one word as for a long text; the cosine of op2 is no measure of it, for its noise is 1/32, more
    than that of a clean word. Without any row that names a language nothing is known and nothing stays.
    """
    profiles = learn_profiles(docs, "text", "lang")
    seen = learn_seen(docs, "text", "lang")
    found = docs.select(F.struct(*docs.columns).alias("row"), language_and_share(profiles, seen, F.col("text")).alias("found"))
    known = (F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.seen") >= LEAST_SEEN)
    return found.filter(known).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id, null last, and the first of equal ids."""
    return without_near_duplicates(docs, "doc_id", "text")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller doc_id has, too; n_chars follows. A text of which nothing is left goes."""
    return without_repeats(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("bigint"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources draws them: not at all, once or twice, in its shuffled shards."""
    return mixed_rows(docs, "doc_id", "source", words("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence."""
    return pack_documents(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 1)


_made: dict[str, list[str]] = {}  # tables that the stage before kept for its result, by its name


def _after(before: str | None, name: str, fn):
    """Stage `name`: what the stage `before` kept for its result goes, as that is written by now."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before is not None:
            forget(spark, _made.pop(before, []))
        earlier = set(kept())
        out = fn(spark, docs, sf_dir)
        _made[name] = [folder for folder in kept() if folder not in earlier]
        return out

    return stage


_ORDER = [
    ("language_id", language_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

STAGES = [(name, _after(_ORDER[i - 1][0] if i else None, name, fn)) for i, (name, fn) in enumerate(_ORDER)]

ORACLE_SQL = None  # hyperdimensional profiles, BPE and packing are beyond SQL; tests/llm checks each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
