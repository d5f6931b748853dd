"""Row filters."""

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.operators import phrase_rules, word_rules
from moodquarry.plans.lookup import lookup_join, may_have
from moodquarry.plans.skew import hot_join

# Their code goes along to the tasks, which need not have this library.
for _rules in (phrase_rules, word_rules):
    cloudpickle.register_pickle_by_value(_rules)

# Up to this many keywords one pattern is tried on each text; more are looked up by the hash of their words.
MAX_PATTERN_KEYWORDS = 50
# Up to this many, every task knows them all, by some hundred bytes each; more are joined.
MAX_KNOWN_KEYWORDS = 2_000_000


def originals_only(df: DataFrame, references: str, kinds: list[str] | None = None) -> DataFrame:
    """Posts that reference no other post, or none of the given kinds.

    `references` is an array of structs with a field type; null means no reference.
    """
    refs = F.col(references)
    if kinds is None:
        return df.where(refs.isNull() | (F.size(refs) == 0))
    return df.where(refs.isNull() | ~F.exists(refs, lambda r: F.coalesce(r["type"].isin(kinds), F.lit(False))))


def match_language(df: DataFrame, languages: list[str], column: str = "lang") -> DataFrame:
    return df.where(F.col(column).isin(languages))


_EDGE = r"[^\p{L}\p{N}_]"
_RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def _parted(phrase: str) -> dict | None:
    """A phrase as it is found from its first word: what stands before that, from there to the last word in `n` runs, and after it.

    None for one without a word.
    """
    runs = re.findall(r"[^\W]+|\W+", phrase)
    words = [i for i, r in enumerate(runs) if re.match(r"\w", r)]
    if not words:
        return None
    a, b = words[0], words[-1]
    return {"lead": "".join(runs[:a]), "core": "".join(runs[a : b + 1]), "tail": "".join(runs[b + 1 :]), "n": b - a + 1}


@cache
def _letters() -> np.ndarray:
    return phrase_rules.word_characters()


def _has_phrase(text: Column, parted: list[dict]) -> Column:
    """Whether a text in lower case has one of the phrases."""
    phrases, made = phrase_rules.Phrases.of(parted, _letters()), []

    @F.arrow_udf("boolean")
    def has(texts: pa.Array) -> pa.Array:
        if not made:  # once in a task
            made.append(phrases.finder())
        return made[0].has_any(texts)

    return has(text)


def match_keywords(
    df: DataFrame,
    key: str | None,
    text: str,
    keywords: list[str],
    max_pattern: int = MAX_PATTERN_KEYWORDS,
    max_literal: int = MAX_KNOWN_KEYWORDS,
) -> DataFrame:
    """Rows whose text has one of the keywords, words or phrases, as a whole, in any case; no keyword, no row.

    A few keywords make one pattern. Many are known to every task: the words of a batch of texts are looked at once, and stretches of as many
    words as phrases have are met by their hash, whatever the number of phrases. Of more than tasks should hold,
    a text's stretches of as many words are joined to them, those that their hash does not rule out. All ways give the same rows; no key
    is needed, and null and repeated ones change nothing.
    """
    wanted = sorted({k.lower() for k in keywords})
    low = F.lower(text)

    def has(some: list[str]) -> Column:
        return low.rlike(f"(?:^|{_EDGE})(?:{'|'.join(map(re.escape, some))})(?:{_EDGE}|$)")

    if not wanted:
        return df.where(F.lit(False))
    if len(wanted) <= max_pattern:
        return df.where(has(wanted))
    parted = [_parted(k) for k in wanted]
    wordless = [k for k, p in zip(wanted, parted) if p is None]
    known = [p for p in parted if p is not None]
    other = has(wordless) if wordless else F.lit(False)
    if len(known) <= max_literal:
        return df.where(other | _has_phrase(low, known)) if known else df.where(other)
    rows = [(p["core"], p["lead"], p["tail"]) for p in known]
    table = df.sparkSession.createDataFrame(rows, "core string, lead string, tail string")
    # Texts stay where they are; only what may be a phrase goes to the phrases, with the hash of its text.
    hashed = df.withColumns({"_h": F.coalesce(F.unhex(F.md5(text)), F.lit("").cast("binary")), "_other": other})
    sizes, may_be = sorted({p["n"] for p in known}), may_have(table, "core")
    hits = hashed.select("_h", F.explode(_stretches(low, sizes, may_be)).alias("_s")).select("_h", "_s.*")
    by_core = table.groupBy("core").agg(F.collect_list(F.struct("lead", "tail")).alias("_ends"))
    found = lookup_join(hits, by_core, "core", "inner").where(F.exists("_ends", _ends_fit)).select("_h").distinct()
    have = hot_join(hashed, found.withColumn("_has", F.lit(True)), "_h")
    return have.where(F.coalesce(F.col("_other"), F.lit(False)) | F.coalesce(F.col("_has"), F.lit(False))).select(*df.columns)


def _stretches(text: Column, sizes: list[int], may_be: Callable[[Column], Column]) -> Column:
    """Distinct stretches of some numbers of runs that pass a test, with the runs before and after them and whether these are the text's ends."""
    runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))

    def of(t: Column, n: int) -> Column:
        cores = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(t, i + 1, n), "").alias("core")))
        some = F.filter(F.when(F.size(t) >= n, cores), lambda s: may_be(s["core"]))
        return F.transform(some, lambda s: F.struct(
            s["core"], F.get(t, s["i"] - 1).alias("before"), F.get(t, s["i"] + n).alias("after"),
            (s["i"] == 1).alias("early"), (s["i"] + n == F.size(t) - 1).alias("late"),
        ))

    every = lambda t: F.array_distinct(F.flatten(F.array_compact(F.array(*(of(t, n) for n in sizes)))))
    return F.get(F.transform(F.array(runs), every), F.lit(0))  # one lambda holds the runs, so they are made once


def _ends_fit(p: Column) -> Column:
    """Whether a stretch stands between what a phrase has before its first and after its last word, and nothing of a word touches these."""
    lead, tail, before, after = p["lead"], p["tail"], F.col("before"), F.col("after")
    leads = (lead == "") | (before.endswith(lead) & ((F.length(before) > F.length(lead)) | F.col("early")))
    tails = (tail == "") | (after.startswith(tail) & ((F.length(after) > F.length(tail)) | F.col("late")))
    return F.coalesce(leads & tails, F.lit(False))


def time_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(ts).between(start, end))


def last_interval(df: DataFrame, ts: str, as_of: Column | None = None, interval: str = "1 hour") -> DataFrame:
    now = F.current_timestamp() if as_of is None else as_of
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {interval}"))


def history(df: DataFrame, user, sentiment: str | None = None, source: str | None = None) -> DataFrame:
    """One user's rows; order and page them with `page`."""
    out = df.where(F.col("user_id") == user)
    if sentiment is not None:
        out = out.where(F.col("sentiment") == sentiment)
    if source is not None:
        out = out.where(F.col("source") == source)
    return out
