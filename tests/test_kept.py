"""Phrases, terms of several words, and what is kept over runs: caches, models, files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from moodquarry.operators import filters as FL
from moodquarry.operators import scoring as S
from moodquarry.operators.cache import ScoreCache, score_through_cache
from moodquarry.operators.features import build_vocab, encode
from moodquarry.operators.prepare import dedup_text
from moodquarry.plans.ranks import numbered

EDGE = r"[^\w]"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(4))
def test_phrases_are_found_as_by_a_pattern(frame, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "New", "york", "é", "_x", "#", "#tag", "-", ".", " ", "  ", "!", "9", "漢"]
    some = lambda n: "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, n)))
    texts = [some(9) for _ in range(150)] + ["", None, "new york"]
    phrases = [some(4).strip() or "q" for _ in range(60)] + ["new york", "#tag", "!"]
    df = frame("id int, text string", [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)])
    pattern = re.compile(f"(?:^|{EDGE})(?:{'|'.join(map(re.escape, sorted({p.lower() for p in phrases})))})(?:{EDGE}|$)")
    want = sorted(t for t in texts if t is not None and pattern.search(t.lower()))
    for options in ({"max_pattern": 1000}, {"max_pattern": 1}, {"max_pattern": 1, "max_literal": 1}):
        got = FL.match_keywords(df, None, "text", phrases, **options)
        assert sorted(r.text for r in got.collect()) == want and got.columns == ["id", "text"]


def test_ten_thousand_phrases_are_one_look(spark):
    phrases = [f"word{i} next{i % 7}" for i in range(10_000)]
    df = spark.range(400).selectExpr("id", "concat('some text before word', id * 31, ' next', id % 7, '.') AS text")
    got = FL.match_keywords(df, None, "text", phrases)
    text = plan(got)
    assert "Exchange" not in text and "RLike" not in text and text.count("regexp_extract_all") <= 2
    want = {i for i in range(400) if i * 31 < 10_000 and (i * 31) % 7 == i % 7}
    assert {r.id for r in got.collect()} == want


@pytest.fixture
def mood(frame):
    rows = [("good", 1.9), ("kind of", 0.5), ("not bad", 1.5), ("not bad at all", 2.5), (":)", 2.0), ("bad", -2.5), ("New York", 1.0), ("york", -1.0)]
    return frame("term string, valence double", rows)


@pytest.mark.parametrize("literal", [100, 1])
def test_the_longest_term_counts(frame, mood, literal):
    texts = ["not bad", "not bad at all", "not bad at york", "this is :) today", "New  york, new YORK", "not not bad", "bad not", "", None]
    df = frame("id int, text string", list(enumerate(texts)))
    got = S.score_sentiment(df, "id", "text", mood, max_literal=literal).orderBy("id").collect()
    compound = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    sums = [1.5, 2.5, 1.5 + -1.0, 2.0, 2.0, 1.5 * -0.74, -2.5, 0, 0]
    assert [r.compound for r in got] == [compound(s) if s else 0.0 for s in sums]
    assert got[0].pos == 1.0 and got[1].neu == 0.0  # a term is one word


def test_contractions_by_rule(frame, mood):
    texts = ["mightn't be good", "needn't be good", "couldn’t be good", "WON’T be good", "sorta good", "hella good", "uber good"]
    df = frame("id int, text string", list(enumerate(texts)))
    got = [r.compound for r in S.score_sentiment(df, "id", "text", mood).orderBy("id").collect()]
    compound = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    assert got[:4] == [compound(1.9 * -0.74)] * 4
    assert got[4:] == [compound(1.9 - 0.293), compound(1.9 + 0.293), compound(1.9 + 0.293)]


def test_keys_change_no_score(frame, lexicons):
    """The trial of the last review: a null key and a repeated one, with a lexicon that is joined."""
    df = frame("key int, text string", [(None, "so good"), (None, "very bad"), (2, "great"), (2, "bad"), (3, "good")])
    for score in (
        lambda n: S.score_sentiment(df, "key", "text", lexicons[0], max_literal=n),
        lambda n: S.score_emotion(df, "key", "text", lexicons[1], max_literal=n),
        lambda n: S.analyze_full(df, "key", "text", lexicons, max_literal=n),
        lambda n: S.analyze_full(df, None, "text", lexicons, max_literal=n),
        lambda n: S.score_guarded(df, "text", lexicons, max_literal=n),
    ):
        assert sorted(map(str, score(1).collect())) == sorted(map(str, score(50_000).collect()))


def test_encoding_with_odd_keys(frame):
    df = frame("key int, text string", [(None, "a b c a"), (None, "c c zz"), (1, "b a"), (1, "zz"), (2, None)])
    vocab = build_vocab(frame("text string", [("a b c a b a c",)]), "text", 100, 1)
    ids = lambda n: sorted(str(r) for r in encode(df, "key", "text", vocab, 6, max_literal=n).collect())
    assert ids(1) == ids(1000)


def test_vocabulary_ranks_and_ties(spark, frame):
    words = [(f"w{i:03d} " * (1 + i % 9),) for i in range(300)]
    vocab = build_vocab(frame("text string", words), "text", 104, 2)
    counted = sorted(((-(1 + i % 9), f"w{i:03d}") for i in range(300) if i % 9))[:100]
    got = [(r.token, r.n) for r in vocab.orderBy("id").collect()][4:]
    assert got == [(t, -n) for n, t in counted]
    assert [r.id for r in vocab.orderBy("id").collect()] == list(range(104))
    assert build_vocab(frame("text string", []), "text").count() == 4 and build_vocab(frame("text string", words), "text", 3).count() == 4


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).selectExpr("id % 37 AS a", "id AS b").repartition(7)
    got = numbered(df, [F.desc("a"), F.col("b")], "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(((i % 37, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [r.n for r in got] == list(range(5000))


def test_dedup_of_odd_keys(frame):
    rows = [(None, "same text"), (3, "same text"), (2, " same text "), (2, "same text"), (None, "other"), (None, "other"), (5, "abc"), (6, "once only")]
    got = dedup_text(frame("key int, text string", rows), "key").collect()
    assert sorted((r.key or 0, r.text) for r in got) == [(0, "other"), (2, "same text"), (6, "once only")]


def test_cache_scores_each_text_once(spark, frame, tmp_path, lexicons):
    seen = []

    def scorer(texts, key, text):
        seen.append(sorted(r[0] for r in texts.select(text).collect()))
        return S.score_sentiment(texts, key, text, lexicons[0])

    kinds, now = {"sentiment": "string", "compound": "double"}, lambda d: F.lit(f"2024-05-{d:02d} 12:00:00").cast("timestamp")
    cache = ScoreCache(spark, "kept_one", str(tmp_path / "cache"), kinds, 4)
    run = lambda rows, c, day: score_through_cache(frame("id int, text string", rows), "text", "quick", scorer, c, 2 * 86_400, now(day))
    one = run([(1, "good"), (2, "good"), (None, "bad"), (4, None)], cache, 1).collect()
    assert seen == [["", "bad", "good"]] and not any(r.from_cache for r in one) and len(one) == 4
    spark.sql("DROP TABLE kept_one")  # as after the session's end; the files stay
    again = ScoreCache(spark, "kept_two", str(tmp_path / "cache"), kinds, 4)
    two = {r.text: r for r in run([(1, "good"), (2, "awful"), (3, "bad")], again, 2).collect()}
    assert seen[1] == ["awful"] and two["good"].from_cache and not two["awful"].from_cache
    assert two["good"].compound == one[0].compound
    run([(1, "good")], again, 4)
    assert seen[2] == ["good"]  # too old by then
    assert again.expire(now(4), 86_400 * 2) == ["2024-05-01"] and again.expire(now(4), 86_400 * 2) == []
    assert {r.from_cache for r in run([(1, "awful"), (2, "good")], again, 4).collect()} <= {True, False}
    joined = frame("cache_key string", [("x",)]).join(again.fresh(now(4), 86_400), "cache_key")
    cached = plan(joined).split("Scan parquet")[0].splitlines()
    assert "Bucketed: true" in plan(joined) and plan(joined).count("Exchange hashpartitioning") <= 1 and cached


def test_streams_refuse_what_they_cannot_join(spark, tmp_path, lexicons):
    from moodquarry.sources.schemas import POST
    from moodquarry.streaming import control as C
    from moodquarry.streaming import posts as P

    spark.createDataFrame([("1", "good zz7", "u", None, 1, 2)], "tweet_id string, text string, author_id string, created_at timestamp, retweet_count bigint, like_count bigint") \
        .withColumn("created_at", F.lit("2025-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POST).parquet(str(tmp_path / "in")).withColumn("source", F.lit("twitter"))
    many = lexicons[0].unionByName(spark.range(60_000).selectExpr("concat('zz', id) AS term", "1.0D AS valence"))
    with pytest.raises(ValueError, match="start_fan_out"):
        P.score_stream(stream, (many, lexicons[1]))
    query = C.start_fan_out(stream, "many_terms", (many, lexicons[1]), str(tmp_path / "root"), None, str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "root/scored")).first().compound_score == round(2.9 / (2.9**2 + 15) ** 0.5, 4)
