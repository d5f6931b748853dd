import math

import pytest
from pyspark.sql import functions as F

from moodquarry.operators import scoring as S


@pytest.fixture
def score(frame, lexicons):
    def run(*texts, **options):
        df = frame("id int, text string", list(enumerate(texts)))
        return S.score_sentiment(df, "id", "text", lexicons[0], **options).orderBy("id").collect()

    return run


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


def test_signs_of_plain_sentences(score):
    rows = score(
        "I love this! It's amazing and wonderful!", "What a great day, I am so happy!", "I hate this, it is terrible.",
        "The worst and most awful experience", "The meeting is at 3pm.", "The sky is blue today",
    )
    assert [r.sentiment for r in rows] == ["positive"] * 2 + ["negative"] * 2 + ["neutral"] * 2


def test_rules_by_hand(score):
    rows = score(
        "good", "not good", "very good", "good but bad", "GOOD day", "GOOD", "good!!!!!", "good? good???", "slightly good", "was very not good"
    )
    want = [
        1.9, 1.9 * -0.74, 1.9 + 0.293, 1.9 * 0.5 - 2.5 * 1.5, 1.9 + 0.733, 1.9, 1.9 + 4 * 0.292, 3.8 + 0.96, 1.9 - 0.293,
        (1.9 * -0.74) - (0.293 * 0.95),
    ]
    assert [r.compound for r in rows] == [compound(w) for w in want]
    assert all(r.confidence == abs(r.compound) for r in rows)


def test_negation_reaches_three_words(score):
    near, far = score("not a b good", "not a b c good")
    assert near.compound == compound(1.9 * -0.74) and far.compound == compound(1.9)


def test_shares(score):
    (row,) = score("good day today")
    assert (row.pos, row.neg, row.neu) == (round(2.9 / 4.9, 3), 0.0, round(2 / 4.9, 3))


def test_empty_text_is_neutral(score):
    for row in score("", "   \t\n", None, "<b></b>"):
        assert (row.sentiment, row.compound, row.pos, row.neg, row.neu, row.confidence) == ("neutral", 0.0, 0.0, 0.0, 1.0, 0.0)


def test_large_lexicon_gives_the_same(score):
    texts = ["I love this GREAT thing but not the bad part!", "", None, "very bad", "nothing here", "HATE hate", "good " * 3000]
    assert score(*texts) == score(*texts, max_literal=2)


def test_whole_text_unless_cut(score):
    text = "x " * 4000 + "good"
    assert score(text)[0].pos > 0 and score(text, max_len=5000)[0].pos == 0


def test_large_lexicon_without_a_key(frame, lexicons):
    """Equal texts are scored once and both get the scores; more terms than a constant holds change nothing."""
    df = frame("text string, n int", [("love it, not bad", 1), ("love it, not bad", 2), (None, 3), ("so so awful", 4)])
    more = lexicons[0].unionByName(df.sparkSession.range(60_000).selectExpr("concat('zz', id) AS term", "1.0D AS valence"))
    rows = lambda d: sorted(map(str, d.collect()))
    want = rows(S.add_sentiment(df, "text", lexicons[0]))
    assert rows(S.add_sentiment(df, "text", more)) == want == rows(S.add_sentiment(df, "text", lexicons[0], max_literal=2))
    assert rows(S.analyze_table(df, None, "text", (more, lexicons[1]))) == rows(S.analyze_table(df, None, "text", lexicons))


def test_published_rules_by_hand(score):
    good, up, down, caps, turn = 1.9, 0.293, -0.293, 0.733, -0.74
    cases = {
        "never so good": good * 1 + up, "never this good": good * 1.25, "never was this good": good * 1.25, "never good": good * turn,
        "without doubt good": good, "without a good": good * turn, "least good": good * turn, "at least good": good, "very least good": good + up * 0.95,
        "kind of good": good + down, "sort of a good": good + down, "VERY good day": good + up + caps, "very good": good + up,
        "not very good": (good + up) * turn, "very not good": good * turn - up * 0.95, "hate good": -2.7 + good, "most": 0.0,
    }
    cases["never so good"] = (good + up) * 1.25
    got = {t: r.compound for t, r in zip(cases, score(*cases))}
    assert got == {t: compound(v) for t, v in cases.items()}
    assert [r.compound for r in score(*cases, max_literal=2)] == list(got.values())


def test_emotions(frame, lexicons):
    df = frame("id int, text string", [(0, "love and hate"), (1, "terrible"), (2, "nothing"), (3, ""), (4, None)])
    for options in ({}, {"max_literal": 1}):
        rows = S.score_emotion(df, "id", "text", lexicons[1], **options).orderBy("id").collect()
        assert [r.primary_emotion for r in rows] == ["joy", "fear", "neutral", "neutral", "neutral"]
        assert [round(r.emotion_confidence, 6) for r in rows] == [0.666667, 0.5, 1.0, 1.0, 1.0]
        assert all(abs(sum(r.emotion_scores.values()) - 1) < 1e-9 and len(r.emotion_scores) == 7 for r in rows)


def test_analyze_table_keeps_rows_and_columns(frame, lexicons):
    df = frame("id int, Text string, extra string", [(1, "Good", "a"), (2, "", "b"), (3, None, "c"), (4, "Bad", "d")])
    out = S.analyze_table(df, "id", "Text", lexicons).orderBy("id").collect()
    assert [(r.id, r.extra, r.Sentiment) for r in out] == [(1, "a", "positive"), (2, "b", "neutral"), (3, "c", "neutral"), (4, "d", "negative")]
    assert "Primary_Emotion" not in S.analyze_table(df, "id", "Text", lexicons, emotions=False).columns


def test_guarded_blank_names_no_model(frame, lexicons):
    df = frame("text string", [(" ",), ("good",)])
    assert [(r.model_used, r.confidence) for r in S.score_guarded(df, "text", lexicons).collect()] == [("none", 0.0), ("lexicon", 1.0)]


def test_map_back_scores_each_text_once(spark, frame, lexicons):
    seen = spark.sparkContext.accumulator(0)
    texts = ["good"] * 50 + ["<b>good</b>", "bad", "", None, " "]
    df = frame("id int, text string", list(enumerate(texts)))

    def scorer(rows, key, text):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        counted = rows.select(key, text).mapInPandas(count, rows.select(key, text).schema)
        return S.score_sentiment(counted, key, text, lexicons[0])

    rows = S.map_back(df, "text", scorer, {"sentiment": "neutral", "compound": 0.0}).orderBy("id").collect()
    assert [r.sentiment for r in rows] == ["positive"] * 51 + ["negative"] + ["neutral"] * 3
    assert seen.value == 2


def test_map_back_with_map_columns(frame, lexicons):
    df = frame("m map<string,int>, text string", [({"a": 1}, "good"), (None, "")])
    scorer = lambda rows, key, text: S.score_sentiment(rows, key, text, lexicons[0])
    rows = S.map_back(df, "text", scorer, {"sentiment": "neutral"}).collect()
    assert sorted((r.m or {}, r.sentiment) for r in rows if r.m) == [({"a": 1}, "positive")] and len(rows) == 2


def test_cache_age_and_misses(spark, frame, lexicons, tmp_path):
    as_of = F.lit("2025-01-02 00:00:00").cast("timestamp")
    key = lambda t: F.concat(F.lit("sentiment:quick:"), F.md5(F.lit(t)))
    one = spark.range(1)
    cache = one.select(key("good").alias("cache_key"), F.lit("cached").alias("sentiment"), F.lit("2025-01-01 12:00:00").cast("timestamp").alias("stored_at"))
    old = one.select(key("bad").alias("cache_key"), F.lit("old").alias("sentiment"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("stored_at"))
    df = frame("id int, text string", [(0, "good"), (1, "bad"), (2, "bad "), (3, "good")])
    out, new = S.score_with_cache(
        df, "text", "quick", lambda d, k, t: S.score_sentiment(d, k, t, lexicons[0]), ["sentiment"], cache.unionByName(old), 86_400, as_of,
        str(tmp_path / "new"),
    )
    assert [(r.sentiment, r.from_cache) for r in out.orderBy("id").collect()] == [("cached", True), ("negative", False), ("negative", False), ("cached", True)]
    assert new.count() == 1


def test_model_falls_back(frame, lexicons):
    df = frame("id int, text string", [(0, "good"), (1, "bad")])
    model = lambda d: d.where("id = 0").selectExpr("id", "'neutral' sentiment", "0D compound", "'fear' primary_emotion", "0.5D confidence")
    rows = S.analyze_full(df, "id", "text", lexicons, model).orderBy("id").collect()
    assert [(r.sentiment, r.primary_emotion, r.model_used) for r in rows] == [("neutral", "fear", "model"), ("negative", "neutral", "lexicon")]
