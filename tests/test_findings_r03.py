"""What a review of the third round found."""

import re
import shutil

import __spark_entry__ as entry
from compare import connect, differences
from pyspark.sql import functions as F

from moodquarry.functions.text import SPACE_CHARS, cache_key, collapse_spaces
from moodquarry.operators.cache import ScoreCache, score_through_cache
from moodquarry.operators.filters import match_keywords
from moodquarry.operators.scoring import add_analysis, lexicon_lookup, map_back, score_sentiment, score_with_cache
from moodquarry.plans.scratch import children, remove_all
from moodquarry.queries.tables import _words, stream
from moodquarry.streaming.flush import PLAIN_STORE, STORE

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_stream_of_a_folder(spark, sf, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet" / "part-0000.parquet")
    for place in (sf, str(tmp_path)):
        rows = stream(spark, place, "events").select("event_id")
        out = str(tmp_path / f"out{place == sf}")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}.state").trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_flushes_in_a_session_of_the_plain_store(spark, sf):
    plain = spark.newSession()
    plain.conf.set("spark.sql.session.timeZone", "UTC")
    plain.conf.set(STORE, PLAIN_STORE)
    got = QUERIES["flush_sizes"](plain, sf).toPandas()
    assert differences(got, connect(sf).execute(ORACLE["flush_sizes"]).df()) is None
    assert plain.conf.get(STORE) == PLAIN_STORE


def test_many_phrases_joined(spark, frame):
    texts = ["The red fox", "a fox-red (hat)", "fox", None, "red foxes", "so (red) it is", "so ((red) it", "end #x", "x#x", "the red fox", "red  fox"]
    df = frame("id int, text string", list(enumerate(texts)))
    words = ["red fox", "(red)", "fox-red (hat", "#x", "!", "foxes", "x#x"]
    ids = lambda d: sorted(r.id for r in d.select("id").collect())
    for some in (words, words[:1], words[1:2], words[3:4], words[4:]):
        assert ids(match_keywords(df, None, "text", some, 0, 0)) == ids(match_keywords(df, None, "text", some)) == ids(match_keywords(df, None, "text", some, 0))


def test_phrases_move_no_text(spark, frame):
    """A row of a large table of phrases is found without its text going to another task."""
    df = frame("id int, text string", [(1, "a b"), (2, "c")])
    plan = match_keywords(df, None, "text", ["a b", "d"], 0, 0).select("id")._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().split("\n") if "Join" in line]
    assert joins and "flatten" not in plan.toString().split("Join")[0] and "_some" not in plan.toString()


def test_large_lexicon_of_phrases(spark, frame):
    """A text of many thousand words, nearly all within terms of two or three words, beside odd ones."""
    import time

    mood = frame("term string, valence double", [("good", 1.5), ("very good", 2.5), ("bad day", -2.0), ("bad day out", 1.0), ("x y", 0.5), ("y", -1.0), ("Day", 0.7)])
    feeling = frame("term string, emotion string, weight double", [("good", "joy", 1.0), ("bad day", "sadness", 2.0), ("y", "fear", 1.0), ("y", "joy", 0.5)])
    texts = ["very good bad day out x y", "x y x y y x y", "", None, "not VERY good but a bad day", "x y x y y x y", " ".join(["x y"] * 10_000) + " good"]
    df = frame("id int, text string", list(enumerate(texts)))
    begin = time.time()
    rows = lambda most: sorted(map(str, add_analysis(df, "text", (mood, feeling), max_literal=most).drop("text").collect()))
    assert rows(1) == rows(1000)
    assert time.time() - begin < 100


def test_folders_removed(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"job_id={i}" / "x").mkdir(parents=True)
    assert children(spark, str(tmp_path)) == sorted(f"job_id={i}" for i in range(30))
    remove_all(spark, (f"{tmp_path}/job_id={i}" for i in range(1, 30)))
    remove_all(spark, [])
    assert children(spark, str(tmp_path)) == ["job_id=0"] and children(spark, f"{tmp_path}/job_id=0/x") == [] == children(spark, f"{tmp_path}/none")


def test_large_lexicon_looked_up(spark, frame):
    """Frequent tokens are not moved to the lexicon; rare, unknown, null and repeated ones get the same valence as by a small one."""
    tokens = frame("n int, token string", [(i, None if i % 10 == 0 else "often" if i % 2 else f"w{i % 40}") for i in range(3000)])
    lexicon = frame("term string, valence double", [("often", 1.0), ("often", 0.5), *((f"w{i}", float(i)) for i in range(0, 40, 4))])
    got, want = (lexicon_lookup(tokens, lexicon, max_rows=m) for m in (1, 1000))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_scored_in_batches(spark, frame):
    """Scores come from batches of words, not from array functions run word by word; odd texts score alike whichever way a lexicon is known."""
    mood = frame("term string, valence double", [("good", 1.5), ("don't", -1.0), ("very good day", 2.5), ("bad", -2.0), ("straße", 0.5), ("but", 1.0)])
    feeling = frame("term string, emotion string, weight double", [("good", "joy", 1.0), ("bad", "fear", None), ("day", "love", 2.0)])
    texts = [None, "", " !! ", "don’t be GOOD", "STRAßE good", "STRASSE GOOD bad", "not a very good day but bad", "good\x85bad\t\tgood", "‘good’ never so bad", "bad " * 5000]
    df = frame("id int, text string", list(enumerate(texts)))
    odd = spark.sql("SELECT 99 AS id, cast(x'ff20676f6f64' AS string) AS text")
    out = {most: add_analysis(df.unionByName(odd), "text", (mood, feeling), max_literal=most).drop("text") for most in (1, 4, 1000)}
    plan = out[1000]._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction(struct" not in plan
    rows = {most: sorted(map(str, got.collect())) for most, got in out.items()}
    assert rows[1] == rows[4] == rows[1000] and len(rows[1]) == len(texts) + 1
    by_id = {r.id: r for r in out[1000].collect()}
    assert by_id[99].pos > 0 and [by_id[i].compound for i in (4, 5)] == [0.4588, 0.0601] and by_id[1].neu == 1 and by_id[0].compound == 0


def test_a_scorer_reads_settled_texts(spark, frame, tmp_path):
    """Texts are cleaned and grouped once, however often a scorer reads them, and what cleaning leaves is not cleaned again."""
    mood = frame("term string, valence double", [("good", 1.5), ("bad", -2.0)])
    plans, as_of = [], F.lit("2025-01-02 00:00:00").cast("timestamp")

    def scorer(texts, key, text):
        plans.append(texts._jdf.queryExecution().optimizedPlan().toString())
        return score_sentiment(texts, key, text, mood, max_literal=1, cleaned=True)

    texts = ["good", "good ", None, "", "so bad", "ht<b>tp://x good", "good http://y", "<<a>b> bad"]
    df = frame("id int, text string", list(enumerate(texts)))
    cache = spark.range(1).select(cache_key(F.lit("so bad"), "quick").alias("cache_key"), F.lit("old").alias("sentiment"), F.lit(0.5).alias("pos"), as_of.alias("stored_at"))
    out, new = score_with_cache(df, "text", "quick", scorer, ["sentiment", "pos"], cache, 86_400, as_of)
    back = map_back(df, "text", scorer, {"sentiment": "neutral", "pos": 0.0})
    kept = ScoreCache(spark, "scores_settled", str(tmp_path / "kept"), {"sentiment": "string", "pos": "double"}, 4)
    through = score_through_cache(df, "text", "quick", scorer, kept, 86_400, as_of)
    assert len(plans) == 3
    for text in plans:
        assert "LogicalRDD" in text and not any(x in text for x in ("Aggregate", "Join", "regexp_replace", "any_value"))
    rows = {r.id: (r.sentiment, r.pos) for r in back.collect()}
    assert rows[0] == rows[1] == rows[6] == ("positive", 1.0) and rows[2] == rows[3] == ("neutral", 0.0) and rows[4] == ("negative", 0.0)
    assert rows[5] == ("positive", 0.714) and rows[7] == ("negative", 0.0)  # two words each are left: http://x good, b> bad
    assert {r.id: (r.sentiment, r.pos) for r in through.collect()} == rows
    assert {r.id: (r.sentiment, r.pos) for r in out.collect()} == {**rows, 4: ("old", 0.5)}
    assert new.count() == 4 and {r.from_cache for r in out.where("id = 4").collect()} == {True}


def test_rare_spaces_are_found_at_once(spark, frame):
    """Texts are not searched for each kind of white space; each kind is replaced still, and nothing near them."""
    near = "‧‪​‘’、᠎\x1b\x84\xa1ᚁ⁠漢é😀"
    texts = [f"a{x}b {x}{x} c" for x in SPACE_CHARS + near] + ["’a b", " a  b\n\nc\t", "", SPACE_CHARS]
    df = frame("id int, text string", list(enumerate(texts))).select("id", collapse_spaces(F.col("text")).alias("text"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 3
    want = [re.sub(f"[{re.escape(SPACE_CHARS)}]+", " ", t) for t in texts]
    assert [r.text for r in df.orderBy("id").collect()] == want


def test_words_of_the_lexicon(spark, frame, tmp_path):
    """The pattern meets different pieces of a batch, not each text, and finds the same words as often."""
    texts = ["Die Straße, die\nstraße", None, "", "  ", "a-a a-a\ta", "ÉCOLE École’s 漢字。漢", "\n", "a " * 50_000, "1 2 _x_", "ΣΑΣ Σ İ"]
    frame("text string", [(t,) for t in texts * 3]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = _words(spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.term: r.n for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term <> ''").groupBy("term").count()
    assert got == {r.term: r["count"] for r in plain.collect()} and got["a"] == 3 * 50_005
