import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodquarry.operators import features as X
from moodquarry.operators import prepare as P
from moodquarry.plans import flows
from moodquarry.sinks import files as W


def test_emotion_codes_and_derived_sentiment(frame):
    df = frame("id int, label int", [(i, i) for i in (0, 1, 2, 3, 4, 5, 9)] + [(10, None)])
    rows = P.normalize_labels(df, emotion="label").orderBy("id").collect()
    assert [r.emotion for r in rows] == ["sadness", "joy", "joy", "anger", "fear", "surprise", "neutral", "neutral"]
    assert [r.sentiment for r in rows] == ["negative", "positive", "positive", "negative", "negative", "neutral", "neutral", "neutral"]


def test_sentiment_comes_from_the_raw_emotion(frame):
    df = frame("label string", [("love",), ("Trust",), ("odd",), ("Disgust",)])
    rows = P.normalize_labels(df, emotion="label").collect()
    assert [(r.sentiment, r.emotion) for r in rows] == [("positive", "neutral"), ("positive", "neutral"), ("neutral", "neutral"), ("negative", "disgust")]


def test_sentiment_codes_maps_and_errors(frame):
    df = frame("s string, e string", [("0", "x"), ("1", "y"), ("2", "joy"), ("4", "z"), ("POSITIVE", "x"), ("odd", "x"), (None, "x")])
    rows = P.normalize_labels(df, sentiment="s", emotion="e", maps={"emotion": {"x": "fear"}}).collect()
    assert [r.sentiment for r in rows] == ["negative", "neutral", "positive", "positive", "positive", "neutral", "neutral"]
    assert [r.emotion for r in rows][:4] == ["fear", "neutral", "joy", "neutral"]
    assert P.normalize_labels(df, sentiment="s", codes=None).first().sentiment == "neutral"
    with pytest.raises(ValueError):
        P.normalize_labels(df, derive=False)


def test_align_columns(frame):
    df = frame("body string, label string", [("a", "positive"), (None, "positive"), ("b", None)])
    assert [tuple(r) for r in P.align_columns(df, "body", "label").collect()] == [("a", "positive", "neutral")]
    with pytest.raises(ValueError):
        P.align_columns(df, "text", "label")


def test_dedup_keeps_the_smallest_key(frame):
    rows = [(5, " same "), (3, "same"), (4, "same "), (1, "abc"), (2, "abcd"), (6, None), (7, "Same"), (8, "ABCD")]
    df = frame("id int, text string", rows)
    once = P.dedup_text(df, "id")
    assert sorted((r.id, r.text) for r in once.collect()) == [(2, "abcd"), (3, "same"), (7, "Same"), (8, "ABCD")]
    assert once.select("id").exceptAll(P.dedup_text(once.drop("text_hash"), "id").select("id")).count() == 0


def test_dedup_hot_copies(frame, spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), (F.col("id") % 500).cast("string"))).alias("text"))
    got = P.dedup_text(df, "id").select("id").collect()
    seen, want = set(), []
    for i in range(30_000):
        t = "hot text" if i % 3 == 0 else f"text {i % 500}"
        if t not in seen:
            seen.add(t)
            want.append(i)
    assert sorted(r.id for r in got) == want


def brute_split(rows, first, second, smallest, seed=42):
    out = {}
    for label in {l for _, l in rows if l is not None}:
        ids = sorted((i for i, l in rows if l == label), key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())
        n = len(ids)
        for at, i in enumerate(ids):
            out[i] = "train" if n < smallest or at < int(n * first) else "val" if at < int(n * second) else "test"
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["positive", "negative", "neutral", None, "odd"]), min_size=1, max_size=120), st.sampled_from([0, 10]))
def test_split_equals_brute_force(spark, labels, smallest):
    rows = list(enumerate(labels))
    df = spark.createDataFrame(rows, "id int, label string")
    got = {r.id: r.split for r in P.stratified_split(df, "label", "id", (0.7, 0.15), smallest).collect()}
    assert got == brute_split(rows, 0.7, 0.7 + 0.15, smallest)


def test_split_sizes_of_a_large_class(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.lit("x").alias("more"))
    got = P.stratified_split(df, "label", "id", (0.8, 0.1), 0)
    assert got.columns == ["id", "label", "more", "split"]
    counts = {(r.label, r.split): r["count"] for r in got.groupBy("label", "split").count().collect()}
    n = df.where("label = 'a'").count()
    assert counts["a", "train"] == int(n * 0.8) and counts["a", "val"] == int(n * (0.8 + 0.1)) - int(n * 0.8)
    assert sum(counts.values()) == 20_000
    hashed = P.stratified_split(df, "label", "id", mode="hash").groupBy("split").count().collect()
    assert abs({r.split: r["count"] for r in hashed}["train"] / 20_000 - 0.7) < 0.02


def test_split_with_one_hot_key(spark):
    """A third of the rows share a key: they stay together, and no task ranks them one by one."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), F.lit("a").alias("label"))
    got = P.stratified_split(df, "label", "key")
    assert got.count() == 9000 and got.where("key = -1").select("split").distinct().count() == 1


def test_random_split_size(spark):
    df = spark.range(1001)
    counts = {r.split: r["count"] for r in P.random_split(df, 0.9, "id").groupBy("split").count().collect()}
    assert counts == {"train": 900, "val": 101}
    assert {r.split for r in P.random_split(df, 1.0, "id").collect()} == {"train"}


def test_vocab_order_and_size(frame):
    df = frame("t string", [("b b a a c c c once http://u <tag>",), ("d! d! e. e.",)])
    rows = X.build_vocab(df, "t").orderBy("id").collect()
    assert [(r.token, r.id) for r in rows] == [("<PAD>", 0), ("<UNK>", 1), ("<BOS>", 2), ("<EOS>", 3), ("c", 4), ("a", 5), ("b", 6), ("d!", 7), ("e.", 8)]
    assert X.build_vocab(df, "t", max_size=6).count() == 6
    assert X.build_vocab(df, "t", max_size=2).count() == 4


@pytest.mark.parametrize("bound", [50_000, 1])
def test_encode_lengths(frame, bound):
    vocab = frame("token string, id int, n bigint", [("<PAD>", 0, None), ("a", 4, 2), ("b", 5, 2)])
    df = frame("id int, t string", [(0, "a b"), (1, "a b zzz a b"), (2, ""), (3, None), (4, "a b a")])
    rows = X.encode(df, "id", "t", vocab, 5, max_literal=bound).orderBy("id").collect()
    assert [list(r.input_ids) for r in rows] == [[2, 4, 5, 3, 0], [2, 4, 5, 1, 4], [2, 3, 0, 0, 0], [2, 3, 0, 0, 0], [2, 4, 5, 4, 3]]
    assert [sum(r.attention_mask) for r in rows] == [4, 5, 2, 2, 5]
    free = X.encode(df, "id", "t", vocab, None, max_literal=bound).orderBy("id").collect()
    assert {len(r.input_ids) for r in free} == {7} and list(free[1].input_ids) == [2, 4, 5, 1, 4, 5, 3]
    plain = X.encode(df, "id", "t", vocab, 3, special=False, max_literal=bound).orderBy("id").collect()
    assert [list(r.input_ids) for r in plain] == [[4, 5, 0], [4, 5, 1], [0, 0, 0], [0, 0, 0], [4, 5, 4]]


def test_prepare_dataset_end_to_end(spark, tmp_path):
    rows = [(f"text number {i % 90}", ["Positive", "negative", None][i % 3], "joy") for i in range(270)]
    spark.createDataFrame(rows, "text string, sentiment string, emotion string").write.parquet(str(tmp_path / "raw" / "hf" / "deep"))
    counts = {(r.metric, r.key): r["count"] for r in flows.prepare_dataset(spark, [str(tmp_path / "raw" / "hf")], str(tmp_path / "out")).collect()}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert counts["source", "static"] == 270
    assert sum(c for (m, _), c in counts.items() if m == "split") == out.count() == 60
    assert out.select("text_hash").distinct().count() == 60
    assert set(r.sentiment for r in out.select("sentiment").distinct().collect()) == {"positive", "negative"}


def test_write_upsert_touches_only_its_folders(spark, frame, tmp_path):
    path = str(tmp_path / "hourly")
    frame("k int, n int, day string", [(1, 1, "a"), (2, 2, "a"), (3, 3, "b")]).write.partitionBy("day").parquet(path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "hourly" / "day=b").glob("*.parquet")}
    W.write_upsert(spark, path, frame("k int, n int, day string", [(2, 20, "a"), (4, 40, "c")]), ["k"], "day")
    assert sorted((r.k, r.n, r.day) for r in spark.read.parquet(path).collect()) == [(1, 1, "a"), (2, 20, "a"), (3, 3, "b"), (4, 40, "c")]
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "hourly" / "day=b").glob("*.parquet")}


def test_write_upsert_empties_folders_with_escaped_names(spark, frame, tmp_path):
    path, schema = str(tmp_path / "a b%"), "k int, n int, day string"
    names = ["a:b", "c/d", "e=f", "50%", "g#h i?", "ü", None]
    frame(schema, [*((i, 1, d) for i, d in enumerate(names)), (99, 1, "a:b")]).write.partitionBy("day").parquet(path)
    W.write_upsert(spark, path, frame(schema, [(i, 2, "new:x") for i in range(len(names))]), ["k"], "day")
    want = [(i, 2, "new:x") for i in range(len(names))] + [(99, 1, "a:b")]
    assert sorted(map(tuple, spark.read.schema(schema).parquet(path).collect())) == want
    assert sorted(f.name for f in (tmp_path / "a b%").glob("day=*")) == ["day=a%3Ab", "day=new%3Ax"]


def test_write_upsert_empties_folders_read_as_another_type(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1, "01"), (2, 1, "02")], "k int, n int, hour string")
    rows.write.partitionBy("hour").parquet(path)
    W.write_upsert(spark, path, spark.createDataFrame([(1, 2, 2)], "k int, n int, hour int"), ["k"], "hour")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 2, 2), (2, 1, 2)]
