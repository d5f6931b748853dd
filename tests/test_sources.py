import json

import pytest

from moodquarry.plans import flows
from moodquarry.plans.session import settle, shared_folder
from moodquarry.sinks import batches as B
from moodquarry.sinks import files as W
from moodquarry.sources import database as D
from moodquarry.sources import files as R
from moodquarry.sources.messages import message_posts, parse_hashtags, parse_messages


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name", ["text", "content", "Message", "review", "Comment"])
def test_text_column_is_found(spark, tmp_path, name):
    df, found = R.read_text_csv(spark, write(tmp_path / "a.csv", f'id,{name}\n1,"two\nlines, ""quoted"""\n2,\n'))
    assert found == name
    assert [r[name] for r in df.orderBy("id").collect()] == ['two\nlines, "quoted"', ""]


def test_column_order_and_case(spark, tmp_path):
    assert R.find_text_column(["Review", "Text", "content"]) == "Text"
    assert R.find_text_column(["TEXT"]) is None
    with pytest.raises(ValueError):
        R.read_text_csv(spark, write(tmp_path / "b.csv", "id,name\n1,x\n"))


def test_read_dataset_by_suffix(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "a.parquet"))
    df.write.json(str(tmp_path / "a.jsonl"))
    df.write.csv(str(tmp_path / "a.csv"), header=True)
    assert [R.read_dataset(spark, str(tmp_path / f"a.{s}")).count() for s in ("parquet", "jsonl", "csv")] == [3, 3, 3]
    with pytest.raises(ValueError):
        R.read_dataset(spark, "x.xml")


def test_csv_round_trip_keeps_text(spark, frame, tmp_path):
    texts = ["plain", ' lead and trail ', 'q"uo"te', "a,b", "line\nbreak", "back\\slash", "tab\t"]
    df = frame("i int, text string", list(enumerate(texts)))
    W.write_result_csv(df, str(tmp_path / "out"))
    back, _ = R.read_text_csv(spark, str(tmp_path / "out"))
    assert [r.text for r in back.orderBy("i").collect()] == texts


def test_sample_tree_fills_columns(spark, frame, tmp_path):
    frame("text string, sentiment string", [("a", "positive")]).write.parquet(str(tmp_path / "hf" / "x" / "y"))
    frame("text string, source string", [("b", "own")]).write.parquet(str(tmp_path / "drops"))
    df = R.read_sample_tree(spark, [str(tmp_path / "hf"), str(tmp_path / "drops")])
    assert sorted((r.text, r.sentiment, r.emotion, r.source) for r in df.collect()) == [("a", "positive", None, "static"), ("b", None, None, "own")]
    assert R.read_sample_tree(spark, [str(tmp_path / "hf")], None).first().source == "hf"


def test_jdbc_options():
    assert D.jdbc_options("u", "t", {"user": "x"}) == {"url": "u", "dbtable": "t", "user": "x"}
    options = D.jdbc_options("u", "t", {}, {"column": "id", "lower": 0, "upper": 9, "count": 3})
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "3")
    with pytest.raises(ValueError):
        D.jdbc_options("u", "t", {}, {"column": "id"})


def test_messages(spark, frame):
    good = {"id": "1", "text": "hi", "user": "u", "created_at": "Mon Dec 01 10:00:00 +0000 2025", "retweet_count": "5", "hashtags": '["a","a"]'}
    lines = [json.dumps(good), json.dumps({**good, "id": "2", "retweet_count": "many", "hashtags": "bad"}), "broken {", json.dumps({"id": "3", "created_at": "x"})]
    df = parse_messages(frame("value string", [(x,) for x in lines]))
    posts = {r.tweet_id: r for r in message_posts(df).collect()}
    assert (posts["1"].retweet_count, posts["2"].retweet_count, posts["3"].created_at) == (5, None, None)
    assert None in posts and posts["1"].created_at is not None
    tags = {r.id: r.t for r in df.select("id", parse_hashtags(df.hashtags).alias("t")).collect()}
    assert tags["1"] == ["a", "a"] and tags["2"] is None and tags["3"] is None


def test_score_csv(spark, tmp_path, lexicons):
    source = write(tmp_path / "up.csv", "Text,extra\nI love this,1\n,2\nI hate it,3\n")
    rows = {(r.metric, r.key): r["count"] for r in flows.score_csv(spark, source, str(tmp_path / "out"), lexicons).collect()}
    assert rows["total", "records"] == 3 and rows["sentiment", "neutral"] == 1
    out = R.read_csv(spark, str(tmp_path / "out"))
    assert out.columns[:2] == ["Text", "extra"] and out.count() == 3


def test_batch_writer_repeats_and_fails_loudly(spark, frame, tmp_path):
    df = frame("source string, created_at timestamp, id int", []).sparkSession.sql("SELECT 'a' source, TIMESTAMP'2025-01-01 10:00:00' created_at, 1 id")
    write_batch = B.make_batch_writer([B.parquet_sink(str(tmp_path / "p"))])
    for _ in range(2):
        write_batch(df, 7)
    write_batch(df.limit(0), 8)
    out = spark.read.parquet(str(tmp_path / "p"))
    assert [(r.id, r.source, r.hour, r.batch_id) for r in out.collect()] == [(1, "a", 10, 7)]

    def broken(_df, _id, _query):
        raise RuntimeError("sink is down")

    with pytest.raises(RuntimeError):
        B.make_batch_writer([broken])(df, 9)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert settle(spark.range(5)).count() == 5


def test_many_tasks_read_a_large_csv(spark, tmp_path, lexicons):
    source = write(tmp_path / "large.csv", "Text,n\n" + "".join(f"I love this {i},{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert R.read_dataset(spark, source, line_breaks=False).rdd.getNumPartitions() > 3
        assert R.read_dataset(spark, source).rdd.getNumPartitions() == 1
        rows = {(r.metric, r.key): r["count"] for r in flows.score_csv(spark, source, str(tmp_path / "out"), lexicons, line_breaks=False).collect()}
        assert rows["total", "records"] == 20_000 == rows["sentiment", "positive"]
        assert flows.csv_to_parquet(spark, source, str(tmp_path / "p"), "Text", line_breaks=False).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
