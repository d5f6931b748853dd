import datetime

from pyspark.sql import functions as F

from moodquarry.operators import filters as FL
from moodquarry.operators import jobs as J
from moodquarry.operators import ordering as O
from moodquarry.operators import screen as SC
from moodquarry.operators import stats as S
from moodquarry.operators import tables as T
from moodquarry.sources.search_pages import PAGE_SCHEMA, attach_authors, flatten_search_pages

DAY = datetime.datetime(2025, 1, 1)


def summary(df):
    return {(r.metric, r.key): (r["count"], r.value) for r in S.batch_summary(df).collect()}


def test_batch_summary_of_four_rows(frame):
    df = frame(
        "Sentiment string, Compound_Score double, Primary_Emotion string, Emotion_Confidence double",
        [("positive", 0.8, "joy", 0.9), ("positive", 0.6, "joy", 0.8), ("negative", -0.7, "anger", 0.7), ("neutral", 0.0, "neutral", 0.6)],
    )
    got = summary(df)
    assert got["total", "records"][0] == 4
    assert [got["sentiment", s] for s in ("positive", "negative", "neutral")] == [(2, 50.0), (1, 25.0), (1, 25.0)]
    assert got["emotion", "joy"] == (2, 50.0)
    assert got["average", "Compound_Score"][1] == 0.175 and got["average", "Emotion_Confidence"][1] == 0.75
    assert ("average", "Positive_Score") not in got


def test_batch_summary_without_rows(frame):
    got = summary(frame("Sentiment string, Compound_Score double", []))
    assert got == {("total", "records"): (0, None), ("sentiment", "positive"): (0, None), ("sentiment", "negative"): (0, None),
                   ("sentiment", "neutral"): (0, None), ("average", "Compound_Score"): (0, None)}


def posts(frame, rows):
    schema = "source string, created_at timestamp, sentiment string, primary_emotion string, compound_score double, confidence double"
    return frame(schema, rows)


def test_hourly_stats_join_null_and_unknown(frame):
    df = posts(frame, [
        ("twitter", DAY, "positive", None, 0.5, 0.2), ("twitter", DAY, "negative", "unknown", -0.5, None),
        ("twitter", DAY, "neutral", "joy", None, 0.4), ("reddit", DAY + datetime.timedelta(hours=1), "positive", "joy", 1.0, 1.0),
    ])
    rows = {r.source: r for r in S.hourly_source_stats(df).collect()}
    t = rows["twitter"]
    assert t.emotion_counts == {"unknown": 2, "joy": 1}
    assert (t.total_count, t.positive_count, t.negative_count, t.neutral_count) == (3, 1, 1, 1)
    assert t.avg_compound_score == 0.0 and abs(t.avg_confidence - 0.3) < 1e-12


def test_upsert_and_insert(frame):
    old = frame("source string, hour_bucket timestamp, n int", [("a", DAY, 1), ("b", DAY, 2)])
    new = frame("source string, hour_bucket timestamp, n int", [("b", DAY, 20), ("c", DAY, 30)])
    assert sorted((r.source, r.n) for r in T.upsert_hourly(old, new).collect()) == [("a", 1), ("b", 20), ("c", 30)]
    again = T.upsert_hourly(T.upsert_hourly(old, new), new)
    assert sorted((r.source, r.n) for r in again.collect()) == [("a", 1), ("b", 20), ("c", 30)]
    fresh = new.unionByName(frame("source string, hour_bucket timestamp, n int", [("c", DAY, 29)]))
    assert [(r.source, r.n) for r in T.insert_new(old, fresh, ["source", "hour_bucket"], "n").collect()] == [("c", 29)]


def test_hashtags_count_twice_and_skip_bad(frame):
    df = frame("created_at timestamp, hashtags string, sentiment string", [
        (DAY, '["a","a"]', "positive"), (DAY, '["b"]', "negative"), (DAY, "[]", "neutral"), (DAY, None, "neutral"), (DAY, "bad", "neutral"),
    ])
    rows = S.trending_hashtags(df, F.lit(DAY), F.lit(DAY), 5).collect()
    assert [(r.hashtag, r.tweet_count, r.positive_count, r.negative_count) for r in rows] == [("a", 2, 2, 0), ("b", 1, 0, 1)]


def test_best_epoch_takes_the_first_of_ties(frame):
    df = frame("run_id int, epoch int, val_loss double, sentiment_acc double, emotion_acc double",
               [(1, 1, 0.5, 0.1, 0.1), (1, 2, 0.4, 0.2, 0.2), (1, 3, 0.4, 0.3, 0.3), (1, 4, None, 0.9, 0.9)])
    (row,) = S.best_epoch(df).collect()
    assert (row.epoch, row.sentiment_acc) == (2, 0.2)


def test_models_without_score_come_last(frame):
    models = frame("name string, version string, architecture string, accuracy double, f1_macro double, f1_weighted double, is_production boolean, training_dataset_id int",
                   [("a", "1", "x", 0.1, 0.1, None, True, 1), ("b", "1", "x", 0.1, 0.1, 0.5, True, 9), ("c", "1", "x", 0.1, 0.1, 0.7, False, 1)])
    datasets = frame("id int, name string, total_samples int", [(1, "d", 10)])
    assert [(r.name, r.dataset_name) for r in T.model_comparison(models, datasets).collect()] == [("c", "d"), ("b", None), ("a", "d")]


def test_screen(frame):
    texts = [None, "", "  ", "x" * 5001, " <b>hi</b> ", "<script src", "a onclick = 1", "JavaScript:x", "eval (1)", "fine", "<i></i>"]
    rows = SC.screen_text(frame("id int, t string", list(enumerate(texts))), "t", 5000).orderBy("id").collect()
    assert [r.reason for r in rows] == ["missing", "missing", "blank", "too long", None] + ["suspicious"] * 4 + [None, None]
    assert rows[4].clean == "hi" and rows[10].clean == ""


def test_screen_batch(frame):
    df = frame("b int, i int, t string", [(1, 0, "ok"), (1, 1, ""), (1, 2, " "), (2, 0, "ok"), (3, 0, "a"), (3, 1, "b"), (3, 2, "c"), (3, 3, "d")])
    rows = {r.b: (r.valid, r.reason, r.bad_position) for r in SC.screen_batch(df, "b", "i", "t", 3).collect()}
    assert rows == {1: (False, "missing", 1), 2: (True, None, None), 3: (False, "too many texts", None)}


def test_validate(frame):
    good = frame("Text string", [("a",), ("b",)])
    check = lambda df, name="x.csv", **o: SC.validate_dataset(df, name, **o).first()
    assert (check(good).valid, check(good).row_count, check(good).text_column) == (True, 2, "Text")
    assert check(frame("id int, name string", [(1, "a")])).valid is False
    assert check(good, "x.txt").reason == "not a CSV file"
    assert check(good, size_bytes=0).reason == "file is empty"
    assert check(good, size_bytes=200, max_bytes=100).reason == "file too large"
    assert check(good, max_rows=1).reason == "too many rows"
    assert check(frame("text string", [])).reason == "no data"
    assert check(good, size_bytes=10**12, max_rows=None, max_bytes=None).valid


def test_originals_and_keywords(frame):
    df = frame("id int, refs array<struct<type:string>>, t string", [(1, None, "Red cat"), (2, [], "redcat"), (3, [("quoted",)], "a RED-dog"), (4, [("replied_to",)], "x")])
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(FL.originals_only(df, "refs")) == [1, 2]
    assert ids(FL.originals_only(df, "refs", ["replied_to"])) == [1, 2, 3]
    for bounds in ((50, 50), (0, 50), (0, 0)):
        assert ids(FL.match_keywords(df, "id", "t", ["red", "none"], *bounds)) == [1, 3]
    assert ids(FL.match_keywords(df, "id", "t", ["red cat"])) == [1]
    many = [f"word{i} x" for i in range(120)] + ["red cat", "red-dog"]
    for bounds in ((50, 50_000), (7, 50_000), (7, 0)):
        assert ids(FL.match_keywords(df, "id", "t", many, *bounds)) == [1, 3]
        assert ids(FL.match_keywords(df, "id", "t", [*many, "x"], *bounds)) == [1, 3, 4]
    assert ids(FL.match_keywords(df, "id", "t", [])) == []


def test_upsert_of_null_moved_and_repeated_keys(spark, frame, tmp_path):
    from moodquarry.sinks.files import write_upsert

    schema, path = "k int, v string, day string", str(tmp_path / "t")
    frame(schema, [(1, "old", "a"), (2, "old", None), (3, "old", "b"), (None, "old", "a"), (4, "only", "c")]).write.partitionBy("day").parquet(path)
    fresh = frame(schema, [(1, "new", "b"), (None, "new", "a"), (5, "new", None), (6, "low", "b"), (6, "top", "b"), (4, "new", "a")])
    write_upsert(spark, path, fresh, ["k"], "day", "v")
    got = sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()), key=str)
    want = [(1, "new", "b"), (2, "old", None), (3, "old", "b"), (None, "new", "a"), (4, "new", "a"), (5, "new", None), (6, "top", "b")]
    assert got == sorted(want, key=str)


def test_rows_without_a_key_are_split_like_others(frame):
    from moodquarry.operators.prepare import stratified_split

    df = frame("label string, key string, n int", [("x", None, i) for i in range(1000)])
    for mode in ("exact", "hash"):
        parts = {r.split: r["count"] for r in stratified_split(df, "label", "key", mode=mode).groupBy("split").count().collect()}
        assert 600 < parts["train"] < 800 and 80 < parts["test"] < 220


def test_intervals_and_pages(frame):
    df = frame("id int, created_at timestamp", [(i, DAY + datetime.timedelta(minutes=10 * i)) for i in range(13)])
    hour = FL.last_interval(df, "created_at", F.lit(DAY + datetime.timedelta(minutes=120)))
    assert sorted(r.id for r in hour.collect()) == list(range(6, 13))
    pages = [[r.id for r in O.page(df, [F.desc("created_at"), F.col("id")], n, 5).collect()] for n in (1, 2, 3, 4)]
    assert pages == [[12, 11, 10, 9, 8], [7, 6, 5, 4, 3], [2, 1, 0], []]
    last = O.page_after(df, "created_at", "id", None, 5).collect()[-1]
    assert [r.id for r in O.page_after(df, "created_at", "id", (last.created_at, last.id), 5).collect()] == pages[1]


def test_job_metrics(frame):
    h = datetime.timedelta(hours=1)
    df = frame("status string, total_records bigint, processed_records bigint, started_at timestamp, completed_at timestamp", [
        ("completed", 0, 0, DAY, DAY + h), ("completed", 3, 7, DAY, DAY + h), ("processing", 3, 1, DAY, None), ("pending", 3, 0, None, None),
    ])
    rows = J.job_metrics(df, F.lit(DAY + 2 * h)).collect()
    assert [(r.progress_percent, r.duration_seconds) for r in rows] == [(0, 3600.0), (100, 3600.0), (33, 7200.0), (0, None)]
    expired, kept = J.expired_jobs(df, 7, F.lit(DAY + datetime.timedelta(days=8)))
    assert (expired.count(), kept.count()) == (2, 2)


def test_search_pages(frame, spark):
    page = ([("1", "t1", "u1", None, None, None, {"retweet_count": 3}), ("2", "t2", "u9", None, None, None, None)],
            ([("u1", "old", "o", True), ("u1", "new", "n", None)],), ("next", 2))
    df = spark.createDataFrame([page, (page[0], None, None)], PAGE_SCHEMA)
    rows = flatten_search_pages(df).collect()
    assert [(r.id, r.username, r.verified, r.retweets, r.likes) for r in rows] == [
        ("1", "n", False, 3, 0), ("2", None, False, 0, 0), ("1", None, False, 3, 0), ("2", None, False, 0, 0)]
    assert flatten_search_pages(df, 3).count() == 3


def test_attach_authors(frame):
    posts_ = frame("id int, author_id int", [(1, 7), (2, 8), (3, None)])
    users = frame("id int, name string, username string", [(7, "A", "a"), (7, "A", "a")])
    rows = attach_authors(posts_, users).orderBy("id").collect()
    assert [(r.username, r.verified) for r in rows] == [("a", False), (None, False), (None, False)]


def test_profile_counts_whole_table(frame):
    rows = [("a" if i % 3 == 0 else f"v{i}", i % 2, i) for i in range(300)]
    got = S.profile_columns(frame("s string, two int, id int", rows), 2).collect()
    assert {(r.column, r.value, r["count"]) for r in got if r["rank"] == 1 and r.column == "s"} == {("s", "a", 100)}
    assert {(r.value, r["count"]) for r in got if r.column == "two"} == {("0", 150), ("1", 150)}
    assert not [r for r in got if r.column == "id"]


def test_user_activity_zero(frame):
    users, some = frame("user_id int", [(1,), (2,)]), frame("user_id int", [(1,), (1,)])
    assert sorted(tuple(r) for r in S.user_activity(users, some, some.limit(0)).collect()) == [(1, 2, 0), (2, 0, 0)]


def test_runs_are_logged_and_listed(spark, frame, tmp_path):
    path = str(tmp_path / "runs")
    for i in (1, 2, 3):
        J.log_run(frame("id int, run_name string, started_at timestamp, other int", [(i, f"r{i}", DAY + datetime.timedelta(days=i), 0)]), path)
    rows = J.run_history(spark.read.parquet(path), 2).collect()
    assert [r.id for r in rows] == [3, 2] and rows[0].asDict().keys() == {"id", "run_name", "started_at"}
    assert [r.id for r in J.run_history(frame("id int, status string", [(1, "a"), (5, "b")])).collect()] == [5, 1]
