"""What a review of the fourth round found."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from moodquarry.queries import streams as Q
from moodquarry.streaming import control as C
from moodquarry.streaming import flush as FL


class _Held:
    """What a state store keeps for one key."""

    def __init__(self):
        self.timers, self.rows, self.value = [], [], None

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        other = _Held()
        other.get, other.exists, other.update = lambda: other.value, lambda: other.value is not None, lambda v: setattr(other, "value", v)
        return other

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):
        self.rows = self.rows + rows

    def clear(self):
        self.rows = []

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 0


def test_flushes_leave_while_rows_still_come():
    """A buffer gives its flushes on before it has read all rows of a batch, and holds what is left."""
    import pandas as pd
    import pyarrow as pa

    seen, state = [], _Held()

    def frames():
        for i in range(100):
            seen.append(i)
            batch = pa.RecordBatch.from_pydict({"id": list(range(i * 10, i * 10 + 10)), "_buffer": ["0"] * 10})
            yield pd.concat(b.to_pandas() for b in FL._pack([batch]))

    buffer = FL._Buffer(7, 1)
    buffer.init(state)
    out = buffer.handleInputRows(("0",), frames(), state)
    first = next(out)
    assert len(seen) == 1
    flushed = pd.concat([first, *out])
    rows = [r for p in flushed.piece for r in FL._unpacked(p).to_pydict()["id"]]
    assert rows == list(range(994)) and set(flushed.flush_rows) == {7} and flushed.flush.max() == 141
    assert state.timers == [1000] and sum(n for n, _ in state.rows) == 6
    last = pd.concat(buffer.handleExpiredTimer(("0",), state, None))
    assert [r for p in last.piece for r in FL._unpacked(p).to_pydict()["id"]] == list(range(994, 1000))
    assert set(last.flush) == {142} and set(last.flush_cause) == {"time"} and state.rows == []


def test_buffers_go_to_tasks_without_this_library():
    pickled = cloudpickle.dumps((FL._Buffer(10, 1), FL._pack, FL._unpack))
    code = "import sys, pickle; x = pickle.loads(bytes.fromhex(sys.stdin.read())); assert 'moodquarry' not in sys.modules; print(x[0].limit)"
    done = subprocess.run([sys.executable, "-c", code], input=pickled.hex(), capture_output=True, text=True, cwd="/")
    assert done.stdout == "10\n", done.stderr


def test_flushed_rows_keep_their_values(spark, tmp_path):
    """Nested, missing and large values, in buffers of which one has no name."""
    rows = spark.range(500).selectExpr(
        "id", "if(id % 3 = 0, null, id + 1152921504606846976) AS n", "array(id, null) AS a", "map('k', id) AS m", "struct(cast(id AS decimal(20, 3)) AS d) AS s",
        "timestamp_seconds(id) AS at", "if(id % 7 = 0, repeat('é', 9000), null) AS t",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    buffer = F.when(F.col("id") % 5 > 0, F.col("id") % 5)
    query = C.start_flushes(stream, "kept_values", str(tmp_path / "out"), str(tmp_path / "state"), 30, 2, "500 milliseconds", buffer)
    read = lambda: spark.read.schema(f"{rows.schema.toDDL()}, buffer int, flush bigint, flush_rows bigint, flush_cause string, query string").parquet(str(tmp_path / "out"))
    try:
        for _ in range(120):
            query.awaitTermination(0.5)
            assert not query.exception()
            if (tmp_path / "out").exists() and read().count() == 500:
                break
    finally:
        query.stop()
    got = read()
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert got.where(F.col("buffer").eqNullSafe(buffer)).count() == 500
    sizes = sorted((r.buffer or 0, r.flush, r.flush_rows, r["count"], r.flush_cause) for r in got.groupBy("buffer", "flush", "flush_rows", "flush_cause").count().collect())
    assert sizes == [(b, f, *((30, 30, "rows") if f < 3 else (10, 10, "time"))) for b in range(5) for f in range(4)]


def _slow(monkeypatch, spark, busy, after):
    """A stream that flushes all after so many looks at it."""

    class Slow:
        looks, stopped = 0, False
        status = {"isDataAvailable": busy}

        def __init__(self, df, name, out, *_):
            self.out = out

        def awaitTermination(self, _):
            self.looks += 1
            if self.looks == after:
                root = self.out.rsplit("/", 1)[0]
                lines = spark.read.text(f"{root}/in").withColumns({"query": F.lit("q"), "ingest_date": F.lit("2024-01-01"), "ingest_hour": F.lit(1)})
                lines.write.partitionBy("query", "ingest_date", "ingest_hour").parquet(self.out)

        def exception(self):
            return None

        def stop(self):
            pass

    monkeypatch.setattr(C, "start_flushes", Slow)


def test_a_long_batch_is_waited_for(spark, sf, monkeypatch):
    _slow(monkeypatch, spark, True, 300)
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 3 > 0").count()
    assert Q._flushed(spark, sf, "slow").count() == events


def test_an_idle_stream_is_an_error(spark, sf, monkeypatch):
    _slow(monkeypatch, spark, False, 10_000)
    with pytest.raises(TimeoutError, match="0 of"):
        Q._flushed(spark, sf, "idle")


def test_a_stream_knows_a_large_lexicon_in_the_row(spark, tmp_path, lexicons):
    from moodquarry.sources.schemas import POST
    from moodquarry.streaming import posts as P

    texts = ["good zz7", "not zz59999 sure", "a very good zz1 two", "", None, "élan zz-none"]
    rows = [(str(i), t, "u", None, 1, 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "tweet_id string, text string, author_id string, created_at timestamp, retweet_count bigint, like_count bigint").write.parquet(str(tmp_path / "in"))
    more = spark.range(60_000).selectExpr("concat('zz', id) AS term", "1.0D + id % 3 AS valence", "'joy' AS emotion", "2.0D AS weight")
    more = more.unionByName(spark.createDataFrame([("zz1 two", -3.0, "fear", 4.0), ("élan", 0.5, "anger", 1.0)], more.schema))
    many = lexicons[0].unionByName(more.select("term", "valence")), lexicons[1].unionByName(more.select("term", "emotion", "weight"))
    stream = spark.readStream.schema(POST).parquet(str(tmp_path / "in")).withColumn("source", F.lit("twitter"))
    scored = P.score_stream(stream, many, in_row=True)
    query = C.start_files(scored, "large_in_row", str(tmp_path / "out"), None, str(tmp_path / "state"))
    query.awaitTermination()
    assert not query.exception()
    table = spark.read.schema(POST).parquet(str(tmp_path / "in")).withColumn("source", F.lit("twitter"))
    for want in (P.score_stream(table, many), P.score_stream(table, many, max_literal=100_000)):
        assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_known_words_by_hash():
    import numpy as np
    import pyarrow as pa

    from moodquarry.operators import word_rules as W

    words = W.as_bytes([f"w{i}" for i in range(W.FEW)] + ["", "é", "ab", "ba"])
    known, order = W.Known.of(words)
    assert known.hashes is not None and known.words.to_pylist() == [words[int(i)].as_py() for i in order]
    asked = W.as_bytes(["ba", "w17", "none", "", "é", "w4999", "w5000", "ab"])
    want = W.places(asked, known.words)
    assert known.at(asked).tolist() == want.tolist() == known.at(pa.concat_arrays([asked, asked]).slice(8)).tolist() and (want < 0).sum() == 2
    assert known.at(asked.slice(0, 0)).tolist() == [] and np.array_equal(W.hashes(W.as_bytes(["", ""]), 3), np.zeros(2, np.uint64))


def test_phrases_are_found_in_batches(spark, frame):
    """Many phrases, of one to four words and with signs, in texts of odd letters, the same by all ways; the rows' runs are not taken apart."""
    import random

    from moodquarry.operators.filters import match_keywords

    draw = random.Random(4)
    words = ["a", "bé", "ça", "x_1", "日本", "ß", "𝒳y", "ü", "n²", "ⅷ", "z"]
    between = [" ", " ", " ", "-", "  ", "'", "…", " (", ") ", "\n", "😀"]
    some = lambda n: "".join(draw.choice(words) + draw.choice(between) for _ in range(n))
    texts = [some(draw.randrange(12)) for _ in range(400)] + ["", None, "a", "日", " a", "A BÉ", "😀", "bé"]
    phrases = sorted({draw.choice(["", "", "(", "😀"]) + some(draw.randrange(1, 5))[: draw.choice([-1, None])] for _ in range(150)} | {"😀😀"})
    df = frame("id int, text string", list(enumerate(texts)))
    ids = lambda d: sorted(r.id for r in d.select("id").collect())
    for few in (phrases, phrases[::9]):
        want = ids(match_keywords(df, None, "text", few, 1000))
        assert ids(match_keywords(df.repartition(3), None, "text", few, 0)) == want and 10 < len(want) < 390
    assert "regexp_extract_all" not in match_keywords(df, None, "text", phrases, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert ids(match_keywords(df.where("id < 0"), None, "text", phrases, 0)) == [] == ids(match_keywords(df, None, "text", ["…😀…" * 9], 0))


def test_pairs_are_counted_by_bucket(spark, sf):
    """The pairs of a lexicon of phrases are those that rows of single pairs give, and only packed parts are moved."""
    from moodquarry.functions.text import clean_text
    from moodquarry.operators import scoring as S
    from moodquarry.queries.scoring import _phrase_lexicon
    from moodquarry.queries.tables import text_table

    low = F.transform(S.split_words(S.plain_apostrophes(clean_text("text", None))), F.lower)
    words = text_table(spark, sf, "documents").select(low.alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("term"))
    want = {r.term for r in pairs.groupBy("term").count().where("count >= 20").collect()}
    lexicon = _phrase_lexicon(spark, sf)
    assert {r.term for r in lexicon.where(F.contains("term", F.lit(" "))).collect()} == want and len(want) > 10
    assert "MapInArrow" in lexicon._jdf.queryExecution().optimizedPlan().toString()


def test_stretches_counted_over_batches():
    import pyarrow as pa

    from moodquarry.operators import word_rules as W

    texts = ["a b a b", "", "x", None, "a  b (c)", "é ü é ü é"]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["t"]) for t in (texts, [], [""], texts)]
    parts = pa.Table.from_batches(W.counted(iter(batches), "()", 2)).sort_by("bucket").to_batches(max_chunksize=2)
    at_least = lambda n: sorted(t for b in W.added_up(iter(parts), n) for t in b.column(0).to_pylist())
    assert at_least(1) == ["a b", "b a", "b c", "é ü", "ü é"] and at_least(3) == ["a b", "é ü", "ü é"] and at_least(6) == ["a b"] and at_least(7) == []
    assert at_least(1) == at_least(2) and list(W.added_up(iter([]), 1)) == []
