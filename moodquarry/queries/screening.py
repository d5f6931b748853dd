"""Filters, checks, orders and pages."""

from pyspark.sql import functions as F

from moodquarry.operators import filters as FL
from moodquarry.operators import jobs as J
from moodquarry.operators import ordering as O
from moodquarry.operators import screen as S
from moodquarry.plans.scratch import children, new_folder
from moodquarry.queries import query
from moodquarry.queries.tables import (
    AS_OF, END, START, analyses, jobs, ntz, posts, r6, samples, sql, sql_strip, stamp, table, texts,
)


@query("min_length", sql("samples", f"SELECT doc_id, source FROM samples WHERE length({sql_strip('text')}) > 3"))
def min_length(spark, sf):
    return S.min_length(samples(spark, sf), "text").select("doc_id", "source")


@query(
    "complete_rows",
    sql("samples", "SELECT doc_id, sentiment FROM samples WHERE text IS NOT NULL AND sentiment IS NOT NULL AND emotion IS NOT NULL"),
)
def complete_rows(spark, sf):
    return S.complete_rows(samples(spark, sf), ["text", "sentiment", "emotion"]).select("doc_id", "sentiment")


_SCREENED = f"""
    SELECT key, t, reason, CASE WHEN reason IS NULL THEN c END AS clean FROM (
        SELECT key, t, c, CASE WHEN text IS NULL OR text = '' THEN 'missing' WHEN t = '' THEN 'blank'
                               WHEN length(t) > 5000 THEN 'too long'
                               WHEN regexp_matches(c, '(?i)<script|javascript:|on[\\p{{L}}\\p{{N}}_]+\\s*=|eval\\s*\\(|document\\.|window\\.|location\\.')
                               THEN 'suspicious' END AS reason
        FROM (SELECT key, text, t, {sql_strip("regexp_replace(t, '<[^>]+>', '', 'g')")} AS c
              FROM (SELECT key, text, {sql_strip('text')} AS t FROM texts)))"""


@query("screen_text", sql("texts", "SELECT key, reason IS NULL AS valid, reason, clean FROM screened", screened=_SCREENED))
def screen_text(spark, sf):
    return S.screen_text(texts(spark, sf), "text", S.MAX_TEXT).select("key", "valid", "reason", "clean")


@query(
    "screen_batch",
    sql(
        "texts",
        """SELECT conv_id, n_texts, n_texts <= 4 AND bad IS NULL AS valid,
                  CASE WHEN n_texts > 4 THEN 'too many texts' ELSE reason END AS reason,
                  coalesce(CASE WHEN n_texts <= 4 THEN bad END, -1) AS bad_position
           FROM (SELECT conv_id, count(*) AS n_texts, min(turn) FILTER (reason IS NOT NULL) AS bad,
                        arg_min(reason, turn) FILTER (reason IS NOT NULL) AS reason
                 FROM (SELECT c.conv_id, c.turn, s.reason FROM conversations c
                       JOIN screened s ON s.key = 'c' || c.conv_id || '.' || c.turn)
                 GROUP BY conv_id)""",
        screened=_SCREENED.replace("5000", "150"),
    ),
)
def screen_batch(spark, sf):
    return S.screen_batch(table(spark, sf, "conversations"), "conv_id", "turn", "text", 4, 150).na.fill(-1, ["bad_position"])


@query(
    "validate_dataset",
    """SELECT n <= 100000 AS valid, CASE WHEN n > 100000 THEN 'too many rows' END AS reason, n AS row_count,
              'text' AS text_column, 'conv_id,turn,role,text' AS columns FROM (SELECT count(*) AS n FROM conversations)""",
)
def validate_dataset(spark, sf):
    return S.validate_dataset(table(spark, sf, "conversations"), "upload.csv", max_rows=S.MAX_ROWS)


@query("originals_only", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def originals_only(spark, sf):
    # Clicks count as reposts, views as replies, errors as quotes, the rest as posts of their own.
    kind = F.col("event_type")
    refs = F.when(kind == "click", "retweeted").when(kind == "view", "replied_to").when(kind == "error", "quoted")
    df = table(spark, sf, "events").withColumn("refs", F.when(refs.isNotNull(), F.array(F.struct(refs.alias("type")))))
    return FL.originals_only(df, "refs", ["retweeted", "replied_to"]).select("event_id", "event_type")


@query("match_language", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def match_language(spark, sf):
    return FL.match_language(table(spark, sf, "documents"), ["en", "de"]).select("doc_id", "lang")


_EDGE = r"[^\p{L}\p{N}_]"


@query(
    "match_keywords",
    f"SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '(?:^|{_EDGE})(?:une|nicht|worthless)(?:{_EDGE}|$)')",
)
def match_keywords(spark, sf):
    df = table(spark, sf, "documents")
    return FL.match_keywords(df, "doc_id", "text", ["une", "nicht", "worthless"]).select("doc_id", "lang")


@query(
    "match_keywords_joined",
    f"SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '(?:^|{_EDGE})(?:une|nicht|worthless)(?:{_EDGE}|$)')",
)
def match_keywords_joined(spark, sf):
    """More keywords than a constant may hold."""
    df = table(spark, sf, "documents")
    return FL.match_keywords(df, "doc_id", "text", ["une", "nicht", "worthless"], 1, 1).select("doc_id", "lang")


@query(
    "match_many_keywords",
    f"SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '(?:^|{_EDGE})(?:une|nicht|worthless)(?:{_EDGE}|$)')",
)
def match_many_keywords(spark, sf):
    df = table(spark, sf, "documents")
    return FL.match_keywords(df, "doc_id", "text", ["une", "nicht", "worthless"], max_pattern=1).select("doc_id", "lang")


_PHRASES = [f"{a} {b}" for a in ("the", "und", "la", "de", "in") for b in ("the", "der", "de", "que", "of", "is", "and", "en", "zu", "la", "on")]


@query(
    "match_many_phrases",
    f"SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '(?:^|{_EDGE})(?:{'|'.join([*_PHRASES, 'worthless'])})(?:{_EDGE}|$)')",
)
def match_many_phrases(spark, sf):
    """Phrases and a word, more than one pattern takes."""
    return FL.match_keywords(table(spark, sf, "documents"), "doc_id", "text", [*_PHRASES, "worthless"]).select("doc_id", "lang")


_PAIRS = r"""SELECT list_extract(w, 1) || ' ' || list_extract(w, 2) AS phrase FROM (
    SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id % 4 = 0 AND regexp_matches(lower(text), '^[\p{L}\p{N}_]+ [\p{L}\p{N}_]+([^\p{L}\p{N}_]|$)'))"""


def _pairs(spark, sf):
    """The first two words of a quarter of the documents: hundreds or thousands of phrases."""
    word = r"[\p{L}\p{N}_]+"
    first = F.regexp_extract(F.lower("text"), rf"^({word} {word})(?:[^\p{{L}}\p{{N}}_]|$)", 1).alias("phrase")  # reads no further
    some = table(spark, sf, "documents").where(F.col("doc_id") % 4 == 0).select(first)
    return [r[0] for r in some.where("phrase <> ''").distinct().collect()]


_WITH_PAIR = rf"""
    SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN (SELECT DISTINCT phrase FROM ({_PAIRS})) ON contains(lower(d.text), phrase)
    WHERE regexp_matches(lower(d.text), '(?:^|{_EDGE})' || phrase || '(?:{_EDGE}|$)')"""


@query("match_thousand_phrases", _WITH_PAIR)
def match_thousand_phrases(spark, sf):
    """Thousands of phrases at one look at the words."""
    return FL.match_keywords(table(spark, sf, "documents"), None, "text", _pairs(spark, sf)).select("doc_id", "lang")


@query("match_phrases_joined", _WITH_PAIR)
def match_phrases_joined(spark, sf):
    """More phrases than a constant may hold."""
    return FL.match_keywords(table(spark, sf, "documents"), None, "text", _pairs(spark, sf), 1, 1).select("doc_id", "lang")


@query("time_range", f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def time_range(spark, sf):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in (START, END))
    return FL.time_range(table(spark, sf, "events"), "ts", start, end).select("event_id", "ts")


@query("last_interval", sql("posts", f"SELECT id FROM posts WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR"))
def last_interval(spark, sf):
    return FL.last_interval(posts(spark, sf), "created_at", stamp(AS_OF)).select("id")


@query(
    "history",
    sql(
        "analyses",
        """SELECT id, sentiment, source, created_at FROM analyses WHERE user_id = 8 AND sentiment = 'positive'
           ORDER BY created_at DESC, id LIMIT 20""",
    ),
)
def history(spark, sf):
    rows = FL.history(analyses(spark, sf), 8, sentiment="positive")
    return O.page(rows, [F.col("created_at").desc(), F.col("id")], 1, 20).select("id", "sentiment", "source", ntz("created_at"))


_EXPIRED = "status = 'completed' AND completed_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY"


@query(
    "expired_jobs",
    sql(
        "jobs",
        f"SELECT job_id, coalesce({_EXPIRED}, false) AS expired FROM jobs",
    ),
)
def expired_jobs(spark, sf):
    expired, kept = J.expired_jobs(jobs(spark, sf), 30, stamp("1998-01-01 00:00:00"))
    return expired.select("job_id", F.lit(True).alias("expired")).unionByName(kept.select("job_id", F.lit(False).alias("expired")))


_RUNS_OF_SUPPLIERS = "CASE s_suppkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'processing' END"


@query(
    "expire_files",
    f"""SELECT CAST(s_suppkey AS VARCHAR) AS job_id, {_RUNS_OF_SUPPLIERS} = 'completed' AS removed, {_RUNS_OF_SUPPLIERS} <> 'completed' AS still_there
        FROM supplier""",
)
def expire_files(spark, sf):
    """A job for each supplier. Results of completed jobs go once they are a week old, others stay; a repeat removes nothing."""
    root = new_folder(spark, "results")
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("job_id"), F.expr(_RUNS_OF_SUPPLIERS).alias("status"))
    # Many tasks write the folders, each its own, and put them in place themselves.
    tasks = rows.repartition(spark.sparkContext.defaultParallelism, "job_id")
    tasks.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("job_id").parquet(root)
    later = F.current_timestamp() + F.expr("INTERVAL 8 DAYS")
    none = J.expire_files(spark, rows, root).count()
    gone = J.expire_files(spark, rows, root, as_of=later).select("job_id", F.lit(True).alias("removed"))
    again = J.expire_files(spark, rows, root, as_of=later).count()
    there = spark.createDataFrame([(c.removeprefix("job_id="),) for c in children(spark, root) if c.startswith("job_id=")], "job_id string")
    out = rows.select("job_id").join(gone, "job_id", "left").join(there.withColumn("still_there", F.lit(True)), "job_id", "left").na.fill(False)
    return out.where(F.lit(none + again == 0))


@query(
    "active_jobs",
    sql("jobs", "SELECT user_id, count(*) AS active_jobs FROM jobs WHERE status IN ('pending', 'processing') GROUP BY user_id"),
)
def active_jobs(spark, sf):
    return J.active_jobs(jobs(spark, sf))


@query(
    "job_metrics",
    sql(
        "jobs",
        """SELECT job_id, progress_percent, round(duration_seconds, 6) AS duration_seconds,
                  round(CASE WHEN duration_seconds > 0 THEN processed_records / duration_seconds END, 6) AS records_per_second
           FROM (SELECT job_id, processed_records,
                        CAST(CASE WHEN total_records = 0 THEN 0
                                  ELSE least(100, trunc(processed_records / total_records * 100)) END AS INT) AS progress_percent,
                        (epoch_us(coalesce(completed_at, TIMESTAMP '2000-01-01')) - epoch_us(started_at)) / 1000000.0::DOUBLE AS duration_seconds
                 FROM jobs)""",
    ),
)
def job_metrics(spark, sf):
    m = J.job_metrics(jobs(spark, sf), stamp("2000-01-01 00:00:00"))
    return m.select("job_id", "progress_percent", r6("duration_seconds"), r6("records_per_second"))


@query("recent", sql("analyses", "SELECT id, user_id, created_at FROM analyses ORDER BY created_at DESC, id LIMIT 10"))
def recent(spark, sf):
    return O.recent(analyses(spark, sf), "created_at", 10, "id").select("id", "user_id", ntz("created_at"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf):
    return O.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query(
    "sorted_scores",
    sql("posts", "SELECT id, CASE WHEN k > 33 THEN 'up' ELSE 'even' END AS best, greatest(k, 33) AS score FROM posts"),
)
def sorted_scores(spark, sf):
    scores = F.create_map(F.lit("up"), F.col("k"), F.lit("even"), F.lit(33))
    return posts(spark, sf).select("id", F.get(O.sorted_scores(scores), F.lit(0)).alias("e")).select(
        "id", F.col("e.key").alias("best"), F.col("e.value").alias("score")
    )


@query("page", sql("analyses", "SELECT id, created_at FROM analyses ORDER BY created_at DESC, id LIMIT 20 OFFSET 40"))
def page(spark, sf):
    rows = O.page(analyses(spark, sf), [F.col("created_at").desc(), F.col("id")], 3, 20)
    return rows.select("id", ntz("created_at"))


@query(
    "page_after",
    sql(
        "analyses",
        f"SELECT id, created_at FROM analyses WHERE created_at < TIMESTAMP '{AS_OF}' ORDER BY created_at DESC, id LIMIT 20",
    ),
)
def page_after(spark, sf):
    import datetime

    last = (datetime.datetime.fromisoformat(AS_OF), -1)
    df = analyses(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    df = df.where(F.col("created_at") != F.lit(AS_OF).cast("timestamp_ntz"))
    return O.page_after(df, "created_at", "id", last, 20).select("id", "created_at")


@query(
    "top_n_per_group",
    """SELECT source, doc_id, n_chars FROM (
           SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
       WHERE r <= 10""",
)
def top_n_per_group(spark, sf):
    df = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return O.top_n_per_group(df, "source", [F.col("n_chars").desc(), F.col("doc_id")], 10)
