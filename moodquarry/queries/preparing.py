"""Copies, splits, vocabulary, encoding, run tables."""

from pyspark.sql import functions as F

from moodquarry.operators import features as X
from moodquarry.operators import jobs as J
from moodquarry.operators import prepare as P
from moodquarry.operators import stats as S
from moodquarry.queries import query
from moodquarry.queries.tables import epochs, samples, sql, sql_strip, sql_tokens_text, table, text_table

_TRIMMED = f"SELECT * FROM (SELECT doc_id, {sql_strip('text')} AS text, sentiment, emotion, source FROM samples) WHERE length(text) > 3"
_DEDUP = """SELECT * FROM (SELECT *, md5(text) AS text_hash, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r
            FROM trimmed) WHERE r = 1"""


def _split_sql(first: float, second: float, smallest: int, label: str = "sentiment", last: str = "test") -> str:
    return f"""
        SELECT doc_id, text_hash, source, sentiment,
               CASE WHEN n < {smallest} OR r2 <= floor(n * CAST({first!r} AS DOUBLE)) THEN 'train'
                    WHEN r2 <= floor(n * CAST({second!r} AS DOUBLE)) THEN 'val' ELSE '{last}' END AS split
        FROM (SELECT *, count(*) OVER (PARTITION BY {label}) AS n,
                     row_number() OVER (PARTITION BY {label} ORDER BY md5(text_hash || ':42')) AS r2
              FROM (SELECT *, 'all' AS everything FROM dedup) WHERE {label} IS NOT NULL)"""


def deduped(spark, sf):
    return P.dedup_text(samples(spark, sf), "doc_id")


@query("dedup_text", sql("samples", "SELECT doc_id, text, text_hash FROM dedup", trimmed=_TRIMMED, dedup=_DEDUP))
def dedup_text(spark, sf):
    return deduped(spark, sf).select("doc_id", "text", "text_hash")


@query(
    "dedup_text_sha256",
    sql("samples", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM trimmed GROUP BY text", trimmed=_TRIMMED),
)
def dedup_text_sha256(spark, sf):
    return P.dedup_text(samples(spark, sf), "doc_id", algo="sha256").select("doc_id", "text_hash")


def _split_query(first, second, smallest, **more):
    return sql("samples", "SELECT doc_id, sentiment, split FROM parts", trimmed=_TRIMMED, dedup=_DEDUP,
               parts=_split_sql(first, second, smallest, **more))


@query("stratified_split", _split_query(0.7, 0.7 + 0.15, 10))
def stratified_split(spark, sf):
    return P.stratified_split(deduped(spark, sf), "sentiment", "text_hash", **P.SPLIT_70).select("doc_id", "sentiment", "split")


@query("stratified_split_80", _split_query(0.8, 0.8 + 0.1, 0))
def stratified_split_80(spark, sf):
    return P.stratified_split(deduped(spark, sf), "sentiment", "text_hash", **P.SPLIT_80).select("doc_id", "sentiment", "split")


@query(
    "stratified_split_hash",
    sql(
        "samples",
        """SELECT doc_id, CASE WHEN h < CAST(0.7 AS DOUBLE) THEN 'train' WHEN h < CAST(0.85 AS DOUBLE) THEN 'val' ELSE 'test' END AS split
           FROM (SELECT doc_id, CAST('0x' || substr(md5(text_hash || ':42'), 1, 8) AS BIGINT) / 4294967296 AS h FROM dedup
                 WHERE sentiment IS NOT NULL)""",
        trimmed=_TRIMMED, dedup=_DEDUP,
    ),
)
def stratified_split_hash(spark, sf):
    df = P.stratified_split(deduped(spark, sf), "sentiment", "text_hash", mode="hash")
    return df.select("doc_id", "split")


@query("random_split", _split_query(0.9, 0.0, 0, label="everything", last="val"))
def random_split(spark, sf):
    return P.random_split(deduped(spark, sf), 0.9).select("doc_id", "sentiment", "split")


_PARTS_70 = _split_sql(0.7, 0.7 + 0.15, 10)


@query(
    "split_metadata",
    sql(
        "samples",
        """SELECT 'split' AS metric, split AS key, count(*) AS count FROM parts GROUP BY split
           UNION ALL SELECT 'train_sentiment', sentiment, count(*) FROM parts WHERE split = 'train' GROUP BY sentiment
           UNION ALL SELECT 'source', source, count(*) FROM samples GROUP BY source""",
        trimmed=_TRIMMED, dedup=_DEDUP, parts=_PARTS_70,
    ),
)
def split_metadata(spark, sf):
    df = P.stratified_split(deduped(spark, sf), "sentiment", "text_hash", **P.SPLIT_70)
    return P.split_metadata(df, samples(spark, sf))


@query(
    "dataset_registry_row",
    sql(
        "samples",
        """SELECT count(*) AS total_samples, count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'val') AS val_samples,
                  count(*) FILTER (split = 'test') AS test_samples, count(*) FILTER (sentiment = 'positive') AS positive_count,
                  count(*) FILTER (sentiment = 'negative') AS negative_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count
           FROM parts""",
        trimmed=_TRIMMED, dedup=_DEDUP, parts=_PARTS_70,
    ),
)
def dataset_registry_row(spark, sf):
    return S.dataset_registry_row(P.stratified_split(deduped(spark, sf), "sentiment", "text_hash", **P.SPLIT_70))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = f"""SELECT doc_id, list_filter(string_split({sql_tokens_text('text')}, ' '), lambda t: t <> '') AS t FROM documents"""


@query(
    "tokenize",
    sql("", f"SELECT doc_id, array_to_string(list_filter(t, lambda x: x NOT IN ({_STOP})), ' ') AS tokens FROM toks", toks=_TOKENS),
)
def tokenize(spark, sf):
    return text_table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.tokenize("text", X.STOP_WORDS), " ").alias("tokens")
    )


_VOCAB = """SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INT) AS id, n
            FROM (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM toks) GROUP BY token HAVING count(*) >= 2)
            QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {size} - 4
            UNION ALL SELECT unnest(['<PAD>', '<UNK>', '<BOS>', '<EOS>']), unnest([0, 1, 2, 3]), 0"""


@query("build_vocab", sql("", "SELECT * FROM vocab", toks=_TOKENS, vocab=_VOCAB.format(size=20000)))
def build_vocab(spark, sf):
    return X.build_vocab(text_table(spark, sf, "documents"), "text", 20_000).na.fill(0, ["n"])


_ENCODED = """
    SELECT doc_id, list_concat(ids, list_transform(range(160 - len(ids)), lambda x: 0)) AS ids, len(ids) AS n FROM (
        SELECT doc_id, list_slice(list_concat([2], list_filter(list(coalesce(id, 1) ORDER BY i), lambda x: x >= 0), [3]), 1, 160) AS ids
        FROM (SELECT doc_id, i, CASE WHEN i = 0 THEN -1 ELSE v.id END AS id
              FROM (SELECT doc_id, unnest(list_concat([''], t)) AS token, generate_subscripts(list_concat([''], t), 1) - 1 AS i FROM toks) w
              LEFT JOIN vocab v ON v.token = w.token)
        GROUP BY doc_id)"""


def _encode_sql(size):
    return sql(
        "", """SELECT doc_id, array_to_string(ids, ',') AS input_ids, CAST(len(ids) AS INT) AS length, CAST(n AS BIGINT) AS tokens
               FROM encoded""",
        toks=_TOKENS, vocab=_VOCAB.format(size=size), encoded=_ENCODED,
    )


def _encode(spark, sf, size, **options):
    docs = text_table(spark, sf, "documents")
    df = X.encode(docs, "doc_id", "text", X.build_vocab(docs, "text", size), 160, **options)
    ones = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.size("attention_mask").alias("length"), ones.alias("tokens"))


@query("encode", _encode_sql(5000))
def encode(spark, sf):
    return _encode(spark, sf, 5000)


@query("encode_large_vocab", _encode_sql(20000))
def encode_large_vocab(spark, sf):
    """A vocabulary beyond the bound of a constant, joined word by word."""
    return _encode(spark, sf, 20_000, max_literal=5000)


@query(
    "run_history",
    """SELECT o_orderkey AS id, o_orderpriority AS run_name, o_orderstatus AS status, o_totalprice AS best_val_loss,
              o_orderdate AS started_at FROM orders ORDER BY started_at DESC, id DESC LIMIT 25""",
)
def run_history(spark, sf):
    runs = table(spark, sf, "orders").withColumnsRenamed(
        {"o_orderkey": "id", "o_orderpriority": "run_name", "o_orderstatus": "status", "o_totalprice": "best_val_loss",
         "o_orderdate": "started_at"}
    )
    return J.run_history(runs, 25)


_RUN = {"o_orderkey": "id", "o_orderpriority": "run_name", "o_orderstatus": "status", "o_totalprice": "best_val_loss", "o_orderdate": "started_at"}


@query(
    "finish_runs",
    """SELECT o_orderkey AS id, o_orderpriority AS run_name, CASE WHEN o_orderstatus = 'O' THEN 'completed' ELSE o_orderstatus END AS status,
              round(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 2 ELSE o_totalprice END, 6) AS best_val_loss, o_orderdate AS started_at,
              CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL '1 day' END AS finished_at FROM orders""",
)
def finish_runs(spark, sf):
    """Open runs get their outcome; a run is listed once."""
    runs = table(spark, sf, "orders").withColumnsRenamed(_RUN).select(*_RUN.values())
    done = runs.where("status = 'O'").select(
        "id", F.lit("completed").alias("status"), (F.col("best_val_loss") / 2).alias("best_val_loss"),
        (F.col("started_at") + F.expr("INTERVAL 1 DAY")).alias("finished_at"),
    )
    return J.finish_runs(runs, done).withColumn("best_val_loss", F.round("best_val_loss", 6))


@query(
    "epoch_series",
    sql("epochs", """SELECT epoch, 'val' AS phase, val_loss, sentiment_acc, emotion_acc FROM epochs WHERE run_id = 7"""),
)
def epoch_series(spark, sf):
    df = epochs(spark, sf).withColumnRenamed("run_id", "training_run_id").withColumn("phase", F.lit("val"))
    return J.epoch_series(df, 7)
