"""Stand-ins for posts, analyses, samples, models, jobs and lexicons, made from the given tables.

Each stand-in exists twice: as a DataFrame and, for the comparison SQL, as a named subquery.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.functions.labels import EMOTIONS, compound_to_label
from moodquarry.operators import word_rules
from moodquarry.operators.scoring import RULES
from moodquarry.plans.session import settle
from moodquarry.plans.spread import spread

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
AS_OF = "2024-01-15 12:30:00"
# Stand-in modifiers that the lexicon leaves out; the others are lexicon words, too, and so modify nothing.
MERE_MODIFIERS = ["no", "nicht", "pas", "of", "de", "der", "and", "la"]
# The invented prose has other frequent words than English, so these serve as modifiers.
STAND_IN_RULES = {
    **RULES,
    "negators": RULES["negators"] + ["no", "nicht", "pas", "of"],
    "stronger": RULES["stronger"] + ["the", "de", "der"],
    "weaker": RULES["weaker"] + ["and", "la", "und"],
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ntz(name: str):
    """A timestamp as it is compared: without a zone."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def r6(name: str):
    return F.round(name, 6).alias(name)


def stamp(text: str):
    return F.lit(text).cast("timestamp")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for costly work per row; the test files hold all rows in one piece."""
    return spread(table(spark, sf, name))


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of files, as a stream."""
    schema = table(spark, sf, name).schema
    # As a pattern: a stream takes the plain path of a file for that of a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.[p]arquet")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts_of(table(spark, sf, "events"))


def posts_of(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        e.withColumn("k", k)
        .withColumn("compound_score", (F.col("k") - 50) / F.lit(51.0))
        .select(
            F.col("event_id").cast("string").alias("tweet_id"),
            F.concat(F.lit("post on "), "event_type", F.lit(" about "), F.col("k").cast("string")).alias("text"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.floor("value").cast("bigint").alias("retweet_count"),
            F.col("k").cast("bigint").alias("like_count"),
            compound_to_label(F.col("compound_score")).alias("sentiment"),
            "compound_score",
            F.nullif("event_type", F.lit("error")).alias("primary_emotion"),
            (F.col("k") / F.lit(101.0)).alias("confidence"),
            F.lit("lexicon").alias("model_used"),
            F.concat("event_type", F.lit(",k"), (F.col("k") % 10).cast("string")).alias("keywords"),
            F.element_at(
                F.array(F.lit("twitter"), F.lit("reddit"), F.lit("news")), (F.col("user_id") % 3 + 1).cast("int")
            ).alias("source"),
            F.when(F.col("k") % 10 == 0, "[]")
            .when(F.col("k") % 10 == 1, F.lit(None))
            .otherwise(F.concat(F.lit('["'), "event_type", F.lit('","k'), (F.col("k") % 10).cast("string"), F.lit('"]')))
            .alias("hashtags"),
            "user_id",
            F.col("event_id").alias("id"),
            "k",
        )
    )


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select(
        "id", "user_id", F.col("text").alias("input_text"), "source", "sentiment", "compound_score",
        (F.col("k") / F.lit(300.0)).alias("positive_score"),
        ((F.lit(100) - F.col("k")) / F.lit(300.0)).alias("negative_score"),
        F.lit(2 / 3).alias("neutral_score"),
        "primary_emotion",
        F.nullif("confidence", F.lit(0.0)).alias("confidence"),
        F.col("retweet_count").cast("int").alias("processing_time_ms"),
        F.length("text").alias("text_length"),
        F.lit(5).alias("word_count"),
        "created_at",
    )


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    """An analysed table as a CSV upload gets it."""
    return posts(spark, sf).select(
        F.col("id"),
        F.nullif("sentiment", F.when(F.col("k") == 99, F.lit("positive"))).alias("Sentiment"),
        F.col("compound_score").alias("Compound_Score"),
        (F.col("k") / F.lit(100.0)).alias("Positive_Score"),
        F.lit(0.25).alias("Negative_Score"),
        F.when(F.col("k") < 90, F.lit(0.5)).alias("Neutral_Score"),
        F.col("primary_emotion").alias("Primary_Emotion"),
        F.col("confidence").alias("Emotion_Confidence"),
    )


def samples(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    feeling = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(
        F.col("quality") == 0, "neutral"
    )
    emotion = F.when(F.col("lang") == "en", "joy").when(F.col("lang") == "fr", "sadness").when(
        F.col("lang") == "de", "love"
    ).otherwise("neutral")
    documents = table(spark, sf, "documents") if documents is None else documents
    return (
        documents.join(table(spark, sf, "labels"), "doc_id", "left")
        .select("doc_id", "text", feeling.alias("sentiment"), emotion.alias("emotion"), "source")
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All texts of three tables under one key."""
    d = text_table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    p = text_table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"),
        F.concat("url", F.lit(" "), "html").alias("text"),
    )
    c = text_table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("key"), "text"
    )
    return d.unionByName(p).unionByName(c)


def models(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        F.concat(F.lit("1."), F.col("s_suppkey").cast("string")).alias("version"),
        F.lit("two heads").alias("architecture"),
        (F.col("s_acctbal") / 30000 + 0.5).alias("accuracy"),
        (F.col("s_acctbal") / 30000).alias("f1_macro"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 15000).alias("f1_weighted"),
        (F.col("s_suppkey") % 2 == 0).alias("is_production"),
        F.when(F.col("s_nationkey") < 20, F.col("s_nationkey")).alias("training_dataset_id"),
    )


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 1000).alias("total_samples")
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "pending").otherwise("processing").alias("status"),
        F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.floor("o_totalprice")).cast("bigint").alias("total_records"),
        F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") * 1.01)).otherwise(F.floor(F.col("o_totalprice") / 3)).cast("bigint").alias("processed_records"),
        F.when(F.col("o_orderstatus") != "P", at).alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", at + F.expr("INTERVAL 90 MINUTES")).alias("completed_at"),
        at.alias("created_at"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("epoch"),
        F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("val_loss"),
        (F.col("l_quantity") / 100).alias("sentiment_acc"),
        (F.col("l_quantity") / 50).alias("emotion_acc"),
    )


def _hex_byte(column: str, at: int):
    return F.conv(F.substring(F.md5(column), at, 2), 16, 10).cast("int")


_LEXICONS: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def hashed_valence(term: str):
    return ((_hex_byte(term, 1) - 128) / F.lit(32.0)).alias("valence")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents (term) and how often they stand (n), in more than one row.

    Texts part at blanks in Arrow batches, so that the pattern meets a batch's different pieces only.
    """
    low = text_table(spark, sf, "documents").select(F.lower("text").alias("text"))
    pieces = low.mapInArrow(lambda batches: word_rules.pieces(batches), "piece string, n bigint")
    return pieces.select(F.explode(F.split("piece", r"[^\p{L}]+")).alias("term"), "n").where(F.col("term") != "")


def lexicons(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A sentiment and an emotion lexicon of all words of the documents, with values from their hash."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _LEXICONS:
        top = settle(_words(spark, sf).select("term").where(~F.col("term").isin(MERE_MODIFIERS)).distinct())
        label = F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), _hex_byte("term", 3) % 7 + 1)
        _LEXICONS[at] = (
            top.select("term", hashed_valence("term")),
            top.select("term", label.alias("emotion"), (_hex_byte("term", 5) % 4 + 1).cast("double").alias("weight")),
        )
    return _LEXICONS[at]


COMMON = 20  # occurrences of a common word at least


def common_lexicons(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Those of `lexicons` for words that are common in the documents: some thousands, as published lexicons have."""
    at = (spark.sparkContext.applicationId, sf, "common")
    if at not in _LEXICONS:
        common = settle(_words(spark, sf).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select("term"))
        _LEXICONS[at] = tuple(settle(x.join(common, "term", "left_semi")) for x in lexicons(spark, sf))
    return _LEXICONS[at]


# ---- the same as SQL -------------------------------------------------------------------------

SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
URL = rf"http{WORD}|www\.{WORD}"


def sql_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{SPACES}+', ''), '{SPACES}+$', '')"


def sql_clean(x: str, tag: str = "", cut: bool = True) -> str:
    s = rf"regexp_replace(coalesce({x}, ''), '{URL}', '', 'g')"
    s = rf"regexp_replace({s}, '<[^>]+>', '{tag}', 'g')"
    s = rf"regexp_replace({s}, '{SPACES}+', ' ', 'g')"
    return f"trim(substr({s}, 1, 5000))" if cut else f"trim({s})"


def sql_tokens_text(x: str) -> str:
    s = rf"regexp_replace(lower(coalesce({x}, '')), '{URL}', '<URL>', 'g')"
    s = rf"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    s = rf"""regexp_replace({s}, '["#$%&''()*+,/:;<=>@\[\\\]^_`{{|}}~-]', ' ', 'g')"""
    return rf"trim(regexp_replace({s}, '{SPACES}+', ' ', 'g'))"


def sql_label(x: str) -> str:
    return f"CASE WHEN {x} >= 0.05 THEN 'positive' WHEN {x} <= -0.05 THEN 'negative' ELSE 'neutral' END"


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_hex(x: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({x}), {at}, 2) AS INT)"


ALL_WORDS = rf"""
    SELECT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS w FROM documents)
    WHERE w <> '' AND w NOT IN {sql_list(MERE_MODIFIERS)}"""

COMMON_WORDS = f"SELECT w AS term FROM ({ALL_WORDS}) GROUP BY w HAVING count(*) >= {COMMON}"

PARTS: dict[str, str] = {
    "posts0": "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events",
    "posts": f"""
        SELECT CAST(event_id AS VARCHAR) AS tweet_id, 'post on ' || event_type || ' about ' || k AS text,
               'user_' || user_id AS author_id, ts AS created_at, CAST(floor(value) AS BIGINT) AS retweet_count,
               CAST(k AS BIGINT) AS like_count, {sql_label('((k - 50) / 51.0::DOUBLE)')} AS sentiment,
               (k - 50) / 51.0::DOUBLE AS compound_score, nullif(event_type, 'error') AS primary_emotion,
               k / 101.0::DOUBLE AS confidence, 'lexicon' AS model_used,
               event_type || ',k' || (k % 10) AS keywords,
               CASE user_id % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' ELSE 'news' END AS source,
               CASE k % 10 WHEN 0 THEN '[]' WHEN 1 THEN NULL
                    ELSE '["' || event_type || '","k' || (k % 10) || '"]' END AS hashtags,
               user_id, event_id AS id, k
        FROM posts0""",
    "analyses": """
        SELECT id, user_id, text AS input_text, source, sentiment, compound_score,
               CAST(k AS DOUBLE) / 300 AS positive_score, CAST(100 - k AS DOUBLE) / 300 AS negative_score,
               CAST(2 AS DOUBLE) / 3 AS neutral_score, primary_emotion, nullif(confidence, 0) AS confidence,
               CAST(retweet_count AS INT) AS processing_time_ms, CAST(length(text) AS INT) AS text_length,
               5 AS word_count, created_at
        FROM posts""",
    "analysed": """
        SELECT id, CASE WHEN k = 99 THEN NULL ELSE sentiment END AS Sentiment, compound_score AS Compound_Score,
               CAST(k AS DOUBLE) / 100 AS Positive_Score, CAST(0.25 AS DOUBLE) AS Negative_Score,
               CASE WHEN k < 90 THEN CAST(0.5 AS DOUBLE) END AS Neutral_Score,
               primary_emotion AS Primary_Emotion, confidence AS Emotion_Confidence
        FROM posts""",
    "samples": """
        SELECT d.doc_id, d.text,
               CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment,
               CASE lang WHEN 'en' THEN 'joy' WHEN 'fr' THEN 'sadness' WHEN 'de' THEN 'love' ELSE 'neutral' END AS emotion,
               d.source
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "texts": """
        SELECT 'd' || doc_id AS key, text FROM documents
        UNION ALL SELECT 'p' || page_id, url || ' ' || html FROM pages
        UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations""",
    "models": """
        SELECT s_name AS name, '1.' || s_suppkey AS version, 'two heads' AS architecture, s_acctbal / 30000 + 0.5 AS accuracy,
               s_acctbal / 30000 AS f1_macro, CASE WHEN s_acctbal >= 0 THEN s_acctbal / 15000 END AS f1_weighted,
               s_suppkey % 2 = 0 AS is_production, CASE WHEN s_nationkey < 20 THEN s_nationkey END AS training_dataset_id
        FROM supplier""",
    "datasets": "SELECT n_nationkey AS id, n_name AS name, CAST(n_nationkey * 1000 AS INT) AS total_samples FROM nation",
    "jobs": """
        SELECT o_orderkey AS job_id, o_custkey AS user_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'processing' END AS status,
               CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS total_records,
               CAST(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice * CAST(1.01 AS DOUBLE))
                         ELSE floor(o_totalprice / 3) END AS BIGINT) AS processed_records,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS started_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 MINUTE END AS completed_at,
               o_orderdate AS created_at
        FROM orders""",
    "users": "SELECT c_custkey AS user_id FROM customer",
    "epochs": """
        SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS epoch, round(l_discount + l_tax, 2) AS val_loss,
               l_quantity / 100 AS sentiment_acc, l_quantity / 50 AS emotion_acc
        FROM lineitem""",
    "lex0": f"SELECT DISTINCT w AS term FROM ({ALL_WORDS})",
    "lexicon": f"SELECT term, CAST(({sql_hex('term', 1)} - 128) / 32.0 AS DOUBLE) AS valence FROM lex0",
    "emolex": f"""
        SELECT term, list_extract([{', '.join(f"'{e}'" for e in EMOTIONS)}], {sql_hex('term', 3)} % 7 + 1) AS emotion,
               CAST({sql_hex('term', 5)} % 4 + 1 AS DOUBLE) AS weight
        FROM lex0""",
}
NEEDS = {"posts": ["posts0"], "analyses": ["posts"], "analysed": ["posts"], "lexicon": ["lex0"], "emolex": ["lex0"]}


def sql(parts: str, body: str, /, **more: str) -> str:
    """`body` with the named stand-ins (blank-separated) and then `more` as subqueries before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in parts.split():
        add(name)
    ctes = [f"{n} AS MATERIALIZED ({PARTS[n]})" if n in ("lex0",) else f"{n} AS ({PARTS[n]})" for n in order]
    ctes += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + body
