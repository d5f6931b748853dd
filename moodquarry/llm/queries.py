"""The operators over the given tables, as their contracts have them, and SQL for those that it can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodquarry.llm.fingerprints import fingerprint_edits
from moodquarry.llm.histogram_packing import pack_by_histogram
from moodquarry.llm.language import predict_languages
from moodquarry.llm.mixing import mixed_sizes, words
from moodquarry.llm.packing import pack_documents
from moodquarry.llm.periodic_runs import collapse_runs, strongest
from moodquarry.llm.phrase_automata import mine_collocations
from moodquarry.llm.quality import score_quality
from moodquarry.llm.search import top_inner_products
from moodquarry.llm.simhash import near_duplicates
from moodquarry.llm.substrings import drop_repeats
from moodquarry.llm.token_counts import count_tokens
from moodquarry.llm.token_output import packed_matrices

WORD_BPE, WORD_BPE_END = public_tokenizers.path("word_bpe_49k.json"), 1
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


OP1_SQL = """
WITH rows AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
    FROM documents
), sources AS (
    SELECT *, CASE source_no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
        FROM rows GROUP BY source)
), levels AS (  -- from each source on, by size for its weight, none stops at twice its size: the first level that holds
    SELECT 2 * source_size / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY source_size / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), aims AS (
    SELECT *, least((2 * source_size)::DOUBLE, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio LIMIT 1)) AS target,
        greatest(1, ceil(source_size / 65536))::BIGINT AS blocks
    FROM sources
), placed AS (
    SELECT r.*, a.* EXCLUDE (source), r.hash % a.blocks AS block FROM rows r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source
), each AS (
    SELECT source_no, block, pass, max(target) - pass * max(source_size) AS rest, sum(size) AS block_size
    FROM placed, (VALUES (0), (1), (2)) AS p(pass)
    WHERE target > 0 AND pass <= floor(target / source_size) GROUP BY source_no, block, pass
), drawn AS (
    SELECT *, sum(block_size) OVER (PARTITION BY source_no, pass
        ORDER BY ('0x' || substr(md5(concat_ws('|', '42', source_no, block, pass)), 1, 15))::BIGINT, block) - block_size AS before
    FROM each
), taken AS (
    SELECT p.doc_id, p.hash, d.pass, d.rest - d.before AS rest, d.block_size > d.rest - d.before AS partly,
        sum(p.size) OVER (PARTITION BY d.source_no, d.pass, d.block ORDER BY p.hash RANGE UNBOUNDED PRECEDING) AS upto,
        sum(p.size) OVER (PARTITION BY d.source_no, d.pass, d.block, p.hash) AS size
    FROM drawn d JOIN placed p USING (source_no, block) WHERE d.before < d.rest
), counted AS (
    SELECT hash, count(DISTINCT pass) AS n FROM taken WHERE NOT partly OR upto - size + size / 2 <= rest GROUP BY hash
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(c.n, 0))::BIGINT AS taken
FROM placed p LEFT JOIN counted c USING (hash)
"""


@query("op1_source_mixing", OP1_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf), "doc_id", "source", words("text"))


@query("op2_language_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return predict_languages(documents(spark, sf), "doc_id", "text", "lang")


@query("op3_simhash_near_dedup")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf), "doc_id", "text")


@query("op4_best_fit_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(documents(spark, sf), "doc_id", "text", WORD_BPE, WORD_BPE_END)


@query("op5_document_fingerprints")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf), "doc_id", "text")


@query("op6_token_output")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return packed_matrices(documents(spark, sf), "doc_id", "text", WORD_BPE, WORD_BPE_END)


@query("op7_quality_classifier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", "quality")


@query("op8_substring_dedup")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeats(documents(spark, sf), "doc_id", "text")


OP9_SQL = """
WITH vectors AS (
    SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op9_exact_top_k", OP9_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return top_inner_products(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@query("op10_token_counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(documents(spark, sf), "doc_id", "text", PIECE_BPE)


@query("op11_histogram_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pack_by_histogram(documents(spark, sf), "doc_id", "text", WORD_BPE, WORD_BPE_END)


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 6) AS r(k) WHERE len(w) >= k)
), counted AS (
    SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.k AS words, c.a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 :], ' ') AS rest
    FROM candidates c, range(1, 5) AS r(j) WHERE j < c.k
), scored AS (
    SELECT c.*, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN totals USING (lang)
    JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.rest
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
    SELECT DISTINCT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS longer
    FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 5) AS r(m) WHERE m < k)
), covers AS (
    SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN covers USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mine_collocations(documents(spark, sf), "text", "lang")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`documents` in which a tenth of the texts, by CRC-32 of the id, goes on from some word with a period; a null id plants none."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", hashed.alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    )
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i))))
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = collapse_runs(with_planted_runs(documents(spark, sf)), "doc_id", "text").withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
