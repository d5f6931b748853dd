"""Sentiment and emotion scores."""

from pyspark.sql import functions as F

from moodquarry.functions.labels import EMOTIONS
from moodquarry.operators import scoring as S
from moodquarry.operators import word_rules
from moodquarry.queries import query
from moodquarry.queries.tables import (
    ALL_WORDS, AS_OF, COMMON_WORDS, PARTS, STAND_IN_RULES, common_lexicons, lexicons, posts_of, r6, sql, sql_clean, sql_label, sql_list, stamp, table, text_table,
)

_PLAIN = "translate(clean, '‘’ʼ＇', '" + "'" * 8 + "')"
_PUNCTUATION = S.EDGE_PUNCTUATION.replace("'", "''")


def _step(d: int) -> tuple[str, str]:
    """SQL of what the word `d` places before adds, by the sign of the sum so far, and of its factor."""
    r, p, free = STAND_IN_RULES, f"p{d}", f"k{d} IS NULL"
    negator = f"({p} IN {sql_list(r['negators'])} OR {p} LIKE '%n''t')"
    shout = f"CASE WHEN mixed AND u{d} THEN 0.733::DOUBLE ELSE 0 END"
    add = f"""CASE WHEN {p} IS NULL OR NOT ({free}) OR {negator} THEN 0
        WHEN {p} IN {sql_list(r['weaker'])} THEN -0.293::DOUBLE + {shout} WHEN {p} IN {sql_list(r['stronger'])} THEN 0.293::DOUBLE + {shout} ELSE 0 END"""
    nearer = [f"p{i}" for i in range(1, d)]
    never = " OR ".join(f"{n} IN ('so', 'this')" for n in nearer) or "false"
    doubt = " OR ".join(f"{n} = 'doubt'" for n in nearer) or "false"
    factor = f"""CASE WHEN NOT ({free}) THEN 1 WHEN {p} = 'never' AND ({never}) THEN 1.25::DOUBLE WHEN {p} = 'without' AND ({doubt}) THEN 1
        WHEN {negator} THEN -0.74::DOUBLE ELSE 1 END"""
    return f"({add}) * {(1.0, 0.95, 0.9)[d - 1]}::DOUBLE", factor


def _hits_parts() -> dict[str, str]:
    """The strength of each lexicon word that is no degree word, one rule after the other."""
    r = STAND_IN_RULES
    parts = {
        "hit0": f"""SELECT *, valence + CASE WHEN mixed AND up THEN sign(valence) * 0.733::DOUBLE ELSE 0 END AS s0 FROM words3
            WHERE valence IS NOT NULL AND (low IN {sql_list(r['negators'])} OR low NOT IN {sql_list(r['stronger'] + r['weaker'])})"""
    }
    soft = lambda a, b: f"CASE WHEN {a} IN ('kind', 'sort') AND {b} = 'of' THEN -0.293::DOUBLE ELSE 0 END"
    steps = [*(_step(d) for d in (1, 2, 3)), (soft("p2", "p1"), "1"), (soft("p3", "p2"), "1"),
             ("0", "CASE WHEN p1 = 'least' AND k1 IS NULL AND coalesce(p2, '') NOT IN ('at', 'very') THEN -0.74::DOUBLE ELSE 1 END")]
    for n, (add, factor) in enumerate(steps):
        parts[f"hit{n + 1}"] = f"SELECT *, (s{n} + ({add}) * sign(s{n})) * ({factor}) AS s{n + 1} FROM hit{n}"
    parts["hits"] = f"""SELECT key, s{len(steps)} * CASE WHEN but IS NULL OR i = but THEN 1 WHEN i < but THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS s
        FROM hit{len(steps)}"""
    return parts


def _word_parts(rel: str, key: str, cut: bool = False) -> dict[str, str]:
    clean = sql_clean("text") if cut else sql_clean("text", cut=False)
    return {
        "cleaned": f"SELECT {key} AS key, {clean} AS clean FROM {rel}",
        "split0": f"SELECT key, list_filter(string_split({_PLAIN}, ' '), lambda x: x <> '') AS ws FROM cleaned",
        "words0": "SELECT key, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split0",
        "words1": f"SELECT key, i, coalesce(nullif(trim(w, '{_PUNCTUATION}'), ''), w) AS w FROM words0",
        "words2": "SELECT key, i, lower(w) AS low, w = upper(w) AND w <> lower(w) AS up FROM words1",
    }


def _sentiment_parts(rel: str, key: str, cut: bool = False) -> dict[str, str]:
    marks = lambda c: f"(length(clean) - length(replace(clean, '{c}', '')))"
    emph = f"""(least({marks('!')}, 4) * 0.292::DOUBLE + CASE WHEN {marks('?')} > 3 THEN 0.96::DOUBLE
               WHEN {marks('?')} > 1 THEN {marks('?')} * 0.18::DOUBLE ELSE 0 END)"""
    return {
        **_word_parts(rel, key, cut),
        "words3": """SELECT w.*, valence, lag(low, 1) OVER o AS p1, lag(low, 2) OVER o AS p2, lag(low, 3) OVER o AS p3,
                            lag(up, 1) OVER o AS u1, lag(up, 2) OVER o AS u2, lag(up, 3) OVER o AS u3,
                            lag(valence, 1) OVER o AS k1, lag(valence, 2) OVER o AS k2, lag(valence, 3) OVER o AS k3,
                            bool_or(up) OVER a AND NOT bool_and(up) OVER a AS mixed,
                            min(CASE WHEN low = 'but' THEN i END) OVER a AS but
                     FROM words2 w LEFT JOIN lexicon ON term = low WINDOW o AS (PARTITION BY key ORDER BY i), a AS (PARTITION BY key)""",
        **_hits_parts(),
        "sums": """SELECT key, sum(greatest(s, 0)) AS pos, sum(least(s, 0)) AS neg, count(*) FILTER (s > 0) AS npos,
                          count(*) FILTER (s < 0) AS nneg FROM hits GROUP BY key""",
        "folded": f"""SELECT c.key, clean, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(npos, 0) AS npos,
                             coalesce(nneg, 0) AS nneg, len(ws) AS n, {emph} AS e
                      FROM cleaned c JOIN split0 USING (key) LEFT JOIN sums USING (key)""",
        "totals": """SELECT *, pos + neg + sign(pos + neg) * e AS total, n - npos - nneg AS calm,
                            pos + npos + CASE WHEN pos + npos > nneg - neg THEN e ELSE 0 END AS up,
                            nneg - neg + CASE WHEN pos + npos < nneg - neg THEN e ELSE 0 END AS down FROM folded""",
        "sentiments": f"""
            SELECT key, clean, {sql_label('compound')} AS sentiment, compound,
                   CASE WHEN up + down + calm = 0 THEN 0 ELSE round(up / (up + down + calm), 3) END AS pos,
                   CASE WHEN up + down + calm = 0 THEN 0 ELSE round(down / (up + down + calm), 3) END AS neg,
                   CASE WHEN up + down + calm = 0 THEN 1 ELSE round(calm / (up + down + calm), 3) END AS neu,
                   abs(compound) AS confidence
            FROM (SELECT *, round(total / sqrt(total * total + 15), 4) AS compound FROM totals)""",
    }


def _emotion_parts(rel: str, key: str, words: bool = True) -> dict[str, str]:
    sums = ", ".join(f"sum(CASE WHEN emotion = '{e}' THEN weight ELSE 0 END) AS {e}" for e in EMOTIONS)
    most = "greatest(" + ", ".join(EMOTIONS) + ")"
    first = " ".join(f"WHEN {e} = {most} THEN '{e}'" for e in EMOTIONS)
    total = " + ".join(EMOTIONS)
    shares = ", ".join(f"CASE WHEN joy IS NULL THEN {int(e == 'neutral')} ELSE {e} / ({total}) END AS {e}_share" for e in EMOTIONS)
    return {
        **(_word_parts(rel, key) if words else {}),
        "found": f"SELECT key, {sums} FROM words2 JOIN emolex ON term = low GROUP BY key",
        "emotions": f"""
            SELECT key, CASE WHEN joy IS NULL THEN 'neutral' {first} END AS primary_emotion,
                   CASE WHEN joy IS NULL THEN 1 ELSE {most} / ({total}) END AS emotion_confidence,
                   {shares}
            FROM split0 LEFT JOIN found USING (key)""",
    }


_ALL_WORDS = {k: PARTS[k] for k in ("lex0", "lexicon", "emolex")}


def _scored_sql(body: str, rel: str = "documents", key: str = "doc_id", cut: bool = False) -> str:
    return sql("lexicon", body, **_sentiment_parts(rel, key, cut))


def _both_sql(body: str, rel: str = "documents", key: str = "doc_id", **more: str) -> str:
    return sql(
        "lexicon emolex", body, **{**more, **_sentiment_parts(rel, key), **_emotion_parts(rel, key, words=False)}
    )


_SENTIMENT = "SELECT key AS doc_id, sentiment, compound, pos, neg, neu, confidence FROM sentiments"


@query("score_sentiment", _scored_sql(_SENTIMENT))
def score_sentiment(spark, sf):
    return S.score_sentiment(text_table(spark, sf, "documents"), "doc_id", "text", lexicons(spark, sf)[0], rules=STAND_IN_RULES)


@query("score_sentiment_cut", _scored_sql(_SENTIMENT, cut=True))
def score_sentiment_cut(spark, sf):
    """With the length limit of `clean_text` as an option."""
    return S.score_sentiment(
        text_table(spark, sf, "documents"), "doc_id", "text", lexicons(spark, sf)[0], rules=STAND_IN_RULES, max_len=5000
    )


@query("score_sentiment_large_lexicon", sql("", _SENTIMENT, **_ALL_WORDS, **_sentiment_parts("documents", "doc_id")))
def score_sentiment_large_lexicon(spark, sf):
    """A lexicon of all words, joined word by word and brought back by the text."""
    scored = S.add_sentiment(
        text_table(spark, sf, "documents").select("doc_id", "text"), "text", lexicons(spark, sf)[0], rules=STAND_IN_RULES, max_literal=100
    )
    return scored.drop("text")


# Terms of one or two words: every pair that five documents begin a line or sentence with, frequent words, and signs.
_PAIRS = """
    SELECT term FROM (SELECT low || ' ' || next AS term FROM (SELECT low, lead(low) OVER (PARTITION BY key ORDER BY i) AS next FROM words2) WHERE next IS NOT NULL)
    GROUP BY term HAVING count(*) >= 20"""
_PHRASE_LEXICON = {
    "lex0": f"SELECT w AS term FROM ({ALL_WORDS}) UNION {_PAIRS}",
    "lexicon": PARTS["lexicon"],
    # Of pairs that overlap in a row every second one counts, from the left.
    "pairs": """SELECT key, i, low || ' ' || next AS low, up2 AS up FROM (
            SELECT *, row_number() OVER (PARTITION BY key, streak ORDER BY i) AS n FROM (
                SELECT *, i - row_number() OVER (PARTITION BY key ORDER BY i) AS streak FROM (
                    SELECT key, i, low, lead(low) OVER o AS next, (up OR w = upper(w)) AND (lead(up) OVER o OR lead(w = upper(w)) OVER o) AND (up OR lead(up) OVER o) AS up2
                    FROM words2 JOIN words1 USING (key, i) WINDOW o AS (PARTITION BY key ORDER BY i)
                ) JOIN lexicon ON term = low || ' ' || next)) WHERE n % 2 = 1""",
    "merged": """SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) AS i, low, up FROM (
            SELECT key, i, coalesce(p.low, w.low) AS low, coalesce(p.up, w.up) AS up FROM words2 w LEFT JOIN pairs p USING (key, i)
            WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.key = w.key AND q.i = w.i - 1))""",
}


def _phrase_sql() -> str:
    parts = _sentiment_parts("documents", "doc_id")
    first = {k: parts.pop(k) for k in list(_word_parts("documents", "doc_id"))}
    parts["words3"] = parts["words3"].replace("FROM words2 w", "FROM merged w")
    parts["folded"] = parts["folded"].replace("len(ws) AS n", "(SELECT count(*) FROM merged m WHERE m.key = c.key) AS n")
    return sql("", _SENTIMENT, **first, **_PHRASE_LEXICON, **parts)


def _phrase_lexicon(spark, sf):
    """All words and the frequent pairs of neighbours, with values from their hash."""
    from moodquarry.functions.text import clean_text
    from moodquarry.queries.tables import hashed_valence

    low = text_table(spark, sf, "documents").select(F.lower(clean_text("text", None)).alias("low"))
    edge = S.EDGE_PUNCTUATION
    parts = low.mapInArrow(lambda batches: word_rules.counted(batches, edge, 2), "bucket int, part binary")
    pairs = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: word_rules.added_up(batches, 20), "term string")
    every = lexicons(spark, sf)[0].select("term").unionByName(pairs).distinct()
    return every.select("term", hashed_valence("term"))


@query("score_phrases", _phrase_sql())
def score_phrases(spark, sf):
    """A lexicon of words and of pairs of words; the longer term counts."""
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    return S.score_sentiment(docs, "doc_id", "text", _phrase_lexicon(spark, sf), rules=STAND_IN_RULES)


# What the default rules know, before the first words of each text.
_BEFORE = [
    "mightn't be", "needn’t be", "couldn’t", "hella", "sorta", "uber", "never so", "without doubt", "kind of", "sort of", "at least", "least",
    "not very", "VERY", "wasn't that", "hardly", "nothing", "cannot",
]
_DEFAULT_TEXTS = f"""SELECT doc_id, [{", ".join("'" + b.replace("'", "''") + "'" for b in _BEFORE)}][1 + doc_id % {len(_BEFORE)}] || ' '
    || array_to_string(regexp_extract_all(text, '[^ \\n]+')[1:12], ' ') AS text FROM documents"""


def _default_sql() -> str:
    text = sql("", _SENTIMENT, begun=_DEFAULT_TEXTS, **_ALL_WORDS, **_sentiment_parts("begun", "doc_id"))
    for kind, words in STAND_IN_RULES.items():
        if isinstance(words, list):
            text = text.replace(sql_list(words), sql_list(S.RULES[kind]))
    return text.replace(sql_list(STAND_IN_RULES["stronger"] + STAND_IN_RULES["weaker"]), sql_list(S.RULES["stronger"] + S.RULES["weaker"]))


@query("score_default_rules", _default_sql())
def score_default_rules(spark, sf):
    """The rules as they are without any option, on short texts that use them, with a null, a repeated and an odd key."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)), 1, 12)
    begin = F.element_at(F.array(*map(F.lit, _BEFORE)), (F.col("doc_id") % len(_BEFORE) + 1).cast("int"))
    docs = text_table(spark, sf, "documents").select("doc_id", F.concat(begin, F.lit(" "), F.array_join(words, " ")).alias("text"))
    return S.score_sentiment(docs, "doc_id", "text", lexicons(spark, sf)[0])


_ODD = "SELECT CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS k, lang, doc_id, text FROM documents"


@query(
    "score_without_key",
    sql("", "SELECT k, key AS doc_id, sentiment, compound, pos FROM sentiments JOIN odd ON odd.doc_id = key", odd=_ODD, **_ALL_WORDS, **_sentiment_parts("documents", "doc_id")),
)
def score_without_key(spark, sf):
    """Keys that are null or repeated, with a lexicon that is joined."""
    docs = text_table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 5).cast("string")).alias("k"), "doc_id", "text")
    scored = S.add_sentiment(docs, "text", lexicons(spark, sf)[0], rules=STAND_IN_RULES, max_literal=1)
    return scored.select("k", "doc_id", "sentiment", "compound", "pos")


_EMOTION = f"""SELECT key AS doc_id, primary_emotion, round(emotion_confidence, 6) AS emotion_confidence,
                      {", ".join(f"round({e}_share, 6) AS {e}" for e in EMOTIONS)} FROM emotions"""


def _emotion_columns(df):
    return df.select(
        "doc_id", "primary_emotion", r6("emotion_confidence"), *(F.round(F.col("emotion_scores")[e], 6).alias(e) for e in EMOTIONS)
    )


@query(
    "score_posts",
    sql(
        "posts",
        "SELECT key AS id, sentiment, compound, pos, neg, neu, confidence FROM sentiments",
        lex0=COMMON_WORDS, lexicon=PARTS["lexicon"], **_sentiment_parts("posts", "id"),
    ),
)
def score_posts(spark, sf):
    """Many short texts, with a lexicon of common words inside the row."""
    short = posts_of(text_table(spark, sf, "events"))
    return S.score_sentiment(short, "id", "text", common_lexicons(spark, sf)[0], rules=STAND_IN_RULES)


@query("score_emotion", sql("emolex", _EMOTION, **_emotion_parts("documents", "doc_id")))
def score_emotion(spark, sf):
    return _emotion_columns(S.score_emotion(text_table(spark, sf, "documents"), "doc_id", "text", lexicons(spark, sf)[1]))


@query("score_emotion_large_lexicon", sql("", _EMOTION, **_ALL_WORDS, **_emotion_parts("documents", "doc_id")))
def score_emotion_large_lexicon(spark, sf):
    """A lexicon of all words."""
    df = S.score_emotion(text_table(spark, sf, "documents"), "doc_id", "text", lexicons(spark, sf)[1], max_literal=100)
    return _emotion_columns(df)


@query(
    "analyze_full",
    _both_sql(
        """SELECT key AS doc_id, CASE WHEN length(clean) > 200 THEN substr(clean, 1, 200) || '...' ELSE clean END AS text,
                  sentiment, compound, pos, neg, neu, primary_emotion, round(emotion_confidence, 6) AS confidence,
                  'lexicon' AS model_used FROM sentiments JOIN emotions USING (key)"""
    ),
)
def analyze_full(spark, sf):
    df = S.analyze_full(text_table(spark, sf, "documents"), "doc_id", "text", lexicons(spark, sf), rules=STAND_IN_RULES)
    return df.withColumn("confidence", F.round("confidence", 6)).drop("emotion_scores")


@query(
    "analyze_full_with_model",
    _both_sql(
        """SELECT key AS doc_id, CASE WHEN quality IS NULL THEN sentiment WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
                  CASE WHEN quality IS NULL THEN compound ELSE quality END AS compound,
                  CASE WHEN quality IS NULL THEN primary_emotion ELSE 'joy' END AS primary_emotion,
                  CASE WHEN quality IS NULL THEN 'lexicon' ELSE 'model' END AS model_used
           FROM sentiments JOIN emotions USING (key) LEFT JOIN labels ON doc_id = key"""
    ),
)
def analyze_full_with_model(spark, sf):
    """Labelled documents stand for those the model answers; the others fall back."""
    labels = table(spark, sf, "labels")

    def model(df):
        return df.join(labels, "doc_id").select(
            "doc_id",
            F.when(F.col("quality") == 1, "positive").otherwise("neutral").alias("sentiment"),
            F.col("quality").cast("double").alias("compound"),
            F.lit("joy").alias("primary_emotion"),
            F.lit(0.9).alias("confidence"),
        )

    df = S.analyze_full(text_table(spark, sf, "documents"), "doc_id", "text", lexicons(spark, sf), model, rules=STAND_IN_RULES)
    return df.select("doc_id", "sentiment", "compound", "primary_emotion", "model_used")


_TURNS = "SELECT conv_id || '.' || turn AS id, role, text FROM conversations"


def _turns(spark, sf):
    c = text_table(spark, sf, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    return c.select(key.alias("id"), "role", "text")


@query(
    "analyze_table",
    _both_sql(
        """SELECT t.id, t.role, t.text, sentiment AS Sentiment, compound AS Compound_Score, pos AS Positive_Score,
                  neg AS Negative_Score, neu AS Neutral_Score, primary_emotion AS Primary_Emotion,
                  round(emotion_confidence, 6) AS Emotion_Confidence
           FROM turns t JOIN sentiments s ON s.key = t.id JOIN emotions e ON e.key = t.id""",
        rel="turns", key="id", turns=_TURNS,
    ),
)
def analyze_table(spark, sf):
    df = S.analyze_table(_turns(spark, sf), "id", "text", lexicons(spark, sf), rules=STAND_IN_RULES)
    return df.withColumn("Emotion_Confidence", F.round("Emotion_Confidence", 6))


_GUARDED = """SELECT CASE WHEN role = 'system' THEN ' ' ELSE text END AS text, conv_id || '.' || turn AS id FROM conversations"""


@query(
    "score_guarded",
    _both_sql(
        """SELECT t.id, sentiment, compound AS compound_score, primary_emotion,
                  CASE WHEN t.text = ' ' THEN 0 ELSE round(emotion_confidence, 6) END AS confidence,
                  CASE WHEN t.text = ' ' THEN 'none' ELSE 'lexicon' END AS model_used
           FROM turns t JOIN sentiments s ON s.key = t.id JOIN emotions e ON e.key = t.id""",
        rel="turns", key="id", turns=_GUARDED,
    ),
)
def score_guarded(spark, sf):
    """Turns of the system role count as blank."""
    df = _turns(spark, sf).withColumn("text", F.when(F.col("role") == "system", " ").otherwise(F.col("text")))
    df = S.score_guarded(df, "text", lexicons(spark, sf), "id", rules=STAND_IN_RULES)
    return df.select("id", "sentiment", "compound_score", "primary_emotion", r6("confidence"), "model_used")


@query(
    "lexicon_lookup",
    sql(
        "lexicon",
        "SELECT key AS doc_id, i - 1 AS position, low AS token, valence FROM words2 LEFT JOIN lexicon ON term = low",
        **_word_parts("documents", "doc_id"),
    ).replace("i - 1 AS position", "CAST(i - 1 AS INT) AS position"),
)
def lexicon_lookup(spark, sf):
    from moodquarry.functions.text import clean_text

    words = F.transform(S.split_words(clean_text("text", None)), F.lower)
    tokens = text_table(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("position", "token"))
    return S.lexicon_lookup(tokens, lexicons(spark, sf)[0])


def _scorer(spark, sf, rules=STAND_IN_RULES):
    """A scorer of cleaned texts."""
    lexicon = lexicons(spark, sf)[0]

    def scorer(texts, key, text):
        return S.score_sentiment(texts, key, text, lexicon, rules=rules, cleaned=True)

    return scorer


@query("map_back", _scored_sql("SELECT key AS doc_id, sentiment, compound, neu FROM sentiments"))
def map_back(spark, sf):
    defaults = {"sentiment": "neutral", "compound": 0.0, "neu": 1.0}
    df = S.map_back(text_table(spark, sf, "documents").select("doc_id", "text"), "text", _scorer(spark, sf), defaults)
    return df.drop("text")


# Labelled documents are in the cache, those of poor quality since too long ago.
_CACHED = "SELECT DISTINCT s.clean FROM sentiments s JOIN labels l ON l.doc_id = s.key WHERE quality = 1"


def _cache(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    stored = F.when(F.col("quality") == 1, stamp(AS_OF) - F.expr("INTERVAL 3 HOURS")).otherwise(stamp(AS_OF) - F.expr("INTERVAL 25 HOURS"))
    from moodquarry.functions.text import cache_key, clean_text
    from moodquarry.plans.session import settle

    keyed = docs.select(clean_text("text", None).alias("clean"), stored.alias("stored_at")).withColumn("cache_key", cache_key("clean", "quick"))
    keyed = keyed.groupBy("cache_key", "stored_at").agg(F.any_value("clean").alias("clean"))
    keyed = settle(keyed.withColumn("row", F.concat("cache_key", F.col("stored_at").cast("string"))))
    scored = _scorer(spark, sf)(keyed, "row", "clean")
    return keyed.join(scored, "row").select("cache_key", "sentiment", "compound", "stored_at")


@query(
    "score_with_cache",
    _scored_sql(
        f"""SELECT key AS doc_id, 'sentiment:quick:' || md5(clean) AS cache_key, sentiment, compound,
                   clean IN ({_CACHED}) AS from_cache FROM sentiments"""
    ),
)
def score_with_cache(spark, sf):
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    out, _ = S.score_with_cache(
        docs, "text", "quick", _scorer(spark, sf), ["sentiment", "compound"], _cache(spark, sf), 86_400, stamp(AS_OF)
    )
    return out.drop("text")


@query(
    "new_cache_rows",
    _scored_sql(
        f"""SELECT DISTINCT 'sentiment:quick:' || md5(clean) AS cache_key, sentiment, compound,
                   TIMESTAMP '{AS_OF}' AS stored_at FROM sentiments WHERE clean NOT IN ({_CACHED})"""
    ),
)
def new_cache_rows(spark, sf):
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    _, new = S.score_with_cache(
        docs, "text", "quick", _scorer(spark, sf), ["sentiment", "compound"], _cache(spark, sf), 86_400, stamp(AS_OF)
    )
    return new.withColumn("stored_at", F.col("stored_at").cast("timestamp_ntz"))


@query(
    "score_kept_cache",
    _scored_sql(
        """SELECT key AS doc_id, 'sentiment:quick:' || md5(clean) AS cache_key, sentiment, compound,
                  clean IN (SELECT clean FROM sentiments WHERE key % 2 = 0) AS from_cache FROM sentiments"""
    ),
)
def score_kept_cache(spark, sf):
    """Half of the documents fill the cache, and a second run scores only the texts that are new to it."""
    from moodquarry.operators.cache import ScoreCache, score_through_cache
    from moodquarry.plans.scratch import new_folder

    docs, folder = text_table(spark, sf, "documents").select("doc_id", "text"), new_folder(spark, "cache")
    cache = ScoreCache(spark, "scores_" + folder[-8:], folder, {"sentiment": "string", "compound": "double"}, 8)
    run = lambda df: score_through_cache(df, "text", "quick", _scorer(spark, sf), cache, 86_400, stamp(AS_OF))
    run(docs.where("doc_id % 2 = 0"))
    return run(docs).drop("text")
