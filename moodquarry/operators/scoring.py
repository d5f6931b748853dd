"""Sentiment and emotion scores from lexicon tables.

The score rules are those of the published lexicon-and-rule method for short texts: capitals,
degree words, negation, "but" and punctuation change the strength of a lexicon word. Scoring always
looks terms up inside the row, where `word_rules` adds up a batch of texts. Every task knows a small lexicon, so nothing moves and it works on
streams; of a larger one each distinct text gets the rare terms that it has, by one join of narrow
rows. So scores never depend on the lexicon's size, nor on any key.

A term may have several words, or be signs such as ":)". Of terms that begin at the same word the longest
counts, and its words are then one word to all rules.
"""

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodquarry.functions.labels import EMOTIONS, compound_to_label
from moodquarry.functions.text import cache_key, clean_text, preview, strip
from moodquarry.operators import word_rules
from moodquarry.plans.lookup import MAX_LITERAL_ROWS, MAX_LOOKUP_ROWS, constant_lookup, may_have, small_copy, small_map
from moodquarry.plans.session import settle
from moodquarry.plans.skew import hot_join

# Its code goes along to the tasks, which need not have this library.
cloudpickle.register_pickle_by_value(word_rules)

# Fixed values of the published method; every one is only a default.
ALPHA = 15.0
CAPS_FACTOR = 0.733
DEGREE = 0.293
DAMPING = (1.0, 0.95, 0.9)
NEGATION = -0.74
PRAISE, PRAISE_FACTOR = ("so", "this"), 1.25
SOFT = ("kind", "sort")  # before "of"
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "mustnt", "neither", "never", "none", "nope", "nor", "not", "nothing",
    "nowhere", "rarely", "seldom", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt",
    "ain't", "aren't", "can't", "couldn't", "didn't", "doesn't", "don't", "hadn't", "hasn't",
    "haven't", "isn't", "mustn't", "shouldn't", "wasn't", "weren't", "won't", "wouldn't", "despite",
]
STRONGER = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fully", "greatly", "hella",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite",
    "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber",
    "unbelievably", "unusually", "utterly", "very",
]
WEAKER = ["almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally",
          "partly", "scarcely", "slightly", "somewhat", "sorta"]
CONTRACTION = "n't"  # whatever ends so is a negation, like those above
APOSTROPHES = word_rules.APOSTROPHES
EDGE_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
AT_EDGE = r"^[!-/:-@\[-`{-~]|[!-/:-@\[-`{-~]$"
RULES = {"negators": NEGATORS, "stronger": STRONGER, "weaker": WEAKER, "contraction": CONTRACTION}

SCORES = ["sentiment", "compound", "pos", "neg", "neu", "confidence"]
EMOTION_SCORES = ["primary_emotion", "emotion_confidence", "emotion_scores"]


def split_words(clean: Column) -> Column:
    """Words with edge punctuation removed; a word of nothing but punctuation stays."""
    edge = F.lit(EDGE_PUNCTUATION)
    raw = F.filter(F.split(clean, " "), lambda w: w != "")

    def bare(w: Column) -> Column:
        # Most words have no punctuation at an edge, and testing is cheaper than trimming.
        return F.when(w.rlike(AT_EDGE), F.coalesce(F.nullif(F.trim(w, edge), F.lit("")), w)).otherwise(w)

    return F.transform(raw, bare)


def _modifiers(rules: dict) -> dict[str, tuple[float, float]]:
    """Degree and turn factor of every modifier word."""
    kinds = {w: (DEGREE, 1.0) for w in rules["stronger"]}
    kinds |= {w: (-DEGREE, 1.0) for w in rules["weaker"]}
    return kinds | {w: (0.0, NEGATION) for w in rules["negators"]}


def _fixed(rules: dict) -> word_rules.Rules:
    return word_rules.Rules(
        _modifiers(rules), rules.get("contraction"), NEGATION, DEGREE, DAMPING, CAPS_FACTOR, PRAISE, PRAISE_FACTOR, SOFT, BEFORE_BUT, AFTER_BUT
    )


def _emphasis(clean: Column) -> Column:
    """What exclamation and question marks add to the sum."""
    marks = F.length(clean) - F.length(F.replace(clean, F.lit("!"), F.lit("")))
    asks = F.length(clean) - F.length(F.replace(clean, F.lit("?"), F.lit("")))
    return F.least(marks, F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + (
        F.when(asks > 3, MANY_QUESTIONS).when(asks > 1, asks * QUESTION).otherwise(0.0)
    )


def _with_words(df: DataFrame, text: str, max_len: int | None, cleaned: bool = False) -> DataFrame:
    """Add the cleaned text, which `text` may be already."""
    return df.withColumn("_clean", F.coalesce(text, F.lit("")) if cleaned else clean_text(text, max_len))


def plain_apostrophes(c: Column | str) -> Column:
    return F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))


def _plain_lexicon(lexicon: DataFrame, *values: str) -> DataFrame:
    """Terms as `_low`, in lower case, whose words have no punctuation at their edges, with the columns `values`."""
    term = F.array_join(split_words(F.lower(plain_apostrophes(F.regexp_replace("term", r"\s+", " ")))), " ")
    term = F.when(F.col("term").rlike(r"^\p{Ll}+\z"), F.col("term")).otherwise(term)  # most are one word that is so already
    return lexicon.select(term.alias("_low"), *values).where(F.col("_low") != "")


def _stretches(clean: Column, sizes: range, known: word_rules.Known | None = None) -> Column:
    """All stretches of so many words, joined by blanks; or each different one that is not `known`."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return word_rules.stretches(texts, EDGE_PUNCTUATION, sizes, known)

    return run(clean)


# Terms that every task knows when a lexicon is joined: the most frequent ones of the texts, as a sample of rows has them.
COMMON_TERMS, SAMPLED = MAX_LOOKUP_ROWS, 1 / 16


def _with_lookups(
    df: DataFrame, text: str, max_len: int | None, tables: dict[str, DataFrame], max_literal: int, cleaned: bool = False, in_row: bool = False
) -> tuple[DataFrame, dict[str, word_rules.Terms]]:
    """`df` with its cleaned text, perhaps with a column `_known`, and for each of `tables` (_low and an array of numbers of the table's name,
    a row for each term) its terms that every task knows.

    Few terms are known whole, and all with `in_row`. The others come by one join for all tables, but for the terms that the texts have most often.
    """
    tables = {name: settle(terms) for name, terms in tables.items()}
    most = {name: terms.agg(F.max(F.size(F.split("_low", " ")))).first()[0] or 1 for name, terms in tables.items()}
    known = {name: terms.select("_low", name) for name, terms in tables.items() if in_row or terms.limit(max_literal + 1).count() <= max_literal}
    of = lambda name, table: word_rules.Terms.of(table, WIDTHS[name], most[name])
    found = {name: of(name, terms.toArrow()) for name, terms in known.items()}
    large = {name: terms for name, terms in tables.items() if name not in known}
    if not large:
        return _with_words(df, text, max_len, cleaned), found
    if df.isStreaming:
        raise ValueError(f"a lexicon of over {max_literal} terms is joined, which a stream does batch by batch: use streaming.control.start_fan_out, or in_row")
    every = next(iter(large.values()))
    if len(large) > 1:
        whole = lambda name, terms: terms.select("_low", *(F.col(n) if n == name else F.lit(None).cast("array<double>").alias(n) for n in large))
        every = reduce(DataFrame.unionByName, (whole(*item) for item in large.items())).groupBy("_low").agg(*(F.max(n).alias(n) for n in large))
        every = settle(every)
    df, common = _join_terms(df, text, max_len, every, max(most[n] for n in large), cleaned)
    return df, found | {n: of(n, common.select(["_low", n]).filter(pc.field(n).is_valid())) for n in large}


def _join_terms(df: DataFrame, text: str, max_len: int | None, terms: DataFrame, most: int, cleaned: bool) -> tuple[DataFrame, pa.Table]:
    """`df` with its cleaned text and `_known`, the rare terms that each text has with their values, and the values of the common ones.

    Every task knows the most frequent terms and words of the texts; the sample that names them only says where a term is looked up. So each
    other term is rare, and no key of the join is hot. These come to their text by narrow rows of its hash,
    so rows with equal, repeated or null keys get the scores of their text.
    """
    values = [c for c in terms.columns if c != "_low"]
    # Texts of one hash share what they bring along, which then has more terms than each of them needs.
    keyed = df.withColumn("_text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    # Of several words only those that some term may have.
    may_be = may_have(terms.where(F.contains("_low", F.lit(" "))), "_low") if most > 1 else None
    possible = lambda words: words.where(~F.contains("_low", F.lit(" ")) | may_be(F.col("_low"))) if may_be else words
    sizes = range(1, most + 1)
    sample = _with_words(df.select(text).sample(SAMPLED, 1), text, max_len, cleaned)
    common = _often(possible(sample.select(F.explode(_stretches(F.lower("_clean"), sizes)).alias("_low"))), terms, COMMON_TERMS).toArrow()
    named = word_rules.Known.of(pc.cast(common.column("_low").combine_chunks(), pa.binary()))[0]
    rare = _stretches(F.lower("_clean"), sizes, named)
    words = possible(_with_words(keyed.select("_text_hash", text), text, max_len, cleaned).select("_text_hash", F.explode(rare).alias("_low")))
    found = words.join(terms, "_low").select("_text_hash", F.struct("_low", *values).alias("_term"))
    own = found.repartition("_text_hash").groupBy("_text_hash").agg(F.collect_set("_term").alias("_known"))
    joined = hot_join(keyed, own, "_text_hash").drop("_text_hash")
    return _with_words(joined, text, max_len, cleaned), common


def _often(words: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """The most frequent of some words (_low) with their values, of which one that is no term has none."""
    most = words.where(F.col("_low").isNotNull()).groupBy("_low").count().orderBy(F.desc("count"), "_low").limit(rows)
    return most.join(terms, "_low", "left").drop("count")


def _known(df: DataFrame, name: str) -> list[str]:
    """The column `_known`, if it was joined for the table of that name."""
    return ["_known"] if "_known" in df.columns and name in df.schema["_known"].dataType.elementType.names else []


def _valences(lexicon: DataFrame) -> DataFrame:
    plain = _plain_lexicon(lexicon, F.col("valence").cast("double").alias("valence")).where(F.col("valence").isNotNull())
    return plain.groupBy("_low").agg(F.array(F.min("valence")).alias("valence"))


def _sentiment_columns(df: DataFrame, terms: word_rules.Terms, alpha: float, rules: dict | None) -> DataFrame:
    """Add SCORES to a frame made by `_with_lookups`."""
    known, fixed = _known(df, "valence"), _fixed(rules or RULES)

    @F.arrow_udf("struct<pos:double,neg:double,npos:int,nneg:int,n:int>")
    def sums(texts: pa.Array, lows: pa.Array, ups: pa.Array, *own: pa.Array) -> pa.Array:
        return word_rules.mood_sums(texts, lows, ups, own[0] if own else None, EDGE_PUNCTUATION, terms, fixed)

    df = df.withColumn("_sums", sums("_clean", F.lower("_clean"), F.upper("_clean"), *known)).withColumn("_e", _emphasis(F.col("_clean")))
    df = df.withColumns({f"_{c}": F.col(f"_sums.{c}") for c in ("pos", "neg", "npos", "nneg", "n")})
    total = F.col("_pos") + F.col("_neg")
    up, down = F.col("_pos") + F.col("_npos"), F.col("_nneg") - F.col("_neg")
    df = df.withColumns(
        {
            "_sum": total + F.signum(total) * F.col("_e"),
            "_up": up + F.when(up > down, F.col("_e")).otherwise(0.0),
            "_down": down + F.when(down > up, F.col("_e")).otherwise(0.0),
            "_calm": (F.col("_n") - F.col("_npos") - F.col("_nneg")).cast("double"),
        }
    ).withColumns(
        {
            "compound": F.round(F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + alpha), 4),
            "_all": F.col("_up") + F.col("_down") + F.col("_calm"),
        }
    )
    empty = F.col("_all") == 0
    share = lambda part: F.round(F.col(part) / F.when(~empty, F.col("_all")), 3)
    return df.withColumns(
        {
            "sentiment": compound_to_label(F.col("compound")),
            "pos": F.coalesce(share("_up"), F.lit(0.0)),
            "neg": F.coalesce(share("_down"), F.lit(0.0)),
            "neu": F.coalesce(share("_calm"), F.lit(1.0)),
            "confidence": F.abs("compound"),
        }
    ).drop("_sums", "_n", "_e", "_pos", "_neg", "_npos", "_nneg", "_sum", "_up", "_down", "_calm", "_all")


def add_sentiment(
    df: DataFrame,
    text: str,
    lexicon: DataFrame,
    alpha: float = ALPHA,
    rules: dict | None = None,
    max_len: int | None = None,
    max_literal: int = MAX_LITERAL_ROWS,
    cleaned: bool = False,
) -> DataFrame:
    """All columns of `df` plus the columns SCORES.

    `lexicon` has the columns term and valence; of equal terms the smallest valence counts. One of more than `max_literal` terms is joined
    to the distinct texts; on a stream that is work for the batch writer, as in `start_fan_out`. The scores are the same
    either way. Empty text is neutral with pos, neg and compound 0. Whole texts are scored unless `max_len` cuts the cleaned text;
    `cleaned` says that they come from `clean_text` and are taken as they are.
    """
    worded, found = _with_lookups(df, text, max_len, {"valence": _valences(lexicon)}, max_literal, cleaned)
    return _sentiment_columns(worded, found["valence"], alpha, rules).select(*df.columns, *SCORES)


def score_sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame, alpha: float = ALPHA, **options) -> DataFrame:
    return add_sentiment(df.select(key, text), text, lexicon, alpha, **options).select(key, *SCORES)


def _feelings(lexicon: DataFrame) -> DataFrame:
    terms = _plain_lexicon(lexicon.where(F.col("emotion").isin(EMOTIONS)), "emotion", F.col("weight").cast("double").alias("weight"))
    found = terms.groupBy("_low").agg(F.array_sort(F.collect_list(F.struct("emotion", "weight"))).alias("_found"))
    of = lambda e: F.aggregate(F.filter("_found", lambda x: x["emotion"] == e), F.lit(0.0), lambda acc, x: acc + x["weight"])
    return found.select("_low", F.array(*map(of, EMOTIONS)).alias("found"))


# How many numbers a term has.
WIDTHS = {"valence": 1, "found": len(EMOTIONS)}


def _emotion_columns(df: DataFrame, terms: word_rules.Terms) -> DataFrame:
    """Add EMOTION_SCORES to a frame made by `_with_lookups`."""
    names = [f"_{e}" for e in EMOTIONS]

    @F.arrow_udf("array<double>")
    def sums(lows: pa.Array, *own: pa.Array) -> pa.Array:
        return word_rules.value_sums(lows, own[0] if own else None, EDGE_PUNCTUATION, terms, "found")

    df = df.withColumn("_found", sums(F.lower("_clean"), *_known(df, "found")))
    df = df.withColumns({n: F.get("_found", F.lit(i)) for i, n in enumerate(names)}).drop("_found")
    df = df.withColumns({"_all": sum((F.col(n) for n in names[1:]), F.col(names[0])), "_max": F.greatest(*names)})
    none = F.col("_all") <= 0
    total = F.when(~none, F.col("_all"))
    primary = F.when(none, "neutral")
    for name, emotion in zip(names, EMOTIONS):
        primary = primary.when(F.col(name) == F.col("_max"), emotion)
    shares = [F.coalesce(F.col(n) / total, F.lit(1.0 if e == "neutral" else 0.0)) for n, e in zip(names, EMOTIONS)]
    return df.withColumns(
        {
            "primary_emotion": primary,
            "emotion_confidence": F.coalesce(F.col("_max") / total, F.lit(1.0)),
            "emotion_scores": F.create_map(*[x for e, s in zip(EMOTIONS, shares) for x in (F.lit(e), s)]),
        }
    ).drop("_all", "_max", *names)


def add_emotion(
    df: DataFrame,
    text: str,
    lexicon: DataFrame,
    max_len: int | None = None,
    max_literal: int = MAX_LITERAL_ROWS,
) -> DataFrame:
    """All columns of `df` plus primary_emotion, emotion_confidence and the map emotion_scores.

    `lexicon` has the columns term, emotion and weight. Scores are shares of the weights found;
    the first label in order wins a tie; a text without any hit is neutral with score 1.
    """
    worded, found = _with_lookups(df, text, max_len, {"found": _feelings(lexicon)}, max_literal)
    return _emotion_columns(worded, found["found"]).select(*df.columns, *EMOTION_SCORES)


def score_emotion(df: DataFrame, key: str, text: str, lexicon: DataFrame, **options) -> DataFrame:
    scored = add_emotion(df.select(key, text), text, lexicon, **options)
    return scored.select(key, *EMOTION_SCORES)


def add_analysis(
    df: DataFrame,
    text: str,
    lexicons: tuple[DataFrame, DataFrame],
    rules: dict | None = None,
    max_len: int | None = None,
    max_literal: int = MAX_LITERAL_ROWS,
    in_row: bool = False,
) -> DataFrame:
    """Both lexicon scores side by side, from one look at the words; `lexicons` are the sentiment
    and the emotion lexicon. `in_row` gives every task all terms, whatever their number: about 150 bytes each in the driver and in each worker."""
    scored = _analysis(df, text, lexicons, rules, max_len, max_literal, in_row)
    return scored.select(*df.columns, *SCORES[:-1], "sentiment_confidence", *EMOTION_SCORES)


def _analysis(df, text, lexicons, rules=None, max_len=None, max_literal=MAX_LITERAL_ROWS, in_row=False) -> DataFrame:
    """`add_analysis` with the cleaned text as `_clean`."""
    tables = {"valence": _valences(lexicons[0]), "found": _feelings(lexicons[1])}
    worded, found = _with_lookups(df, text, max_len, tables, max_literal, in_row=in_row)
    scored = _sentiment_columns(worded, found["valence"], ALPHA, rules)
    return _emotion_columns(scored.withColumnRenamed("confidence", "sentiment_confidence"), found["found"])


def analyze_full(
    df: DataFrame,
    key: str | None,
    text: str,
    lexicons: tuple[DataFrame, DataFrame],
    model: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Full result per row, with its key if there is one. `model` maps (key, text) to (key, sentiment, compound, primary_emotion,
    confidence) and needs a unique key; rows it leaves out or null fall back to the lexicons."""
    keys = [] if key is None else [key]
    scored = _analysis(df.select(*keys, text), text, lexicons, **options)
    scored = scored.withColumnRenamed("emotion_confidence", "confidence")
    scored = scored.withColumn("model_used", F.lit("lexicon"))
    if model is not None:
        own = ["sentiment", "compound", "primary_emotion", "confidence"]
        found = model(df.select(key, text)).select(key, *[F.col(c).alias(f"_{c}") for c in own])
        scored = scored.join(found, key, "left")
        got = F.col("_sentiment").isNotNull()
        scored = scored.withColumns(
            {c: F.when(got, F.col(f"_{c}")).otherwise(F.col(c)) for c in own}
            | {"model_used": F.when(got, "model").otherwise("lexicon")}
        )
    return scored.select(
        *keys,
        preview("_clean", 200).alias("text"),
        "sentiment", "compound", "pos", "neg", "neu", "primary_emotion", "confidence", "emotion_scores", "model_used",
    )


def analyze_table(
    df: DataFrame, key: str | None, text: str, lexicons: tuple[DataFrame, DataFrame], emotions: bool = True, **options
) -> DataFrame:
    """The input columns plus score columns; null text scores as empty text. Scores need no key; one that is named may hold anything."""
    names = {
        "sentiment": "Sentiment", "compound": "Compound_Score", "pos": "Positive_Score",
        "neg": "Negative_Score", "neu": "Neutral_Score",
    }
    if emotions:
        scored = add_analysis(df, text, lexicons, **options)
        names |= {"primary_emotion": "Primary_Emotion", "emotion_confidence": "Emotion_Confidence"}
    else:
        scored = add_sentiment(df, text, lexicons[0], **options)
    return scored.select(*df.columns, *[F.col(c).alias(n) for c, n in names.items()])


def score_guarded(df: DataFrame, text: str, lexicons: tuple[DataFrame, DataFrame], key: str | None = None, **options) -> DataFrame:
    """Input columns plus the five stream columns; a blank text is neutral and names no model."""
    scored = add_analysis(df, text, lexicons, **options)
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    return scored.select(
        *df.columns,
        "sentiment",
        F.col("compound").alias("compound_score"),
        "primary_emotion",
        F.when(blank, 0.0).otherwise(F.col("emotion_confidence")).alias("confidence"),
        F.when(blank, "none").otherwise("lexicon").alias("model_used"),
    )


def lexicon_lookup(tokens: DataFrame, lexicon: DataFrame, token: str = "token", max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Valence of each token row, null if the lexicon does not have it. Of a lexicon of more than `max_rows` terms only rare tokens are joined."""
    valences = lexicon.groupBy(F.col("term").alias(token)).agg(F.min("valence").alias("valence"))
    small = small_copy(valences, max_rows)
    if small is not None:
        return tokens.join(F.broadcast(small), token, "left")
    # The sample only says which tokens are joined; those left are rare, so no key is hot.
    common = _often(tokens.select(F.col(token).alias("_low")).sample(SAMPLED, 1), valences.withColumnRenamed(token, "_low"), MAX_LITERAL_ROWS)
    values = F.struct(*(c for c in common.columns if c != "_low")).alias("_v")
    common = constant_lookup(small_map(common.select("_low", values), "_low", "_v", MAX_LITERAL_ROWS), "struct<valence:double>")
    marked = tokens.withColumn("_found", common(F.col(token)))
    here = F.col("_found").isNotNull() | F.col(token).isNull()
    order = [token, *(c for c in tokens.columns if c != token)]
    rest = marked.where(~here).select(order).join(valences, token, "left")
    return marked.where(here).select(*order, F.col("_found.valence").alias("valence")).unionByName(rest)


def _text_key(key: Column) -> Column:
    """`key`, known not to be null: else a join would test the whole cleaning expression at the scan."""
    return F.coalesce(key, F.lit(""))


def map_back(df: DataFrame, text: str, scorer: Callable[[DataFrame, str, str], DataFrame], defaults: dict) -> DataFrame:
    """Score each distinct cleaned text once and give every row its score.

    `scorer(texts, key, text)` gets cleaned texts, which are settled, as it may read them more than once. It returns the key and the
    columns named in `defaults`, which hold for empty texts. Rows of one hot text are split over several tasks.
    """
    keyed = df.withColumn("_clean", clean_text(text, None)).withColumn("_h", _text_key(F.md5("_clean")))
    texts = settle(keyed.groupBy("_h").agg(F.any_value("_clean").alias("_clean"), F.count(F.lit(1)).alias("_n")))
    scores = scorer(texts.where(F.col("_clean") != "").drop("_n"), "_h", "_clean").select("_h", *[F.col(c).alias(f"_{c}") for c in defaults])
    found = hot_join(keyed.drop("_clean"), scores, "_h", counts=texts.select("_h", "_n"))
    return found.select(*df.columns, *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def score_with_cache(
    df: DataFrame,
    text: str,
    kind: str,
    scorer: Callable[[DataFrame, str, str], DataFrame],
    columns: list[str],
    cache: DataFrame,
    ttl_seconds: int,
    as_of: Column,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scores of all rows, reusing cached ones younger than the limit, and the new cache rows.

    `cache` has cache_key, `columns` and stored_at. Each missing text is cleaned once, settled and scored once by `scorer(texts, key, text)`,
    which gets cleaned texts; with `folder` the new rows are written there and both results read them, so that using both does
    not score again.
    """
    keyed = df.withColumn("_clean", clean_text(text, None))
    keyed = keyed.withColumn("cache_key", _text_key(cache_key("_clean", kind)))
    fresh = cache.where(F.col("stored_at") > as_of - F.make_interval(secs=F.lit(ttl_seconds)))
    fresh = fresh.groupBy("cache_key").agg(F.max_by(F.struct(*columns), "stored_at").alias("_r"))
    fresh = fresh.select("cache_key", "_r.*", F.lit(True).alias("from_cache"))
    texts = keyed.groupBy("cache_key").agg(F.any_value("_clean").alias("_clean"), F.count(F.lit(1)).alias("_n"))
    marked = texts.join(fresh.select("cache_key", "from_cache"), "cache_key", "left")
    # The scorer reads its texts more than once; those that the cache has are only counted.
    marked = settle(marked.select("cache_key", "_n", "from_cache", F.when(F.col("from_cache").isNull(), F.col("_clean")).alias("_clean")))
    missing = marked.where(F.col("from_cache").isNull()).select("cache_key", "_clean")
    scored = scorer(missing, "cache_key", "_clean").select("cache_key", *columns)
    if folder is not None:
        scored.write.parquet(folder)
        scored = df.sparkSession.read.parquet(folder)
    known = fresh.unionByName(scored.withColumn("from_cache", F.lit(False)))
    return hot_join(keyed.drop("_clean"), known, "cache_key", counts=marked.select("cache_key", "_n")), scored.withColumn("stored_at", as_of)
