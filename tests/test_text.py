import datetime

from pyspark.sql import functions as F

from moodquarry.functions import labels as L
from moodquarry.functions import text as X
from moodquarry.functions.records import iso_time
from moodquarry.functions.times import parse_post_time
from moodquarry.operators import features as FX

ODD = [
    "See https://a.b/c?d=1 and www.x.org now", "<p>Hello <b>world</b></p>", "a   b\n\n\tc", "word " * 2000, "", None, "  \t\n ",
    "no break　wide thin", "1 < 2 and 3 > 2", "tabs\tand\x1cunit\x85next", "http://only", "unclosed <tag",
    "Ünïcödé straße ÉCOLE", "mixed <a href='http://x'>link</a> end", "semi;colon!ok?yes.no,maybe",
]


# What each of ODD becomes, by hand: (cleaned, tokens).
CLEANED = [
    ("See and now", "see and now"),
    ("Hello world", "hello world"),
    ("a b c", "a b c"),
    ("word " * 1999 + "word", "word " * 1999 + "word"),
    ("", ""),
    ("", ""),
    ("", ""),
    ("no break wide thin", "no break wide thin"),
    ("1 2", "1 2"),  # from < to > counts as a tag
    ("tabs and unit next", "tabs and unit next"),
    ("", ""),
    ("unclosed <tag", "unclosed tag"),
    ("Ünïcödé straße ÉCOLE", "ünïcödé straße école"),
    ("mixed <a href=' end", "mixed end"),  # the URL goes first, and takes all up to the blank
    ("semi;colon!ok?yes.no,maybe", "semi colon!ok?yes.no maybe"),
]


def test_clean_text_follows_its_rules(value):
    want = [clean for clean, _ in CLEANED]
    assert value(X.clean_text("t"), *ODD) == want
    assert value(X.clean_text_keep_gap("t"), *ODD) == want
    cut = value(X.clean_text("t", 5000), *ODD)
    assert cut[3] == "word " * 999 + "word" and [c for i, c in enumerate(cut) if i != 3] == [c for i, c in enumerate(want) if i != 3]
    assert value(X.clean_text_keep_gap("t"), "a<br>b") == ["a b"] and value(X.clean_text("t"), "a<br>b") == ["ab"]


def test_clean_for_tokens_follows_its_rules(value):
    assert value(X.clean_for_tokens("t"), *ODD) == [tokens for _, tokens in CLEANED]


def test_tokens_and_stop_words(value):
    assert value(FX.tokenize("t"), "The cat, the dog!", "", None) == [["the", "cat", "the", "dog!"], [], []]
    assert value(FX.tokenize("t", FX.STOP_WORDS), "The cat is on the mat the cat") == [["cat", "mat", "cat"]]
    assert len(FX.STOP_WORDS) == 37


def test_strip_and_counts(value):
    texts = [t for t in ODD if t is not None]
    assert value(X.strip("t"), *texts) == [t.strip() for t in texts]
    assert value(X.word_count("t"), *texts) == [len(t.split()) for t in texts]
    assert value(X.text_length("t"), *texts) == [len(t) for t in texts]


def test_preview_body_article(value, frame):
    assert value(X.preview("t", 3), "abc", "abcd", "", None) == ["abc", "abc...", "", None]
    df = frame("title string, body string", [("T", ""), ("T", None), ("T", "B"), ("T", "x" * 600)])
    rows = df.select(X.body_or_title("body", "title"), X.article_text("title", "body")).collect()
    assert [r[0] for r in rows] == ["T", "T", "B", "x" * 600]
    assert rows[3][1] == "T " + "x" * 500


def test_hashes(value):
    assert value(X.text_hash("t"), "abc") == ["900150983cd24fb0d6963f7d28e17f72"]
    assert value(X.text_hash("t", "sha256"), "")[0].startswith("e3b0c442")
    assert value(X.cache_key("t", "full"), "abc") == ["sentiment:full:900150983cd24fb0d6963f7d28e17f72"]


def test_label_bounds_are_inclusive(frame):
    scores = [0.5, 0.06, -0.5, -0.06, 0.0, 0.04, -0.04, 0.05, -0.05]
    rows = frame("c double", [(s,) for s in scores]).select(L.compound_to_label(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["positive"] * 2 + ["negative"] * 2 + ["neutral"] * 3 + ["positive", "negative"]


def test_post_times(value):
    got = value(parse_post_time(F.col("t")).cast("timestamp_ntz"), "Mon Dec 01 10:00:00 +0000 2025", "Mon Dec 01 10:00:00 +0200 2025", "never", None)
    assert got == [datetime.datetime(2025, 12, 1, 10), datetime.datetime(2025, 12, 1, 8), None, None]


def test_iso_time(value):
    c = iso_time(F.col("t").cast("timestamp_ntz"))
    assert value(c, "2025-01-02 03:04:05", "2025-01-02 03:04:05.25") == ["2025-01-02T03:04:05", "2025-01-02T03:04:05.250000"]
