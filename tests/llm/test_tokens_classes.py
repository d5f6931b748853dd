import random
import subprocess
import sys
import time

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from moodquarry.llm import language
from moodquarry.llm.language import _grouped, _letter_vector, learn_profiles, predict_languages, vectors
from moodquarry.llm.quality import dictionary, learn_quality, score_quality
from moodquarry.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (500, 40), (1 << 15, 512)])
def test_spliced_counts_are_those_of_the_whole(texts, chunk, overlap):
    rng = random.Random(1)
    parts = ["a", "é", "漢", "🙂", " ", "  ", "\n", "<s>", "</s>", "▁", "the ", "\t", "x" * 50, "ﬁ", "́"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 200))) for _ in range(100)]
    odd += ["y" * 5000, " " * 3000, "", "漢" * 3000, "ab " * 2000, *list(texts.values())[:40]]
    model = SentencePieceProcessor(model_file=PATH)
    counter = Counter(PATH, chunk, overlap)
    assert counter.proven and counter.counts(odd) == [len(x) for x in model.encode(odd)]


def test_without_proof_the_whole_is_encoded(texts):
    counter = Counter(PATH, 64, 8)
    counter.proven = False
    long = max(texts.values(), key=len)[:3000]
    assert counter.counts([long]) == [len(counter.model.encode(long))]


def test_count_odd_rows(odd, texts, documents):
    got = count_tokens(odd, "doc_id", "text", PATH).collect()
    assert len(got) == 10 and {(r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id in (2, 3)} == {(0, 0, False)}
    assert all(r.over_limit for r in got if r.doc_id in (5, 6)) and got[0].n_tokens == got[1].n_tokens
    assert count_tokens(odd.limit(0), "doc_id", "text", PATH).count() == 0
    model = SentencePieceProcessor(model_file=PATH)
    want = {d: (len(t.encode()), len(model.encode(t))) for d, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(documents, "doc_id", "text", PATH).collect()} == want


def bundle(text, size):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    symbols = [0] + [v for w in words for v in [*map(ord, w), 0]]
    out = np.zeros(size)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        out += np.roll(_letter_vector(a, size), 2).astype(int) * np.roll(_letter_vector(b, size), 1) * _letter_vector(c, size)
    return out


def test_vectors_by_definition(texts):
    some = ["", "a", " a ", "\0", "a\0b", "  ", "12", "Ab c", "ñ漢 字", "x", "!", *list(texts.values())[:10]]
    some += ["".join(chr(0x4E00 + i) for i in range(400))]
    assert (vectors(some, 256) == np.stack([bundle(t, 256) for t in some])).all()
    assert [t for g in _grouped(some) for t in g] == some


def test_languages_of_held_out_texts(documents):
    got = predict_languages(documents, "doc_id", "text", "lang").join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 40 and (out.lang == out.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_languages_of_odd_rows(odd):
    got = {(r.doc_id, r.lang_pred, r.score) for r in predict_languages(odd, "doc_id", "text", "lang").collect()}
    assert {x for x in got if x[0] in (2, 3, 4, 7)} == {(i, "und", 0.0) for i in (2, 3, 4, 7)}
    assert predict_languages(odd.limit(0), "doc_id", "text", "lang").count() == 0
    unknown = learn_profiles(odd.filter("lang is null"), "text", "lang")
    assert unknown.predict(["abc"]) == (["und"], [0.0])


def test_quality_of_held_out_texts(spark, documents, sf):
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score_quality(large, labels, "doc_id", "text", "quality").join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    rank = out.score.rank()
    good = out.quality == 1
    area = (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert area > 0.85 and out.predicted[good].mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_without_a_class(odd, frame):
    for rows, score in (([], 0.5), ([(1, 1, 0), (3, 1, 0), (5, 1, 0)], 1.0), ([(1, 0, 0), (3, 0, 0), (5, 0, 0)], 0.0)):
        labels = frame("doc_id bigint, quality int, toxic int", rows)
        got = score_quality(odd, labels, "doc_id", "text", "quality").collect()
        assert len(got) == 10 and all(abs(r.score - score) < 1e-3 and r.predicted == int(r.score >= 0.7) for r in got)
    nulls = frame("doc_id bigint, quality int", [(None, 1), (1, None), (1, 1), (5, 0), (6, 0), (3, 1)])
    assert score_quality(odd.limit(0), nulls, "doc_id", "text", "quality").count() == 0
    model = learn_quality(odd, nulls, "doc_id", "text", "quality")
    assert all(0 <= s <= 1 for s in model.score(["", "x", "one two three"]))
    assert dictionary(["short"]) == b"short"


def test_long_text_without_spaces_is_linear():
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    counter, model = Counter(PATH), SentencePieceProcessor(model_file=PATH)
    base64 = "".join(rng.choices(letters, k=4_000_000))
    start = time.process_time()
    assert counter.counts([base64]) == [len(model.encode(base64))]
    assert time.process_time() - start < 60
    hard = ["a" * 300_000, "漢字" * 100_000, "ab" * 50_000 + " " + "c" * 200_000, base64[:200_000] + "éx" * 20_000]
    assert counter.counts(hard) == [len(x) for x in model.encode(hard)]


@pytest.mark.parametrize("chunk, overlap", [(40, 6), (300, 30)])
def test_odd_spaces_and_marks(chunk, overlap):
    rng = random.Random(4)
    parts = [" ", "　", " ", "​", "­", "\x01", "e", "́", "x", "Q", "7", "the", "\n", "\r", "﻿"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(50, 900))) for _ in range(120)]
    model = SentencePieceProcessor(model_file=PATH)
    assert Counter(PATH, chunk, overlap).counts(odd) == [len(x) for x in model.encode(odd)]


def test_vectors_of_long_texts_go_in_slices(texts, monkeypatch):
    some = ["Ab, c  dé. " * 9, "", "漢字" * 30, " .ΑΣ ΑΣ", *list(texts.values())[:5]]
    want = vectors(some, 64)
    monkeypatch.setattr(language, "_GROUP_CHARS", 7)
    assert (np.concatenate([vectors([t], 64) for t in some]) == want).all()


def test_long_text_of_many_letters_takes_bounded_memory():
    code = (
        "import resource, numpy as np\n"
        "from moodquarry.llm.language import Profiles\n"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "text = ''.join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 1_000_000)))\n"
        "Profiles(['x'], np.ones((1, 1024), np.float32), 1024).predict([text])\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)\n"
    )
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 300
