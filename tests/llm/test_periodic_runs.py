import hashlib
import time
import zlib

import numpy as np
import pytest

from moodquarry.llm.periodic_runs import SquareCatcher, collapse_runs, runs_of_texts
from moodquarry.llm.queries import QUERIES


def brute(words, least=24, exponent=3):
    """All runs by trying every period, smallest first."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i + q == len(words) or words[i] != words[i + q]:
                if i + q - start >= max(least, exponent * q):
                    found.setdefault((start, i + q), q)
                start = i + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng, n):
    """Random words of a small alphabet with powers of random parts."""
    out = []
    while len(out) < n:
        part = rng.integers(0, rng.choice([2, 3, 30]), rng.integers(1, 40)).tolist()
        times = rng.choice([1, 1, 2, 3, 4, 9, 30])
        whole = part * int(times)
        out += whole[: len(whole) - int(rng.integers(0, len(part)))]
        if rng.random() < 0.3 and len(out) > 20:
            out += out[-int(rng.integers(5, len(out))) :]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_all_found(seed):
    rng = np.random.default_rng(seed)
    words = some_words(rng, int(rng.integers(1, 600)))
    catcher, at = SquareCatcher(), 0
    while at < len(words):
        size = int(rng.integers(1, 60))
        catcher.append(np.array(words[at : at + size]))
        at += size
        if rng.random() < 0.1:
            assert catcher.runs() == brute(words[:at])
    whole = SquareCatcher()
    whole.append(np.array(words))
    assert whole.runs() == catcher.runs() == brute(words)


@pytest.mark.parametrize("seed", range(10))
def test_texts_do_not_mix(seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(map(str, some_words(rng, int(rng.integers(0, 300))))) for _ in range(12)]
    texts = [" \t" + t.replace(" ", "\n", 1) + " " if i % 3 == 0 else t for i, t in enumerate(texts)]
    runs, kept, n = runs_of_texts(texts)
    for t, r, k, m in zip(texts, runs, kept.to_pylist(), n):
        assert r == brute(t.split()) and k == collapsed(t.split(), r) and m == len(t.split())


def test_short_periods_in_long_ones_are_cheap():
    part = [1] * 3000 + [2] + [1] * 2000 + [3, 2]
    words = np.array(part * 40)
    start = time.process_time()
    catcher = SquareCatcher()
    catcher.append(words)
    found = catcher.runs()
    assert (0, len(words), len(part)) in found and len(found) == 81
    assert time.process_time() - start < 20


def test_one_word_a_million_times():
    texts = ["x " * 1_000_000, "", None or "", "a b c " * 300_000]
    runs, kept, n = runs_of_texts(texts)
    assert runs == [[(0, 1_000_000, 1)], [], [], [(0, 900_000, 3)]] and kept.to_pylist() == ["x", "", "", "a b c"]


def test_odd_rows(odd, frame):
    got = collapse_runs(odd, "doc_id", "text").collect()
    assert len(got) == 10 and sum(r.doc_id is None for r in got) == 1
    assert all(r.runs == [] and r.kept == "" and r.n_words == 0 for r in got if r.doc_id in (2, 3, 4))
    assert collapse_runs(odd.limit(0), "doc_id", "text").count() == 0
    twice = frame("doc_id bigint, text string, runs int, kept int", [(1, "go on " * 20, 0, 0)] * 2)
    assert [(r.runs[0][:], r.kept) for r in collapse_runs(twice, "doc_id", "text").collect()] == [((0, 40, 2), "go on")] * 2


def test_query_against_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert set(got) == set(texts)
    planted = 0
    for doc, text in texts.items():
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        r = got[doc]
        planted += bool(runs)
        assert r.n_runs == len(runs)
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert planted > 5
    assert dict(QUERIES["op13_periodic_runs"](spark, sf).dtypes)["n_runs"] == "bigint"
