import hashlib
import random
import re

import numpy as np
import pytest

from moodquarry.llm.substrings import _LARGEST, drop_repeats, window_keys, without_repeats, word_hashes


def by_brute_force(rows, window=50):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        covered = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                covered[i : i + window] = [True] * window
        kept = [x for x, c in zip(w, covered) if not c]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in drop_repeats(df, "doc_id", "text", **options).collect()), key=str)


def test_equal_windows_have_equal_symbols():
    rng = random.Random(3)
    for trial in range(400):
        kinds = rng.choice([2, 3, 5, 30])
        core = [b"%d" % rng.randrange(kinds) for _ in range(50)]
        if trial % 5 == 0:
            core = [b"a"] * 50
        if trial % 7 == 0:
            core = (core[: rng.randint(1, 4)] * 50)[:50]
        found = []
        for _ in range(2):
            before = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(0, 30))] + [core[0]] * rng.randint(0, 3)
            after = [core[-1]] * rng.randint(0, 3) + [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(0, 30))]
            words = word_hashes(before + core + after, 0)
            first = np.zeros(len(words), bool)
            first[0] = True
            found.append(window_keys(words, first)[len(before)])
        assert found[0] == found[1] != _LARGEST


def test_documents(documents, texts):
    assert result(documents) == by_brute_force(texts.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_runs_and_periods(frame, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(45, 70))] for _ in range(6)]
    passages += [["x"] * 80, ["p", "q"] * 40, ["p", "q", "r"] * 30]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice("abcdefghxpq") for _ in range(rng.randint(0, 40))] + rng.choice(passages)
        rows.append((d, " ".join(words)))
    rows += [(60 + i, rows[i % 7][1]) for i in range(10)]  # whole copies
    assert result(frame("doc_id bigint, text string", rows)) == by_brute_force(rows)


def test_odd_rows(odd, frame):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long + " more"), (2, long + " tail"), (2, long + " tail"), (None, long), (3, None), (4, ""), (5, "a  b\n"), (0, "short")]
    df = frame("doc_id bigint, text string", rows)
    assert result(df) == by_brute_force(rows)
    got = drop_repeats(odd, "doc_id", "text").collect()
    assert len(got) == 10 and next(r for r in got if r.doc_id == 6).n_removed == 20_000
    assert drop_repeats(odd.limit(0), "doc_id", "text").count() == 0
    kept = without_repeats(odd, "doc_id", "text")
    assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.collect() if r.doc_id in (5, 6))[0] == "end"
    assert next(r.text for r in without_repeats(df, "doc_id", "text").collect() if r.doc_id == 5) == "a  b\n"
