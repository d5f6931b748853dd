import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moodquarry.llm.histogram_packing import Plan, pack_by_histogram, shortest_pack_first

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Fills of packs when each item, longest first, goes to the pack with the most space or a new one."""
    packs = []
    for size in sorted(lengths, reverse=True):
        at = min(range(len(packs)), key=lambda k: sum(packs[k]), default=None)
        if at is None or sum(packs[at]) + size > capacity:
            packs.append([size])
        else:
            packs[at].append(size)
    return sorted(tuple(p) for p in packs)


@pytest.mark.parametrize("seed, n, most", [(1, 300, 40), (2, 50, 9), (3, 400, 15), (4, 1, 40), (5, 0, 40)])
def test_patterns_are_those_of_single_items(seed, n, most):
    lengths = np.random.default_rng(seed).integers(1, most + 1, n).tolist()
    patterns = shortest_pack_first(np.bincount(lengths, minlength=41), 40)
    packs = sorted(tuple(x for size, times in p.runs for x in [size] * times) for p in patterns for _ in range(p.count))
    assert sorted(map(sum, packs)) == sorted(map(sum, one_by_one(lengths, 40)))
    assert sorted(x for p in packs for x in p) == sorted(lengths)
    assert all(sum(x * t for x, t in p.runs) + p.space == 40 for p in patterns)


def test_large_counts_make_few_patterns():
    counts = np.full(2049, 10**12)
    counts[0] = 0
    patterns = shortest_pack_first(counts, 2048)
    assert len(patterns) <= 3 * 2048
    assert sum(p.count * (2048 - p.space) for p in patterns) == int((counts * np.arange(2049)).sum())


def check(pieces, capacity):
    """`pieces` is (sequence, offset, length): gapless, full or a power of two."""
    by_sequence = {}
    for sequence, offset, length in pieces:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for some in by_sequence.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_id_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([3, 5, 7, 30, 33, 64, 21], rng.integers(1, 200))
    counts = np.bincount(lengths, minlength=65)
    plan = Plan(counts, 64)
    ranks = np.array([(lengths[:i] == x).sum() for i, x in enumerate(lengths)])
    sequence, offset, stream = plan.find(lengths, ranks)
    pieces = []
    for size, s, o, at in zip(lengths.tolist(), sequence, offset, stream):
        if at < 0:
            pieces.append((s, o, size))
        else:
            parts = list(plan.pour(int(at), size))
            assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist() and sum(p[1] for p in parts) == size
            pieces.extend((q, o, n) for _, n, q, o in parts)
    n = check(pieces, 64)
    assert n == plan.sequences <= -(-int(lengths.sum()) // 64) + 6


@pytest.mark.parametrize("capacity", [2048, 128])
def test_documents_round_trip(documents, texts, capacity):
    got = pack_by_histogram(documents, "doc_id", "text", PATH, 1, capacity).toPandas()
    library = Tokenizer.from_file(PATH).encode_batch(list(texts.values()), add_special_tokens=False)
    ids = {d: np.array([*e.ids, 1], "<u4") for d, e in zip(texts, library)}
    check(zip(got.sequence_id, got.offset, got.length), capacity)
    for doc, some in got.sort_values("start").groupby("doc_id"):
        assert some.start.tolist() == [0, *np.cumsum(some.length)[:-1]] and some.length.sum() == len(ids[doc])
        assert (some.doc_tokens == len(ids[doc])).all()
        for r in some.itertuples():
            assert zlib.crc32(ids[doc][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(got.doc_id) == set(ids)


def test_odd_rows(odd, frame):
    got = pack_by_histogram(odd, "doc_id", "text", PATH, 1, 64).toPandas()
    check(zip(got.sequence_id, got.offset, got.length), 64)
    assert got[got.doc_id.isin([2, 3, 4])].length.tolist() == [1, 1, 1] and got[got.doc_id.isna()].length.sum() == 4
    assert pack_by_histogram(odd.limit(0), "doc_id", "text", PATH, 1).count() == 0
    large = [(1 << 53) + 1, (1 << 53) + 3, (1 << 62) + 1]
    docs = frame("doc_id bigint, text string", [(d, "some words") for d in [*large, None]])
    assert {r.doc_id for r in pack_by_histogram(docs, "doc_id", "text", PATH, 1).collect()} == {*large, None}


def test_one_length_on_all_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'same words here' AS text").repartition(7)
    got = pack_by_histogram(docs, "doc_id", "text", PATH, 1, 16).toPandas()
    check(zip(got.sequence_id, got.offset, got.length), 16)
    assert got.groupby("doc_id").length.sum().nunique() == 1 and got.doc_id.nunique() == 3000
