import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodquarry.llm.packing import pack, pack_documents, packing_order, sum_of_squares
from moodquarry.llm.tables import keep
from moodquarry.llm.token_output import GapTree, _dealt, best_fit_decreasing, packed_matrices
from moodquarry.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids(texts):
    found = Tokenizer.from_file(PATH).encode_batch(list(texts.values()), add_special_tokens=False)
    return {d: [*e.ids, 1] for d, e in zip(texts, found)}


def test_words_give_the_library_ids(texts):
    odd = [
        "It's  don't\t'sx ''s <|endoftext|>a b<|startoftext|> É é ́x 5a6 Σας ΑΣ İi ßX a b \r\n x\u0085y 漢字 a_b!? __ `x` a'", "", " ",
        "\n\n", "ﬁ ǅ ÀÉ'S A'LL'", "a" * 300, "<|", "x<|endoftext|>.", "12 345,6", "é́",
    ]
    library, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    some = [*odd, *list(texts.values())[:60]]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_each_item_goes_where_the_squares_are_least():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 41, 300), 40
    bins, offsets = sum_of_squares(lengths, capacity)
    least, fill, counts = -(-int(lengths.sum()) // capacity), [], np.zeros(capacity + 1, int)
    for size, b, o in zip(lengths, bins, offsets):
        def squares(k):
            after = counts.copy()
            if k < len(fill):
                after[capacity - fill[k]] -= 1
            gap = capacity - (fill[k] if k < len(fill) else 0) - size
            after[gap] += gap > 0
            return int((after * after).sum())

        fits = [k for k in range(len(fill)) if fill[k] + size <= capacity]
        places = fits + [len(fill)] * (len(fill) < least or not fits)
        assert squares(b) == min(map(squares, places)) and o == (fill[b] if b < len(fill) else 0)
        if b == len(fill):
            fill.append(0)
        elif capacity - fill[b]:
            counts[capacity - fill[b]] -= 1
        fill[b] += size
        counts[capacity - fill[b]] += fill[b] < capacity
    assert max(fill) <= capacity


def test_order_keeps_all():
    lengths = np.array([5, 1, 900, 3, 3, 40, 1])
    assert sorted(packing_order(lengths, 1000)) == list(range(7))


def check_places(got, capacity):
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1]] and one.length.sum() <= capacity


def test_documents_round_trip(documents, ids):
    got = pack_documents(documents, "doc_id", "text", PATH, 1).toPandas()
    for r in got.itertuples():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.piece == r.start // 4096
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(v) for d, v in ids.items()}
    check_places(got, 4096)
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 4096) + 1


def test_groups_and_equal_rows(spark, frame):
    rows = keep(frame("name string, length bigint", [("same", 3)] * 400 + [(f"n{i}", i % 10 + 1) for i in range(400)]), "t")
    got = pack(rows, 10, 100).toPandas()
    assert len(got) == 800 and sorted(got.length) == sorted([3] * 400 + [i % 10 + 1 for i in range(400)])
    check_places(got, 10)


def test_odd_rows(odd):
    got = pack_documents(odd, "doc_id", "text", PATH, 1, 64).toPandas()
    check_places(got, 64)
    assert got[got.doc_id.isin([2, 3, 4])].length.tolist() == [1, 1, 1] and got.doc_id.isna().sum() == 1
    assert pack_documents(odd.limit(0), "doc_id", "text", PATH, 1).count() == 0
    assert packed_matrices(odd.limit(0), "doc_id", "text", PATH, 1).count() == 0


def test_gap_tree_finds_the_smallest():
    rng, tree, gaps = np.random.default_rng(1), GapTree(50), []
    for _ in range(500):
        if gaps and rng.random() < 0.4:
            tree.add(gaps.pop(int(rng.integers(len(gaps)))), -1)
        else:
            gaps.append(int(rng.integers(1, 51)))
            tree.add(gaps[-1], 1)
        size = int(rng.integers(1, 51))
        assert tree.smallest(size) == min((g for g in gaps if g >= size), default=-1)


def test_best_fit_decreasing_by_hand():
    bins, offsets = best_fit_decreasing(np.array([2, 7, 3, 5, 4]), 10)
    assert bins.tolist() == [1, 0, 0, 1, 2] or bins.tolist() == [2, 0, 0, 1, 1]
    assert offsets[1] == 0 and offsets[2] == 7


@pytest.mark.parametrize("rows, capacity", [(2, 512), (64, 4096)])
def test_matrices_round_trip(documents, ids, rows, capacity):
    found = {}
    for m in packed_matrices(documents, "doc_id", "text", PATH, 1, 0, capacity, rows).collect():
        flat = np.frombuffer(m.ids, "<u2")
        assert len(flat) == m.n_rows * m.n_cols == m.cu_seqlens[-1] and m.n_cols == capacity and m.n_rows <= rows
        assert m.position_resets == m.cu_seqlens[:-1] and m.cu_seqlens[0] == 0
        for d, piece, start, a, b in zip(m.doc_ids, m.pieces, m.starts, m.cu_seqlens, m.cu_seqlens[1:]):
            assert a // capacity == (b - 1) // capacity
            if piece is None:
                assert not flat[a:b].any() and b % capacity == 0
            else:
                found.setdefault(d, {})[start] = flat[a:b].tolist()
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in found.items()} == ids


def test_matrices_of_odd_rows(odd):
    got = packed_matrices(odd, "doc_id", "text", PATH, 1, 0, 64).collect()
    named = [(d, p) for m in got for d, p in zip(m.doc_ids, m.pieces) if p is not None]
    assert sum(d is None for d, _ in named) == 1 and (2, 0) in named and named.count((1, 0)) == 3
    with pytest.raises(Exception, match="ids beyond"):
        packed_matrices(odd, "doc_id", "text", PATH, 70_000).collect()


def test_large_ids_beside_a_null_id(frame):
    large = [(1 << 53) + 1, (1 << 53) + 3, (1 << 62) + 1]
    docs = frame("doc_id bigint, text string", [(d, "some words") for d in [*large, None]])
    assert {r.doc_id for r in pack_documents(docs, "doc_id", "text", PATH, 1).collect()} == {*large, None}
    named = [d for m in packed_matrices(docs, "doc_id", "text", PATH, 1).collect() for d, p in zip(m.doc_ids, m.pieces) if p is not None]
    assert len(named) == 4 and set(named) == {*large, None}


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_by_definition(seed):
    rng = np.random.default_rng(seed)
    lengths, capacity = rng.integers(1, 31, 200), 30
    bins, offsets = best_fit_decreasing(lengths, capacity)
    fill = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [k for k in range(len(fill)) if fill[k] + lengths[i] <= capacity]
        least = min((capacity - fill[k] for k in fits), default=None)
        if least is None:
            assert bins[i] == len(fill) and offsets[i] == 0
            fill.append(0)
        else:  # any of the open bins with the least gap
            assert capacity - fill[bins[i]] == least and offsets[i] == fill[bins[i]]
        fill[bins[i]] += lengths[i]


def test_rows_are_dealt_by_content(spark, frame):
    rows = [(i, f"text {i} " * (i % 5)) for i in range(300)] + [(7, "the same")] * 3500 + [(None, None)] * 1200
    df = frame("id bigint, text string", rows)
    group = lambda d: sorted(map(str, _dealt(d, 2000).collect()))
    first = group(df)
    assert first == group(df.repartition(5)) == group(df.orderBy(F.desc("text")))
    assert len(first) == len(rows)
    of_copies = _dealt(df, 2000).filter("id = 7 AND text = 'the same'").groupBy("group").count().collect()
    assert len(of_copies) > 5 and max(r["count"] for r in of_copies) < 1500
