import random

import numpy as np
import pytest
import xxhash

from moodquarry.llm.components import components
from moodquarry.llm.simhash import near_duplicates, near_links, simhash


def by_definition(text, shingle):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def groups(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            return root
    return root


@pytest.mark.parametrize("text", ["", " ", "A b", "a b c d", "One two\tTHREE four  five\nsix É Ünï 漢字", "x " * 300])
def test_fingerprint_by_definition(text):
    assert simhash(text) % (1 << 64) == by_definition(text, 4)


def test_documents_against_all_pairs(spark, documents, texts):
    got = {r.doc_id: r for r in near_duplicates(documents, "doc_id", "text").collect()}
    prints = {d: by_definition(t, 4) for d, t in texts.items()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {d: r.component_id for d, r in got.items()} == groups(prints, links)


@pytest.mark.parametrize("tile_rows", [4, 1 << 17])
def test_links_join_what_all_pairs_would(spark, frame, tile_rows):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:  # chains of near values, so that some groups reach far
        for _ in range(8):
            for _ in range(rng.randint(1, 6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(frame("f bigint", [(v,) for v in signed]), 4, tile_rows).collect()
    assert all((a ^ b).bit_count() <= 4 if a * b >= 0 else ((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links)
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert groups(signed, [tuple(x) for x in links]) == groups(signed, want)


def test_components_of_a_path_a_star_and_none(frame):
    path = [(i, i + 1) for i in range(40)] + [(100, n) for n in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(frame("a bigint, b bigint", path), "a", "b").collect()}
    assert got == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 160)}}
    assert components(frame("a bigint, b bigint", []), "a", "b").count() == 0


def test_odd_rows_and_other_lengths(odd, frame):
    got = near_duplicates(odd, "doc_id", "text").collect()
    assert len(got) == 10 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert {r.doc_id for r in got if r.component_id == 5} == {5, 6}
    assert near_duplicates(odd.limit(0), "doc_id", "text").count() == 0
    two = frame("doc_id bigint, text string", [(1, "a b c"), (2, "a b d"), (None, "q r s t u v")])
    assert sorted(r.component_id or -1 for r in near_duplicates(two, "doc_id", "text", shingle=2, radius=60).collect()) == [1, 1, 1]


def test_a_forest_is_no_square():
    values = np.arange(2000, dtype=np.uint64) % np.uint64(16)
    from moodquarry.llm.simhash import forest

    assert len(forest(values, 4)) == 1999
