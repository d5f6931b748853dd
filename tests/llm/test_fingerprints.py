import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from moodquarry.llm.fingerprints import BINS, PROBES, SHINGLE, add_print, fingerprint_edits, likeness, with_next


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def ints(a, b):
    return int.from_bytes(struct.pack("<i", a), "little"), int.from_bytes(struct.pack("<i", b), "little")


def hash_ints(spark, pairs):
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    return {(r.a, r.b): r.h for r in rows}


def test_prints_by_definition(spark, frame, texts):
    some = ["", "one", "one two three", "a b c d e f", *[t[:2000] for t in list(texts.values())[:12]]]
    order = hash_ints(spark, [(j, t) for j in range(BINS) for t in range(BINS)])
    got = add_print(frame("i int, t string", list(enumerate(some))), "t", "p").orderBy("i").collect()
    for row, text in zip(got, some):
        words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        if not words:
            assert row.p == []
            continue
        hashes = [longs(*words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or [longs(*words)]
        least = {}
        for h in sorted(hashes):
            least.setdefault((h % (1 << 64)) * BINS >> 64, h)
        want = []
        for j in range(BINS):
            tried = [j, *(order[j, t] % BINS for t in range(PROBES)), *sorted(least, key=lambda b: order[j, b])]
            want.append((least[next(b for b in tried if b in least)] & 255) - 128)
        assert row.p == want


def test_edits_and_likeness(documents, texts):
    got = {r.doc_id: r for r in fingerprint_edits(documents, "doc_id", "text").collect()}
    ids = sorted(texts, reverse=True)
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    errors = []
    for d, e in zip(ids, [*ids[1:], ids[0]]):
        half = len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + texts[e][:half]
        assert got[d].n_chars == len(texts[d]) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[d].fingerprint == got[e].fingerprint) == (got[d].near_next == 1.0)
        a, b = cut(texts[d]), cut(edited)
        errors.append(got[d].near_edited - len(a & b) / len(a | b))
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.15


def test_next_over_many_buckets(frame):
    rows = [(i * i % 1009, f"t{i}") for i in range(300)]
    df = frame("id bigint, t string", rows + [(None, "x"), (None, "y")])
    ids = sorted((i for i, _ in rows), reverse=True)
    for size in (1, 7, 1000):
        got = with_next(df.withColumn("own", F.col("id")), ["t", "own"], size).collect()
        assert len(got) == 302 and all(r.next_own is None for r in got if r.id is None)
        pairs = sorted(((r.id, r.next_own) for r in got if r.id is not None), reverse=True)
        assert sorted(p[1] for p in pairs) == sorted(ids)
        once = {i for i in ids if ids.count(i) == 1}
        assert all(b == ids[(ids.index(a) + 1) % len(ids)] for a, b in pairs if a in once)


def test_odd_rows(odd, frame):
    got = fingerprint_edits(odd, "doc_id", "text").collect()
    assert len(got) == 10 and {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert [r.near_next for r in got if r.doc_id is None] == [0.0] and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprint_edits(odd.limit(0), "doc_id", "text").count() == 0
    alone = fingerprint_edits(frame("doc_id bigint, text string", [(4, "a b c d")]), "doc_id", "text").first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()


def test_likeness_of_chance_is_none(frame):
    df = frame("a array<tinyint>, b array<tinyint>", [([1, 2, 3, 4], [1, 2, 3, 4]), ([1, 2], [3, 4]), ([], []), ([], [1, 2])])
    assert [r[0] for r in df.select(likeness("a", "b")).collect()] == [1.0, 0.0, 1.0, 0.0]
