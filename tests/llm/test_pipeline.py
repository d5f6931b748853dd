import random

import corpus_pipeline as pipeline
from moodquarry.llm import queries
from moodquarry.llm.tables import keep


def test_stages_keep_the_columns(spark, documents, sf):
    docs, ids = documents, None
    for name, stage in pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, sf), name)
        assert out.schema.names == documents.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in documents.schema]
        if name != "source_mixing":
            assert out.count() == out.select("doc_id").distinct().count() <= docs.count()
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
    assert pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] > 0


def test_stages_by_their_operators(spark, documents, sf):
    groups = queries.QUERIES["op3_simhash_near_dedup"](spark, sf).filter("doc_id = component_id")
    left = pipeline.simhash_stage(spark, documents, sf)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in groups.collect())
    cut = {r.doc_id: r.n_words - r.n_removed for r in queries.QUERIES["op8_substring_dedup"](spark, sf).collect()}
    left = {r.doc_id: r for r in pipeline.substring_stage(spark, documents, sf).collect()}
    assert {d for d, n in cut.items() if n} == set(left) and all(len(left[d].text.split()) == cut[d] for d in left)
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_language_stage_rejects_what_has_no_letter(spark, odd, sf):
    left = pipeline.language_stage(spark, odd, sf)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 1, 1, 5, 6] and left.columns == odd.columns


def test_language_stage_rejects_foreign_texts_and_noise_and_keeps_words(spark, documents, frame):
    rng = random.Random(7)
    scripts = [[chr(c) for c in range(a, b)] for a, b in ((0x3B1, 0x3CA), (0x430, 0x450), (0x4E00, 0x5500), (97, 123))]
    noise = ["".join(rng.choice([*s, *" " * (len(s) // 5)]) for _ in range(n)) for s in scripts for n in (300, 3000, 30_000) for _ in range(10)]
    words = ["The", "und", "les", "and the", "Von."]
    rows = [(-1 - i, t, None, "x", len(t)) for i, t in enumerate(noise)] + [(-1000 - i, t, None, "x", len(t)) for i, t in enumerate(words)]
    docs = keep(documents.unionByName(frame(documents.schema, rows)), "planted")
    kept = {r.doc_id for r in pipeline.language_stage(spark, docs, "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in documents.collect()} | {-1000 - i for i in range(len(words))}


def test_simhash_stage_decides_by_row(spark, frame):
    """Repeated rows, null ids, a repeated id with two texts, and rows without a word."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (None, b), (3, c), (3, c), (4, c), (4, d), (5, None), (5, ""), (None, " ")]
    docs = frame("doc_id bigint, text string, lang string, source string, n_chars bigint", [(i, t, "en", "x", 0) for i, t in rows])
    left = pipeline.simhash_stage(spark, docs, "")
    assert left.schema.names == docs.schema.names
    got = [(r.doc_id, r.text or "") for r in left.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (3, c), (4, d), (5, "")], key=str)


def test_odd_and_empty_tables(spark, odd, sf):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, odd, plain.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() >= 0 and (name == "best_fit_packing" or out.columns == docs.columns)
