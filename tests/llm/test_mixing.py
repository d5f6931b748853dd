import numpy as np
import pytest
from pyspark.sql import functions as F

from moodquarry.llm.mixing import mixed_rows, mixed_sizes, split_tree, targets, words


def filled(sizes, weights=(3, 1, 2), share=1.5):
    want, capped = {}, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = share * sum(sizes) - sum(2 * sizes[i] for i in capped)
        want = {i: left * weights[i % 3] / sum(weights[j % 3] for j in free) for i in free}
        over = {i for i in free if want[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in capped else want[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1], [5, 900, 3, 70, 2, 1], [0, 50, 7], [3]])
def test_targets(frame, sizes):
    rows = frame("source string, source_size bigint", [(f"s{i:02}", s) for i, s in enumerate(sizes)])
    got = {r.source_no: r.target for r in targets(rows).collect()}
    assert [got[i] for i in range(len(sizes))] == pytest.approx(filled(sizes))


def test_code_point_order_with_null_last(frame):
    rows = frame("source string, source_size bigint", [(None, 1), ("b", 1), ("B", 1), ("é", 1), ("", 1)])
    got = [r.source for r in targets(rows).orderBy("source_no").collect()]
    assert got == ["", "B", "b", "é", None]


def test_the_tree_keeps_all_sums():
    quotas, capacities = np.array([5, 0, 17, 300]), np.array([100, 1, 0, 200, 21])
    got = split_tree(quotas, capacities, [1])
    assert (got.sum(axis=1) == quotas).all() and (got.sum(axis=0) == capacities).all()
    assert (got == split_tree(quotas, capacities, [1])).all() and (got != split_tree(quotas, capacities, [2])).any()


def test_taken_words_come_near(spark, documents):
    sizes = mixed_sizes(documents, "doc_id", "source", words("text"), block_size=400)
    got = sizes.join(documents.select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most).all()
    again = mixed_sizes(documents.repartition(7), "doc_id", "source", words("text"), block_size=400).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_rows_are_drawn_as_the_sizes_say(spark, documents):
    wide = documents.withColumn("block", F.lit("x")).withColumn("shard", F.lit(1))
    drawn = mixed_rows(wide, "doc_id", "source", words("text"), block_size=400)
    assert drawn.columns == wide.columns
    counts = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    sizes = mixed_sizes(documents, "doc_id", "source", words("text"), block_size=400).collect()
    assert {r.doc_id: r.taken // r["size"] for r in sizes if r.taken} == {d: n for d, n in counts.items()}


def test_odd_rows(odd):
    got = mixed_sizes(odd, "doc_id", "source", words("text")).collect()
    assert len(got) == 10 and all(r.size >= 0 and r.taken in (0, r.size, 2 * r.size) for r in got)
    assert {r.source_size for r in got if r.doc_id in (2, 7)} == {3}  # the null source
    assert mixed_sizes(odd.limit(0), "doc_id", "source", words("text")).count() == 0
    assert mixed_rows(odd, "doc_id", "source", words("text")).columns == odd.columns
    assert mixed_sizes(odd.filter("doc_id in (3, 4)"), "doc_id", "source", words("text")).first().target == 0
