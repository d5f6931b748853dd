import numpy as np
import pytest
from pyspark.sql import functions as F

from moodquarry.llm.search import Metric, Tree, top_inner_products


def by_brute_force(rows, k, scale=256):
    whole = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    points = [(i, [int(np.floor(scale * np.float32(x).astype(float))) for x in v]) for i, v in rows if i is not None and whole(v)]
    out = []
    for q, a in [p for p in points if p[0] % 5 == 0]:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in points if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def result(df, **options):
    return sorted(tuple(r) for r in top_inner_products(df, "vec_id", "embedding", F.col("vec_id") % 5 == 0, **options).collect())


@pytest.mark.parametrize("page_rows, max_pivots, query_block", [(16, 4, 3), (64, 1000, 4096), (4096, 1, 1)])
def test_against_all_pairs(frame, page_rows, max_pivots, query_block):
    rng = np.random.default_rng(page_rows)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400 + i, [0.0] * 8) for i in range(20)]  # ties
    df = frame("vec_id bigint, embedding array<float>", rows)
    got = result(df, page_rows=page_rows, max_pivots=max_pivots, query_block=query_block)
    assert got == by_brute_force(rows, 5)


def test_odd_vectors(frame):
    rows = [
        (0, [1.0, 2.0]), (5, [1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [9.0, 9.0]),
        (6, []), (10, [-1.0, 0.5]),
    ]
    df = frame("vec_id bigint, embedding array<float>, id string, v int, page int", [(*r, "x", 1, 2) for r in rows])
    got = result(df)
    assert [r for r in got if r[0] == 0] == [(0, 1, 5, 65536), (0, 2, 6, 0), (0, 3, 10, 0)]
    assert result(df.limit(0)) == [] and result(df.filter("vec_id = 0")) == []


def test_a_query_on_a_repeated_row(frame):
    df = frame("vec_id bigint, embedding array<float>", [(0, [1.0]), (0, [1.0]), (7, [0.5]), (8, [0.5])])
    assert result(df) == [(0, 1, 7, 32768), (0, 2, 8, 32768)]


class Counted:
    """Vectors that count how many of them are compared."""

    def __init__(self, vectors):
        self.vectors, self.dtype, self.n = vectors, vectors.dtype, 0

    def __getitem__(self, rows):
        self.n += len(rows)
        return self.vectors[rows]


def test_bounds_spare_distances():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(4000, 3)) * 1000).astype(np.int64)
    tree = Tree([[i] for i in range(len(x))], x, Metric(int((x * x).sum(axis=1).max())))
    tree.exact = Counted(tree.exact)
    best = sorted(((s, -i) for s, i in zip((x @ x[17]).tolist(), range(len(x))) if i != 17), reverse=True)[:5]
    assert sorted(tree.search(17, x[17], 5, []), reverse=True) == best
    assert tree.exact.n < len(x) / 2


def test_large_finite_components(frame):
    """Far beyond what products in 64 bits hold, where the scores themselves fit, and saturated where they do not."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=3) * 10.0 ** int(rng.integers(0, 6))).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, [1e8 * (i - 2), 0.0, 1.0]) for i in range(6)] + [(200, [0.0, 5e6, -5e6]), (205, [0.0, 4e6, 1e6])]
    df = frame("vec_id bigint, embedding array<float>", rows)
    most = (1 << 63) - 1
    want = [(q, r, i, max(-most, min(s, most))) for q, r, i, s in by_brute_force(rows, 5)]
    assert {(q, s) for q, _, _, s in result(df, page_rows=8)} == {(q, s) for q, _, _, s in want}
    huge = frame("vec_id bigint, embedding array<float>", [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0]), (5, [0.0, 1.0])])
    got = {(q, i): s for q, _, i, s in result(huge)}
    assert got[0, 1] == most and got[0, 2] == -most and got[0, 5] == 65536 and got[5, 0] == 65536
