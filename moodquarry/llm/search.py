"""Exact top-k by inner product: best-first search in M-trees, one for each page of vectors."""

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodquarry.llm.tables import keep

SCALE = 256
MAX_PIVOTS = 1024  # routing objects of the top node, which every task holds
PAGE_ROWS = 4096  # vectors of a page, about
FANOUT = 32  # entries of an inner node
LEAF = 256  # vectors of a leaf
QUERY_BLOCK = 4096  # queries that meet a page in one task
_LONG = (1 << 63) - 1


class Metric:
    """Inner products of integer vectors as distances.

    Every vector x gets one more component, the root of `most` - |x|^2, and a query 0 there. Then the squared distance of a query q
    and x is |q|^2 + `most` - 2 qx: the larger the product, the smaller the distance, and the triangle inequality holds.
    """

    def __init__(self, most: int):
        self.most = most
        # Whole numbers of 64 bits hold what is computed here, or else Python's own do; doubles hold products up to 2 ** 53.
        self.whole = np.int64 if most < 1 << 60 else object
        # Of rounding in distances, so that a bound never hides an equal score.
        self.slack = 1e-6 + 1e-12 * float(most) ** 0.5

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0).astype(float))

    def between(self, x: np.ndarray, lift: np.ndarray, y: np.ndarray, y_lift: float) -> np.ndarray:
        return np.sqrt(((x - y) ** 2).sum(axis=1).astype(float) + (lift - y_lift) ** 2)

    def of_score(self, norm: int, score):
        return np.sqrt(np.maximum(norm + self.most - 2 * np.asarray(score), 0).astype(float)) if np.ndim(score) else max(0, norm + self.most - 2 * score) ** 0.5

    def matrix(self, lists, width: int) -> np.ndarray:
        out = np.zeros((len(lists), width), self.whole)
        for i, row in enumerate(lists):
            out[i, : len(row)] = row if self.whole is not object else [int(v) for v in row]
        return out


class Tree:
    """An M-tree: nodes of entries with a routing object, a covering radius and the distance to the node's own routing object."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, metric: Metric):
        self.ids, self.vectors, self.metric = ids, vectors, metric
        self.lift = metric.lift(vectors)
        # Products of vectors no longer than `most` are whole numbers that doubles hold exactly up to 2 ** 53.
        self.exact = vectors.astype(float) if metric.most < 1 << 52 else vectors
        # A node: its entries' vectors, their distances to its routing object, and for inner nodes radii and children.
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, list[int] | None]] = []
        self.root = self._build(np.arange(len(vectors)), 0)
        self.root_radius = float(self._from(0, np.arange(len(vectors))).max())

    def _from(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return self.metric.between(self.vectors[rows], self.lift[rows], self.vectors[centre], self.lift[centre])

    def _build(self, rows: np.ndarray, centre: int) -> int:
        away = self._from(centre, rows)
        if len(rows) <= LEAF or not away.any():
            self.nodes.append((rows, away, None, None))
            return len(self.nodes) - 1
        # Routing objects far from each other; every row goes to the nearest.
        chosen, near, owner = [centre], away.copy(), np.zeros(len(rows), np.int64)
        while len(chosen) < min(FANOUT, 2 + 2 * len(rows) // LEAF) and near.max() > 0:
            chosen.append(int(rows[near.argmax()]))
            there = self._from(chosen[-1], rows)
            closer = there < near
            near[closer], owner[closer] = there[closer], len(chosen) - 1
        radii, children = [], []
        for k, c in enumerate(chosen):
            own = rows[owner == k]
            radii.append(float(near[owner == k].max()))
            children.append(self._build(own, c))
        routes = np.array(chosen)
        self.nodes.append((routes, self._from(centre, routes), np.array(radii), children))
        return len(self.nodes) - 1

    def search(self, query: int, vector: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, -id) of `best` and this tree's vectors other than `query`: nearest node first, until none can hold more."""
        norm, asked = int(vector @ vector), vector.astype(self.exact.dtype)
        heap = list(best)
        heapq.heapify(heap)
        limit = float(self.metric.of_score(norm, heap[0][0])) + self.metric.slack if len(heap) == k else np.inf
        top = float(self.metric.of_score(norm, int(vector @ self.vectors[0])))
        queue = [(max(0.0, top - self.root_radius), 0, self.root, top)]
        pushed = 0
        while queue:
            bound, _, at, here = heapq.heappop(queue)
            if bound > limit:
                break
            rows, away, radii, children = self.nodes[at]
            reach = abs(here - away) if radii is None else abs(here - away) - radii
            near = np.flatnonzero(reach <= limit)  # the rest needs no distance of its own
            if not len(near):
                continue
            scores = self.exact[rows[near]] @ asked
            if radii is None:
                if len(near) > k:  # k + 1 vectors, as one may be the query's own, and all that score like the last
                    least = np.partition(scores, -k - 1)[-k - 1]
                    good = np.flatnonzero(scores >= (max(least, heap[0][0]) if len(heap) == k else least))
                    near, scores = near[good], scores[good]
                for i, score in zip(near.tolist(), map(int, scores.tolist())):
                    for one in self.ids[rows[i]]:
                        if one == query:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -one))
                        elif (score, -one) > heap[0]:
                            heapq.heapreplace(heap, (score, -one))
                        else:
                            break  # the ids of a vector rise
                if len(heap) == k:
                    limit = float(self.metric.of_score(norm, heap[0][0])) + self.metric.slack
                continue
            there = self.metric.of_score(norm, scores)
            lower = np.maximum(there - radii[near], bound)
            for i, low, distance in zip(near.tolist(), lower.tolist(), there.tolist()):
                if low <= limit:
                    pushed += 1
                    heapq.heappush(queue, (max(low, 0.0), pushed, children[i], distance))
        return heap


def quantised(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(`scale` * x) of each component as a double; null for a vector that is null or holds a null, NaN or infinity."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _near(rows: DataFrame, pivots: np.ndarray, metric: Metric) -> DataFrame:
    """`rows` (v, ids) with the nearest pivot and the distance to it."""
    width, lifts = pivots.shape[1], metric.lift(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = metric.matrix(batch.column("v").to_pylist(), width)
            lift, best, at = metric.lift(x), np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            for k, (p, p_lift) in enumerate(zip(pivots, lifts)):
                there = metric.between(x, lift, p, p_lift)
                closer = there < best
                best[closer], at[closer] = there[closer], k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(best)], [*batch.schema.names, "pivot", "away"])

    return rows.mapInArrow(run, "v array<bigint>, ids array<bigint>, pivot bigint, away double")


def _answers(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_inner_products(
    df: DataFrame, id_col: str, vector: str, is_query: Column, k: int = 5, scale: int = SCALE, page_rows: int = PAGE_ROWS,
    max_pivots: int = MAX_PIVOTS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the `k` largest integer inner products with rows of another id.

    Equal scores go by the smaller id. The index: equal vectors become one, with their k + 1 smallest ids, as no other can be among
    the answers; each goes to the nearest of at most `max_pivots` vectors drawn by hash, the top node's routing objects;
    a pivot's vectors are dealt over pages of about `page_rows`, and each page is an M-tree that one task builds. The search: a
    query first searches one page of its own pivot, which gives a score to beat; then all pages of each pivot whose covering radius
    lets it hold as good a score. Queries meet a page in blocks of `query_block`.

    Components may have any finite size; those beyond 64 bits once multiplied count as the largest number of 64 bits, and so do scores.

    Vectors that are null or hold a null, NaN or infinity take no part; shorter ones count as if they went on with zeros. Rows with a
    null id take no part. A query id on several rows gets the answers of each distinct vector. With fewer than k other rows all are
    returned; without any vector no row is.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), quantised(vector, scale).alias("v"), is_query.alias("ask"))
    rows = keep(rows.filter("id is not null and v is not null"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    spark = df.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    metric, width = Metric(int(most) if most < 1 << 52 else int(most * (1 + 1e-9))), max(width, 1)

    first = Window.partitionBy("v").orderBy("id")
    kept = rows.select("v", "id").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    points = keep(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    wanted = min(max_pivots, -(-points.count() * 2 // page_rows))
    pivots = metric.matrix([r.v for r in points.orderBy(F.xxhash64("v"), "v").limit(wanted).select("v").collect()], width)
    placed = keep(_near(points, pivots, metric), "placed")
    tops = {r.pivot: (r.n, r.radius) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    pages = np.array([max(1, -(-tops.get(p, (0, 0.0))[0] // page_rows)) for p in range(len(pivots))])
    radii = np.array([tops.get(p, (0, -1.0))[1] for p in range(len(pivots))])
    starts = np.cumsum(pages) - pages  # number of each pivot's first page

    table = F.array(*(F.struct(F.lit(int(s)).alias("start"), F.lit(int(n)).alias("n")) for s, n in zip(starts, pages)))
    own = F.element_at(table, (F.col("pivot") + 1).cast("int"))
    paged = placed.select("v", "ids", (own["start"] + F.pmod(F.xxhash64("v"), own["n"])).alias("page"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = Tree([list(map(int, i)) for i in group["ids"]], metric.matrix(group["v"].tolist(), width), metric)
        return pd.DataFrame({"page": [int(group["page"].iloc[0])], "tree": [pickle.dumps(tree, protocol=5)]})

    trees = keep(paged.groupBy("page").applyInPandas(build, "page bigint, tree binary"), "trees")
    asked = keep(rows.filter("ask").select("id", "v").distinct().withColumn("no", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
    lifts = metric.lift(pivots)

    def first_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = metric.matrix(batch.column("v").to_pylist(), width)
            lift = metric.lift(x)
            near = np.array([metric.between(pivots, lifts, one, own_lift).argmin() for one, own_lift in zip(x, lift)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts[near])], [*batch.schema.names, "page"])

    def other_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = metric.matrix(batch.column("v").to_pylist(), width)
            found, done = batch.column("best").to_pylist(), batch.column("page").to_pylist()
            of, page = [], []
            for i, one in enumerate(x):
                norm = int(one @ one)
                there = metric.of_score(norm, pivots @ one)
                limit = metric.of_score(norm, min(b["score"] for b in found[i])) + metric.slack if len(found[i]) == k else np.inf
                some = [q for p in np.flatnonzero((there - radii <= limit) & (radii >= 0)) for q in range(starts[p], starts[p] + pages[p]) if q != done[i]]
                of.extend([i] * len(some))
                page.extend(some)
            rest = batch.drop_columns(["page"]).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(page, pa.int64())], [*rest.schema.names, "page"])

    answer = "no bigint, query_id bigint, vec_id bigint, score bigint"

    def ask(pages_: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages_) and len(queries):
            tree = pickle.loads(pages_["tree"].iloc[0])
            known = queries["best"] if "best" in queries else [[]] * len(queries)
            for no, query, v, best in zip(queries["no"], queries["id"], metric.matrix(queries["v"].tolist(), width), known):
                start = [(int(b["score"]), -int(b["vec_id"])) for b in best]
                out.extend((no, query, -one, max(-_LONG, min(score, _LONG))) for score, one in set(tree.search(int(query), v, k, start)) - set(start))
        return pd.DataFrame(out, columns=["no", "query_id", "vec_id", "score"])

    def meet(queries: DataFrame) -> DataFrame:
        pairs = queries.select(F.col("page").alias("at"), F.col("block").alias("of")).distinct()
        met = trees.join(pairs, trees.page == pairs["at"]).select("at", "of", "tree")
        return met.groupBy("at", "of").cogroup(queries.groupBy("page", "block")).applyInPandas(ask, answer)

    kinds = "id bigint, v array<bigint>, no bigint, block bigint"
    begun = keep(asked.mapInArrow(first_page, f"{kinds}, page bigint"), "first_pages")
    near = keep(_answers(meet(begun), k), "first_answers")
    best = near.groupBy("no").agg(F.collect_list(F.struct("score", "vec_id")).alias("best"))
    told = begun.join(best, "no", "left").select(
        "id", "v", "no", "block", F.coalesce("best", F.expr("array()")).alias("best"), "page"
    )
    rest = keep(told.mapInArrow(other_pages, f"{kinds}, best array<struct<score: bigint, vec_id: bigint>>, page bigint"), "other_pages")
    every = near.select("no", "query_id", "vec_id", "score").unionByName(meet(rest))
    return _answers(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
