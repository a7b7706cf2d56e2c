"""Exact top-k by inner product: dual-tree search over cover trees of queries and candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for

#: Components are floor(SCALE * x).
SCALE = 256
#: Candidates, and queries, whose trees one task holds.  The number of blocks follows the data.
CANDIDATES_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 4_096
#: Fewer candidates than this are not worth a block of their own.
LEAST_PER_BLOCK = 1_024
#: A tree is not divided below so many points; pairs of leaves are compared as two matrices.
LEAF = 48
FANOUT = 12
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


class CoverTree:
    """A simplified cover tree: the children of a node are a net of its points, taken farthest first.

    The net ends at half the node's radius, or at FANOUT centres where the points have too many dimensions to be covered
    by fewer; each point belongs to its nearest centre.  A node's radius is the distance of its farthest point from its
    centre, which is one of its points.  Points are kept in one permutation, so that a node is a range of it.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(0, len(points))
        self.points = points[self.order]
        self.centers = points[self.center]
        self.norms = np.sqrt((self.centers * self.centers).sum(axis=1))

    def _node(self, begin: int, end: int, center: int, distances: np.ndarray) -> int:
        self.center.append(center)
        self.radius.append(float(distances.max()) * (1 + 1e-12))
        self.range.append((begin, end))
        self.children.append([])
        return len(self.center) - 1

    def _grow(self, begin: int, end: int) -> None:
        """Divide nodes until they are leaves; equal points are one leaf of any size."""
        first = int(self.order[begin])
        todo = [(self._node(begin, end, first, self._far(first, self.order[begin:end])), begin, end)]
        while todo:
            node, begin, end = todo.pop()
            if end - begin <= LEAF or self.radius[node] == 0:
                continue
            some = self.order[begin:end].copy()
            centers, nearest = [self.center[node]], np.zeros(len(some), np.int64)
            distances = self._far(centers[0], some)
            while distances.max() > self.radius[node] / 2 and len(centers) < FANOUT:
                centers.append(int(some[distances.argmax()]))
                apart = self._far(centers[-1], some)
                nearest[apart < distances] = len(centers) - 1
                distances = np.minimum(apart, distances)
            at = begin
            for k, center in enumerate(centers):
                own = nearest == k
                size = int(own.sum())
                self.order[at:at + size] = some[own]
                child = self._node(at, at + size, center, distances[own])
                self.children[node].append(child)
                todo.append((child, at, at + size))
                at += size

    def _far(self, center: int, some: np.ndarray) -> np.ndarray:
        apart = self.points[some] - self.points[center]
        return np.sqrt((apart * apart).sum(axis=1))


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each queries x k: the best points by inner product, of equals the smaller id; -inf and -1 fill up.

    A pair of nodes is dropped if its bound, q . p + |q| r_p + |p| r_q + r_q r_p for the centres q, p and radii r, is
    below the worst k-th score of the queries under the query node.  Ties are kept, so the result is exact.  A query is no
    candidate of itself (equal ids).
    """
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), -1, np.int64)
    if not len(queries) or not len(points):
        return best, best_id
    a, b = CoverTree(queries), CoverTree(points)
    a_ids, b_ids = query_ids[a.order], ids[b.order]
    kth = np.full(len(queries), -np.inf)  # in the order of a

    def bound(x: int, others: list[int]) -> np.ndarray:
        high = (b.centers[others] @ a.centers[x] + a.norms[x] * np.asarray([b.radius[y] for y in others])
                + b.norms[others] * a.radius[x] + a.radius[x] * np.asarray([b.radius[y] for y in others]))
        return high + 1e-9 * (np.abs(high) + 1)

    def compare(x: int, y: int) -> None:
        begin, end = a.range[x]
        first, last = b.range[y]
        scores = a.points[begin:end] @ b.points[first:last].T
        scores[a_ids[begin:end, None] == b_ids[None, first:last]] = -np.inf
        for row in np.flatnonzero(scores.max(axis=1) >= kth[begin:end]):
            own = scores[row]
            some = np.flatnonzero((own >= kth[begin + row]) & (own > -np.inf))
            all_scores = np.concatenate([best[begin + row], own[some]])
            all_ids = np.concatenate([best_id[begin + row], b_ids[first + some]])
            kept = np.lexsort((all_ids, -all_scores))[:k]
            best[begin + row], best_id[begin + row] = all_scores[kept], all_ids[kept]
            kth[begin + row] = best[begin + row, -1]

    # Depth first; of a query node's pairs those with the largest bounds come first, so that scores rise early.
    todo = [(0, 0, np.inf)]
    while todo:
        x, y, high = todo.pop()
        begin, end = a.range[x]
        if high < kth[begin:end].min():
            continue
        if not a.children[x] and not b.children[y]:
            compare(x, y)
        elif b.children[y] and (not a.children[x] or b.radius[y] >= a.radius[x]):
            others = b.children[y]
            highs = bound(x, others)
            todo += [(x, others[j], float(highs[j])) for j in np.argsort(highs)]
        else:
            todo += [(child, y, float(bound(child, [y])[0])) for child in a.children[x]]
    back = np.empty(len(queries), np.int64)
    back[a.order] = np.arange(len(queries))
    return best[back], best_id[back]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        out[row, :len(vector)] = vector
    return out


def _exact(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """As ``search``, with Python's integers: for components whose products doubles cannot add up exactly."""
    whole = [[int(v) for v in p] for p in points.tolist()]
    scores, found = [], np.full((len(queries), k), -1, np.int64)
    for row, query in enumerate(queries.tolist()):
        query = [int(v) for v in query]
        top = sorted((-sum(x * y for x, y in zip(query, p)), i) for p, i in zip(whole, ids.tolist()) if i != query_ids[row])[:k]
        scores.append([-s for s, _ in top] + [None] * (k - len(top)))
        found[row, :len(top)] = [i for _, i in top]
    return scores, found


def top_k(vectors: DataFrame, every: int, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each row whose id is divisible by ``every``.

    Components are floor(scale * x), the score is their inner product, and of equal scores the smaller id comes first.
    Rows whose vector or id is null, or whose vector holds a null or an infinite or undefined component, take no part;
    vectors of different lengths are compared as if zeros followed the shorter one; rows with equal ids are each a
    candidate, but not for each other, and equal query rows are answered once; scores beyond 64 bits are cut to the largest ones; an empty table gives
    an empty result; other columns are ignored.

    Queries and candidates are dealt to blocks by hash, each pair of blocks is searched by one task, and only its k best
    per query are shuffled.
    """
    parts = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), parts.alias("x")).filter(
        F.col("id").isNotNull() & F.col(vector).isNotNull() & whole)
    query = F.pmod("id", F.lit(every)) == 0
    shape = rows.agg(F.count("*").alias("n"), F.count_if(query).alias("q"), F.max(F.size("x")).alias("width")).first()
    width = shape["width"] or 0
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(buckets_for(shape["n"], CANDIDATES_PER_BLOCK), min(cores, shape["n"] // LEAST_PER_BLOCK), 1)
    query_blocks = buckets_for(shape["q"], QUERIES_PER_BLOCK)

    def block(of: int, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of)).cast("int")

    def every_block(of: int):
        return F.explode(F.array(*[F.lit(x) for x in range(of)]) if of <= 64 else F.sequence(F.lit(0), F.lit(of - 1)))

    candidates = rows.select("id", "x", block(blocks, 1).alias("c"), every_block(query_blocks).alias("q"))
    queries = rows.filter(query).distinct().select("id", "x", F.xxhash64("x").alias("h"), every_block(blocks).alias("c"), block(query_blocks, 2).alias("q"))

    def find(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        a, b = _matrix(mine["x"], width), _matrix(others["x"], width)
        a_ids, b_ids = mine["id"].to_numpy(), others["id"].to_numpy()
        far = max((float(np.abs(m).max()) for m in (a, b) if m.size), default=0.0)
        of = search if far * far * max(1, width) < EXACT else _exact
        scores, ids = of(a, a_ids, b, b_ids, k)
        low, high = -(1 << 63), (1 << 63) - 1
        return pd.DataFrame([(q, h, i, min(max(int(s), low), high)) for q, h, own, some in zip(a_ids.tolist(), mine["h"], scores, ids.tolist())
                             for s, i in zip(own, some) if s is not None and s > -np.inf],
                            columns=["query_id", "h", "vec_id", "score"])

    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(
        find, "query_id bigint, h bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
