"""Near duplicates of embeddings: a navigable small-world graph per shard, every vector searched in every shard."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, components, slices, stored

#: Vectors are linked from this cosine on.
COSINE = 0.9
#: Vectors per graph, and vectors searched in a graph by one task.  The number of both follows the data.
VECTORS_PER_SHARD = 16_384
QUERIES_PER_BLOCK = 8_192
#: Fewer vectors than this are not worth a graph of their own.
LEAST_PER_SHARD = 512
#: Neighbours of a node (twice as many on the lowest level), the beam when building, and the first beam when searching.
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 48, 32
#: Vectors inserted, or searched, at once.
AT_ONCE = 256
#: Every so many searched vectors one is also compared with the whole shard; the beam is doubled until so many of the links
#: that this finds were found, and some of every vector that has any.
AUDIT_EVERY, RECALL = 16, 0.995
#: A beam that would be wider than this share of a shard, as 1 / WIDEST, is no saving: the whole shard is compared.
WIDEST = 16
#: Links are looked for from this much below the threshold on, in single precision, and verified in double precision.
MARGIN = 1e-4
#: Angles in double precision are this exact, and better: what is nearer to a bound is compared singly.
ANGLE = 1e-6
#: Links of the graph followed at once from vectors that are near enough.
FOLLOWED = 1 << 13
#: They are also followed from vectors that are not near enough, but so many times as far, as 1 - cosine.
DETOUR = 1.5
#: Vectors compared singly at once.
SINGLE = 1 << 16


class SmallWorld:
    """Layers of neighbour lists over unit vectors.  Searches and insertions go in blocks of vectors.

    A vector for which building finds one of at least the similarity ``same`` becomes a member of its ball and is not linked:
    ``leader`` names the linked vector of every vector, itself if it is linked.
    """

    def __init__(self, units: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0, same: float = np.inf) -> None:
        self.units, self.entry = units, entry
        self.links = links if links is not None else []
        self.leader = np.arange(len(units))
        if links is None:
            self._build(same)
        # The lowest level's links by what they lead to: those to k come from from_[into[k]:into[k + 1]].
        node, column = np.nonzero(self.links[0] >= 0)
        to = self.links[0][node, column]
        self.from_ = node[np.argsort(to, kind="stable")]
        self.into = np.r_[0, np.cumsum(np.bincount(to, minlength=len(units)))]

    def _build(self, same: float) -> None:
        n = len(self.units)
        draws = np.random.default_rng(n).random(n)
        levels = np.minimum((-np.log(draws) / np.log(NEIGHBOURS)).astype(np.int64), 12)
        top = int(levels.max()) if n else 0
        self.links = [np.full((n, NEIGHBOURS * (2 if level == 0 else 1)), -1, np.int32) for level in range(top + 1)]
        if n:
            self.entry = int(levels.argmax())  # inserted first: every search begins at the top
        order = np.r_[self.entry, np.delete(np.arange(n), self.entry)] if n else np.arange(0)
        done = 0
        while done < n:
            some = order[done:done + max(1, min(AT_ONCE, done))]
            self._insert(some, levels[some], done > 0, same)
            done += len(some)

    def _insert(self, some: np.ndarray, levels: np.ndarray, searched: bool, same: float) -> None:
        """Link new vectors, level by level: to what a beam finds, to those before them in the block, and back."""
        among = self.units[some] @ self.units[some].T
        among[np.triu_indices(len(some))] = -np.inf
        start = np.full((len(some), 1), self.entry)
        beams = []
        for level in range(len(self.links) - 1, -1, -1):
            width = BUILD_BEAM if (levels >= level).any() else 1
            beams.append(self.beam(self.units[some], start, width, level) if searched
                         else (np.full((len(some), 1), -1), np.full((len(some), 1), -np.inf, np.float32)))
            start = np.where(beams[-1][0][:, :1] >= 0, beams[-1][0][:, :1], start)
        single = self._single(some, among, *beams[-1], same)
        for level, (found, sims) in zip(range(len(self.links) - 1, -1, -1), beams):
            here = np.flatnonzero((levels >= level) & single)
            if len(here):
                near = np.concatenate([sims[here], among[np.ix_(here, here)]], axis=1)
                ids = np.concatenate([found[here], np.broadcast_to(some[here], (len(here), len(here)))], axis=1)
                first = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
                near, ids = np.take_along_axis(near, first, axis=1), np.take_along_axis(ids, first, axis=1)
                kept = self._spread(np.where(near > -np.inf, ids, -1), near, NEIGHBOURS)
                self.links[level][some[here], :kept.shape[1]] = kept
                row, column = np.nonzero(kept >= 0)
                self._back(level, kept[row, column], some[here][row])

    def _single(self, some: np.ndarray, among: np.ndarray, found: np.ndarray, sims: np.ndarray, same: float) -> np.ndarray:
        """Which of the new vectors are to be linked; the others become members of the nearest linked vector's ball."""
        single = sims[:, 0] < same
        self.leader[some[~single]] = found[~single, 0]
        for k in np.flatnonzero(single & (among >= same).any(axis=1)):  # in their order: a leader is linked itself
            near = np.where(single, among[k], -np.inf)
            if near.max() >= same:
                single[k], self.leader[some[k]] = False, some[near.argmax()]
        return single

    def _spread(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` ids of each row (-1 for none; rows go from near to far): first those that are nearer to the row's
        vector than to any taken before, then the nearest of the others."""
        units = self.units[np.maximum(ids, 0)]
        between = units @ units.transpose(0, 2, 1)
        closest, taken, count = np.full(ids.shape, -np.inf, np.float32), np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
        for k in range(ids.shape[1]):
            taken[:, k] = (ids[:, k] >= 0) & (near[:, k] > closest[:, k]) & (count < most)
            count += taken[:, k]
            closest = np.where(taken[:, k, None], np.maximum(closest, between[:, k]), closest)
        place = np.arange(ids.shape[1]) + ids.shape[1] * np.where(taken, 0, np.where(ids >= 0, 1, 2))
        return np.take_along_axis(ids, np.argsort(place, axis=1)[:, :most], axis=1)

    def _back(self, level: int, nodes: np.ndarray, new: np.ndarray) -> None:
        """Add links from ``nodes`` to ``new``; a full list is chosen anew.  Each round adds one link per node."""
        links = self.links[level]
        while len(nodes):
            own, first = np.unique(nodes, return_index=True)
            rest = np.ones(len(nodes), bool)
            rest[first] = False
            ids = np.concatenate([links[own], new[first][:, None]], axis=1)
            near = np.einsum("rcd,rd->rc", self.units[np.maximum(ids, 0)], self.units[own])
            near[ids < 0] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")
            links[own] = self._spread(np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1), links.shape[1])
            nodes, new = nodes[rest], new[rest]

    def beam(self, queries: np.ndarray, start: np.ndarray, width: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first: the beams after no vector in one has unvisited neighbours.  -1 fills up."""
        count, links = len(queries), self.links[level]
        ids = np.full((count, width), -1, np.int64)
        sims = np.full((count, width), -np.inf, np.float32)
        spent = np.zeros((count, width), bool)
        seen = np.zeros((count, len(self.units)), bool)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("rd,rd->r", self.units[start[:, 0]], queries)
        seen[np.arange(count), start[:, 0]] = True
        while True:
            waiting = np.where(spent, -np.inf, sims)
            pick = waiting.argmax(axis=1)
            rows = np.flatnonzero(waiting[np.arange(count), pick] > -np.inf)
            if not len(rows):
                break
            spent[rows, pick[rows]] = True
            near = links[ids[rows, pick[rows]]]
            index = np.maximum(near, 0)
            new = (near >= 0) & ~seen[rows[:, None], index]
            at, column = np.nonzero(new)
            seen[rows[at], near[at, column]] = True
            own = np.einsum("rcd,rd->rc", self.units[index], queries[rows])
            all_ids = np.concatenate([ids[rows], near], axis=1)
            all_sims = np.concatenate([sims[rows], np.where(new, own, -np.inf).astype(np.float32)], axis=1)
            all_spent = np.concatenate([spent[rows], ~new], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[rows] = np.take_along_axis(all_ids, best, axis=1)
            sims[rows] = np.take_along_axis(all_sims, best, axis=1)
            spent[rows] = np.take_along_axis(all_spent, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        ids[sims == -np.inf] = -1
        return ids, sims

    def within(self, queries: np.ndarray, least: float | np.ndarray, beam: int) -> list[np.ndarray]:
        """For each query the linked vectors of at least that similarity (one for all, or each vector's own).  A beam finds the
        first of them, from which links are followed; a beam after the first that would hold a large share of all vectors is
        replaced by looking at all."""
        least = np.broadcast_to(np.asarray(least, np.float32), len(self.units))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        if beam > BEAM and beam * WIDEST >= len(self.units):
            for some in slices(range(len(queries)), AT_ONCE):
                for k, near in zip(some, queries[some] @ self.units.T):
                    out[k] = np.flatnonzero(near >= least)
            return out
        start = np.full((len(queries), 1), self.entry)
        for level in range(len(self.links) - 1, 0, -1):
            start = self.beam(queries, start, 2, level)[0][:, :1]
        for some in np.array_split(np.arange(len(queries)), -(-len(queries) * beam // (AT_ONCE * 512)) or 1):
            ids, sims = self.beam(queries[some], start[some], beam)
            near_enough = (ids >= 0) & (sims >= least[ids])
            for k, own, near in zip(some, ids, near_enough):
                out[k] = own[near]
        for some in slices([k for k in range(len(out)) if len(out[k])], AT_ONCE):
            for k, own in zip(some, self._follow(queries[some], least, [out[k] for k in some])):
                out[k] = own
        return out

    def _follow(self, queries: np.ndarray, least: np.ndarray, hits: list[np.ndarray]) -> list[np.ndarray]:
        """``hits`` and all that is reached from them, by links in both directions, over vectors that are near enough or nearly so
        (``DETOUR``); a vector is looked at once a query."""
        size, passed = len(self.units), 1 - DETOUR * (1 - least)
        seen = np.zeros(len(queries) * size, bool)
        now = np.concatenate([k * size + own for k, own in enumerate(hits)])
        seen[now] = True
        found = [now]
        while len(now):
            reached = []
            for part in slices(now, FOLLOWED):
                node = part % size
                near, into = self.links[0][node], self.into[node + 1] - self.into[node]
                back = self.from_[np.arange(into.sum()) + np.repeat(self.into[node + 1] - np.cumsum(into), into)]
                new = np.concatenate([((part - node)[:, None] + near)[near >= 0], np.repeat(part - node, into) + back])
                new = np.unique(new[~seen[new]])
                seen[new] = True
                sims = np.einsum("rd,rd->r", self.units[new % size], queries[new // size])
                found.append(new[sims >= least[new % size]])
                reached.append(new[sims >= passed[new % size]])
            now = np.concatenate(reached)
        every = np.sort(np.concatenate(found))
        return [own % size for own in np.split(every, np.searchsorted(every, np.arange(1, len(queries)) * size))]


def audited(world: SmallWorld, queries: np.ndarray, least: float | np.ndarray, beam: int, own: np.ndarray, nodes: np.ndarray,
            weights: np.ndarray | None = None) -> list[np.ndarray]:
    """What ``within`` finds for a block of vectors, with beams as wide as the audit of some of them asks for.

    ``own`` and ``nodes`` name the queries and the shard's vectors: that a vector finds itself is no link and counts for nothing.
    A found vector counts as its weight, the vectors in its ball.  A group's many links cannot make up for a vector outside it
    that has links and found none.
    """
    weights = np.ones(len(nodes), np.int64) if weights is None else weights
    some = np.arange(0, len(queries), AUDIT_EVERY)
    truth = [t[nodes[t] != own[k]] for k, t in zip(some, (np.flatnonzero(t >= least) for t in queries[some] @ world.units.T))]
    hits, wide = world.within(queries, least, beam), beam
    while wide == beam or wide * WIDEST < 2 * len(world.units):
        found = [weights[np.intersect1d(hits[k], t)].sum() for k, t in zip(some, truth)]
        blind = any(len(t) and not f for f, t in zip(found, truth))
        if not blind and sum(found) >= RECALL * sum(weights[t].sum() for t in truth):
            break
        # Links that were found in part are looked for with wider beams; all are if some vector's were not found at all.
        wide *= 2
        todo = [k for k in range(len(hits)) if blind or (nodes[hits[k]] != own[k]).any()]
        for k, own_hits in zip(todo, world.within(queries[todo], least, wide)):
            hits[k] = np.union1d(hits[k], own_hits)
    return hits


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        out[row, :len(vector)] = vector
    return out


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in single precision, unit vectors in double precision); scaled first, so that nothing overflows."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    exact = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return exact.astype(np.float32), exact


def _roots(size: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each is connected to by the pairs and, if given, by the roots found so far."""
    roots = np.arange(size) if roots is None else roots
    while True:
        new = roots.copy()
        np.minimum.at(new, a, roots[b])
        np.minimum.at(new, b, roots[a])
        np.minimum.at(new, roots, new.copy())
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


class Balls:
    """The vectors of a graph by the linked vector whose ball they are in, from near to far by their angle to it."""

    def __init__(self, exact: np.ndarray, leader: np.ndarray, copies: np.ndarray, cosine: float) -> None:
        self.exact, self.leader, self.copies, self.cosine = exact, leader, copies, cosine
        self.reach = np.arccos(np.clip(cosine, -1, 1))
        angle = _angles(exact, exact[leader])
        angle[leader == np.arange(len(leader))] = 0
        self.order = np.lexsort((angle, leader))
        self.place = np.argsort(self.order)
        # Angles are below 4: all of a ball are below those of the next one.
        self.key = 4.0 * leader[self.order] + angle[self.order]
        self.sum = np.r_[0, np.cumsum(copies[self.order])]
        self.weights = np.bincount(leader, minlength=len(leader))
        radius = np.zeros(len(leader))
        np.maximum.at(radius, leader, angle)
        self.least = np.where(self.weights > 0, np.cos(np.minimum(self.reach + radius, np.pi)) - MARGIN, np.inf)

    def _before(self, ball: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """The place after the vectors of each ball that are at most so far from its leader."""
        return np.searchsorted(self.key, 4.0 * ball + np.clip(angle, -0.1, 3.5), side="right")

    def links(self, queries: np.ndarray, own: np.ndarray, hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(copies linked to each query, pairs of queries and vectors that connect all that is linked) in the balls of ``hits``.

        ``own`` is the place of a query among the vectors or -1; it is not linked with itself.  By the triangle inequality of
        angles a query is linked with what is near to the middle of a ball and with nothing that is far from it; what is
        between is compared singly, in double precision.
        """
        a, ball = np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.concatenate(hits)
        away = _angles(queries[a], self.exact[ball])
        begin, inner = self._before(ball, np.full(len(ball), -0.1)), self._before(ball, self.reach - away - ANGLE)
        outer = self._before(ball, away + self.reach + ANGLE)
        inside = (own[a] >= 0) & (begin <= self.place[own[a]]) & (self.place[own[a]] < inner)
        counts = np.zeros(len(queries), np.int64)
        np.add.at(counts, a, self.sum[inner] - self.sum[begin] - np.where(inside, self.copies[own[a]], 0))
        others = inner - begin > inside
        pairs = [(a[others], ball[others])]
        first = np.maximum(inner, self._before(ball, away - self.reach - ANGLE))
        single = np.flatnonzero(outer > first)
        for some in slices(single, SINGLE):
            length = (outer - first)[some]
            ends = np.cumsum(length)
            for k in slices(np.arange(ends[-1]), SINGLE):
                pair = np.searchsorted(ends, k, side="right")
                b = self.order[outer[some][pair] - (ends[pair] - k)]
                q = a[some][pair]
                linked = (np.einsum("rd,rd->r", queries[q], self.exact[b]) >= self.cosine) & (own[q] != b)
                np.add.at(counts, q[linked], self.copies[b[linked]])
                pairs.append((q[linked], b[linked]))
        return counts, *(np.concatenate(x) for x in zip(*pairs))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.einsum("rd,rd->r", a, b), -1, 1))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors of at least that cosine are linked.

    ``n_links`` counts the other rows found to be linked directly, ``component_id`` is the smallest id reachable by links.
    Links are verified in double precision, so none is below the threshold; how many are missed is audited in every search
    against brute force, and beams are widened until at least ``RECALL`` are found and no audited vector with links found
    none.  Equal vectors are searched once and count as often as they occur.  Of vectors within half the angle of ``cosine`` of
    one another a shard's graph holds one, the others are its ball, whose links are counted by angles: each vector of a dense
    group costs one search a shard, however many links it has.  Vectors that are null, zero or empty, or hold a null or an infinite or undefined component,
    are linked with nothing; shorter vectors count as if zeros followed; rows with equal ids are each counted, and a
    component of null ids has a null id; an empty table gives an empty result; other columns are ignored.

    Searching every shard costs a number of searches in proportion to vectors times shards.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    sound = F.coalesce(F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
                       & F.exists("x", lambda x: x != 0), F.lit(False))
    groups = stored(rows.filter(sound).groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
                    .withColumn("node", F.monotonically_increasing_id()), "vectors")
    shape = groups.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    width, cores = shape["width"] or 0, spark.sparkContext.defaultParallelism
    same = np.cos(np.arccos(np.clip(cosine, -1, 1)) / 2) + MARGIN  # so near to a leader, vectors are linked with one another
    shards = max(buckets_for(shape["n"], VECTORS_PER_SHARD), min(cores, shape["n"] // LEAST_PER_SHARD), 1)
    blocks = max(buckets_for(shape["n"], QUERIES_PER_BLOCK), 1)

    def build(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("node")
        x = _matrix(some["x"], width)
        graph = SmallWorld(_units(x)[0], same=same)
        file = io.BytesIO()
        np.savez(file, node=some["node"].to_numpy(), copies=some["copies"].to_numpy(), x=x, entry=graph.entry, leader=graph.leader,
                 **{f"links{k}": links for k, links in enumerate(graph.links)})
        return pd.DataFrame({"shard": [key[0]], "graph": [file.getvalue()]})

    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)).cast("int"))
    graphs = stored(dealt.groupBy("shard").applyInPandas(build, "shard int, graph binary"), "graphs")

    def search(key: tuple, graph: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(some):
            return pd.DataFrame({"node": [], "n": [], "other": []}).astype({"node": "int64", "n": "int64", "other": "int64"})
        loaded = np.load(io.BytesIO(graph["graph"].iloc[0]))
        nodes, copies = loaded["node"], loaded["copies"]
        units, exact = _units(loaded["x"])
        world = SmallWorld(units, [loaded[f"links{k}"] for k in range(len(loaded.files) - 5)], int(loaded["entry"]))
        balls = Balls(exact, loaded["leader"], copies, cosine)
        own = some["node"].to_numpy()
        queries, precise = _units(_matrix(some["x"], width))
        all_nodes, place = np.unique(np.concatenate([nodes, own]), return_inverse=True)
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        at = np.where(nodes[at] == own, at, -1)
        counts, roots = np.zeros(len(own), np.int64), np.arange(len(all_nodes))
        for block in slices(np.arange(len(own)), AT_ONCE):
            hits = audited(world, queries[block], balls.least, BEAM, own[block], nodes, balls.weights)
            # A vector's own ball is known; the ball's vectors are connected by their links to its leader.
            hits = [np.union1d(h, balls.leader[k]) if k >= 0 else h for h, k in zip(hits, at[block])]
            counts[block], a, b = balls.links(precise[block], at[block], hits)
            roots = _roots(len(all_nodes), place[len(nodes) + block[a]], place[b], roots)
        counted = pd.DataFrame({"node": own, "n": counts, "other": own})
        joined = np.flatnonzero(roots != np.arange(len(roots)))
        return pd.concat([counted[counts > 0], pd.DataFrame({"node": all_nodes[joined], "n": 0, "other": all_nodes[roots[joined]]})])

    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = groups.select("node", "x", every.alias("shard"), F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
    sent = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = stored(sent.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        search, "node bigint, n bigint, other bigint"), "links")
    edges = found.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    joined = stored(components(edges), "components")
    counts = found.filter("node = other").groupBy("node").agg(F.sum("n").alias("n"))
    named = groups.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").join(counts, "node", "left").select(
        F.col("x").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.filter(sound).join(classes, F.col("x") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
