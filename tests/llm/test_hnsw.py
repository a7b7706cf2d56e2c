import random

import numpy as np
import pytest

from caseflow.llm import hnsw

SCHEMA = "vec_id bigint, embedding array<double>, node string, x string, component string"


def brute(rows):
    width = max((len(v) for _, v in rows if v), default=1)
    x, sound = np.zeros((len(rows), width)), []
    for k, (_, v) in enumerate(rows):
        sound.append(bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v))
        if sound[-1]:
            x[k, :len(v)] = np.array(v) / np.abs(v).max()
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(norm == 0, 1, norm)[:, None]
    linked = unit @ unit.T >= hnsw.COSINE
    linked &= np.outer(sound, sound) & ~np.eye(len(rows), dtype=bool)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[k], *(label[j] for j in np.flatnonzero(linked[k]))]) for k in range(len(rows))]
    big = [1 << 60 if i is None else i for i, _ in rows]
    least = {c: min(big[k] for k in range(len(rows)) if label[k] == c) for c in label}
    return sorted((big[k], int(linked[k].sum()), least[label[k]]) for k in range(len(rows)))


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)
    out = hnsw.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    big = lambda v: 1 << 60 if v is None else v
    return sorted((big(r.vec_id), r.n_links, big(r.component_id)) for r in out)


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_PER_SHARD", 100)
    monkeypatch.setattr(hnsw, "QUERIES_PER_BLOCK", 150)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    rows = [(n, (centers[n % 30] * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0.05, 0.4, 2.0])).tolist()) for n in range(500)]
    group = rng.normal(size=16)
    rows += [(1000 + n, (group + rng.normal(size=16) * 0.1).tolist()) for n in range(120)]  # more than a beam holds
    rows += [(2000 + n, rows[0][1]) for n in range(40)]  # exact copies
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, [2.0]),
            (8, [1e-300, 1e-310]), (9, [1e300]), (9, [1e300]), (10, [0.0, 1.0]), (11, [-1.0]), (12, [0.9, 0.435889894354067])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("size", [1, 2, 300])
def test_graph_reaches_everything(size):
    rng = np.random.default_rng(size)
    units, _ = hnsw._units(rng.normal(size=(size, 8)))
    graph = hnsw.SmallWorld(units)
    hits = graph.within(units, 0.5, 8)
    truth = units @ units.T >= 0.5
    assert sum(len(h) for h in hits) >= 0.99 * truth.sum() and all(truth[k, h].all() for k, h in enumerate(hits))


def test_a_groups_links_do_not_hide_a_vector_that_finds_none():
    rng = np.random.default_rng(7)
    group = rng.normal(size=32)
    pairs = rng.normal(size=(16, 32))
    x = np.concatenate([group + rng.normal(size=(4000, 32)) * 0.01, np.repeat(pairs, 2, axis=0) + rng.normal(size=(32, 32)) * 0.01])
    units, _ = hnsw._units(x)

    class Blind(hnsw.SmallWorld):
        """Finds all of the group, but of the pairs only the vector itself before the beam is wider."""

        def __init__(self):
            self.units = units

        def within(self, queries, least, beam):
            own = [np.flatnonzero(q @ units.T >= least) for q in queries]
            return [o if beam > hnsw.BEAM or len(o) > 2 else o[units[o] @ q > 0.99999] for o, q in zip(own, queries)]

    some = np.r_[np.arange(224), np.arange(4000, 4032)]
    hits = hnsw.audited(Blind(), units[some], 0.9, hnsw.BEAM, some, np.arange(len(x)))
    assert [len(h) for h in hits] == [4000] * 224 + [2] * 32


def mixed_group(rng, size, alone):
    """A third of the group within balls of each other, the rest linked ever more loosely."""
    group = rng.normal(size=32) + rng.normal(size=(size, 32)) * np.repeat([0.02, 0.2, 0.5], -(-size // 3))[:size, None]
    return rng.permutation(np.concatenate([group, rng.normal(size=(alone, 32))]))


def test_a_dense_group_takes_no_wider_beams(monkeypatch):
    units, _ = hnsw._units(mixed_group(np.random.default_rng(5), 600, 1400))
    graph, widths, beam = hnsw.SmallWorld(units), set(), hnsw.SmallWorld.beam

    def noted(self, queries, start, width, level=0):
        widths.add(width)
        return beam(self, queries, start, width, level)

    monkeypatch.setattr(hnsw.SmallWorld, "beam", noted)
    hits = graph.within(units, 0.9, hnsw.BEAM)
    truth = units @ units.T >= 0.9
    assert max(widths) == hnsw.BEAM
    assert sum(map(len, hits)) >= 0.999 * truth.sum() and all(truth[k, h].all() for k, h in enumerate(hits))


@pytest.mark.parametrize("cosine", [0.6, 0.9, 0.99])
def test_balls_count_as_single_comparisons_do(cosine):
    rng = np.random.default_rng(11)
    units, exact = hnsw._units(mixed_group(rng, 300, 200))
    copies = rng.integers(1, 4, len(units))
    graph = hnsw.SmallWorld(units, same=np.cos(np.arccos(cosine) / 2) + hnsw.MARGIN)
    assert (graph.leader != np.arange(len(units))).sum() > 50 and (graph.leader[graph.leader] == graph.leader).all()
    balls = hnsw.Balls(exact, graph.leader, copies, cosine)
    own = np.where(rng.random(len(units)) < 0.5, np.arange(len(units)), -1)  # the others are of another shard
    hits = [np.flatnonzero(near) for near in units @ units.T >= balls.least]
    counts, a, b = balls.links(exact, own, hits)
    linked = np.einsum("ad,bd->ab", exact, exact) >= cosine
    assert (counts == linked @ copies - np.where(own >= 0, copies, 0)).all()
    linked[own >= 0, own[own >= 0]] = False
    q, v = np.nonzero(linked)
    size, members = len(units), np.flatnonzero(graph.leader != np.arange(len(units)))
    together, expected = (hnsw._roots(2 * size, np.r_[size + x, members], np.r_[y, graph.leader[members]]) for x, y in ((a, b), (q, v)))
    assert (together == expected).all()
