import numpy as np
import pytest

from caseflow.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, query_id string, rank string, score string, id string"


def brute(rows, every, k):
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in sound:
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in sound if j != i)[:k]
            out |= {(i, n + 1, j, max(min(-s, (1 << 63) - 1), -(1 << 63))) for n, (s, j) in enumerate(scored)}
    return sorted(out)


def found(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, every, k).collect())


@pytest.mark.parametrize("spread", [0.004, 1.0])
def test_equals_brute_force_with_ties(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "LEAST_PER_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 30)
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=6) * spread).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + n, rows[3][1]) for n in range(50)]
    assert found(spark, rows) == brute(rows, 5, 5)


def test_search_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m, d = rng.integers(1, 300), rng.integers(1, 40), rng.integers(1, 5)
        points, queries = rng.integers(-4, 5, (n, d)).astype(float), rng.integers(-4, 5, (m, d)).astype(float)
        ids, query_ids = rng.permutation(900)[:n], rng.permutation(900)[:m]
        scores, best = topk.search(queries, query_ids, points, ids, 5)
        for row in range(m):
            wanted = sorted((-float(queries[row] @ p), int(j)) for p, j in zip(points, ids) if j != query_ids[row])[:5]
            assert [(-s, int(j)) for s, j in zip(scores[row], best[row]) if s > -np.inf] == wanted


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [nan, 1.0]), (15, [1.0, None]), (20, []), (None, [1.0, 1.0]), (25, [3.0]), (1, [1.0, 2.0, 3.0]),
            (2, [float("-inf")]), (3, [0.0, 0.0]), (-5, [-1.0, 0.5]), (30, [1e12, -1e12]), (31, [1e12, 1e12])]
    assert found(spark, rows) == brute(rows, 5, 5)
    assert found(spark, rows + rows[:1]) == brute(rows + rows[:1], 5, 5)  # candidates twice, answered once
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []
