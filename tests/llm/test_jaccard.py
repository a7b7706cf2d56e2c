import random
from collections import Counter

import pytest

from caseflow.llm import jaccard

from .rows import TEXTS, edge_docs, no_docs


def shingle_sets(texts, words):
    out = []
    for text in texts:
        found = (text or "").encode().lower().split()
        size = min(words, len(found))
        out.append(frozenset(tuple(found[k:k + size]) for k in range(len(found) - size + 1)) if found else frozenset())
    return out


def brute(rows, words, percent):
    """(id, set size, component id) of every row, nulls as a large number."""
    ids = [1 << 60 if i is None else i for i, _ in rows]
    sets = shingle_sets([t for _, t in rows], words)
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), 1 << 62), ids[k])
    return Counter((ids[k], len(sets[k]), least[root(k)]) for k in range(len(rows)))


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = [f"p{n}" for n in range(60)]
    rows = []
    for size in (3, 5, 9, 14, 22, 40, 90, 250):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            rows.append(list(base))
            for _ in range(rng.choice([1, 3, 12])):  # near copies, each with its own edits; chains of them too
                copy = list(rng.choice(rows[-3:]) if rng.random() < 0.3 else base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                rows.append(copy)
    rows += [passage + [rng.choice(vocabulary) for _ in range(rng.randint(2, 60))] for _ in range(60)]
    return [(n, " ".join(w.upper() if rng.random() < 0.1 else w for w in r)) for n, r in enumerate(rows)]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, words, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = jaccard.similar(df, words=words, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, words, percent)
    assert sum(r.first for r in found) == len({r.component_id for r in found})


@pytest.mark.parametrize("limit", [0, 5, 40])
def test_every_boundary_finds_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "boundary", lambda *_: limit)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.similar(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 4, 85)


def test_a_group_of_copies_is_not_paired(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{n}" for n in range(150)]
    rows = [(0, " ".join(base))]
    for n in range(1, 400):  # two edits each: linked with the text they were made from, not with each other
        copy = list(base)
        for at in rng.sample(range(5, 145, 10), 2):
            copy[at] = f"e{n}_{at}"
        rows.append((n, " ".join(copy)))
    compared, linked = [], jaccard._linked

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(jaccard, "_linked", counted)
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, 4, 85)
    assert {r.component_id for r in found} == {0} and sum(compared) <= 2 * jaccard.PROPOSALS * len(rows)


def test_awkward_rows(spark):
    big = lambda v: 1 << 60 if v is None else v
    found = jaccard.similar(edge_docs(spark)).collect()
    assert Counter((big(r.doc_id), r.n_shingles, big(r.component_id)) for r in found) == brute([(i, t) for i, t, *_ in TEXTS], 4, 85)
    kept = jaccard.first_copies(edge_docs(spark), words=5, percent=80)
    assert kept.columns == edge_docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in (1, 3, 4, 5, None, 6, 8, 9, 10))
    assert jaccard.similar(no_docs(spark)).count() == 0 and jaccard.first_copies(no_docs(spark)).count() == 0
