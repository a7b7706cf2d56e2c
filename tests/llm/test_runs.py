import hashlib
import random
import zlib

import numpy as np
import pytest

from caseflow.llm import runs
from caseflow.llm.queries import QUERIES

from .rows import TEXTS, edge_docs, no_docs


def by_brute_force(words, least=12):
    """Every period, every maximal stretch; the smallest period of a stretch counts."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def some_documents(rng):
    for _ in range(rng.randint(0, 6)):
        letters = rng.choice([1, 2, 3, 10])
        words = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 2, 5, 12, 30, 120, 400]))]
        if len(words) > 20 and rng.random() < 0.5:
            at, p = rng.randrange(len(words)), rng.randint(1, 40)
            words = words[:at] + (words[at:at + p] * len(words))[:len(words) - at]
        yield words


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    documents, least = list(some_documents(rng)), rng.choice([2, 12])
    for words, found in zip(documents, runs.find_runs(documents, least)):
        assert [tuple(r) for r in found.tolist()] == by_brute_force(words, least)


def test_grids_in_slices_find_the_same(monkeypatch):
    words = [0, 1] * 300 + [2] * 150 + list(range(3, 40)) * 3
    whole = runs.find_runs([words, words])
    monkeypatch.setattr(runs, "PAIRS_AT_ONCE", 40)
    assert all((a == b).all() for a, b in zip(whole, runs.find_runs([words, words])))
    assert [tuple(r) for r in whole[1].tolist()] == by_brute_force(words)


def test_extensions_equal_word_by_word():
    rng = random.Random(7)
    x = [rng.randrange(2) for _ in range(700)] + [0] * 200 + [rng.randrange(2) for _ in range(50)] * 5 + [-1]
    pairs = [sorted(rng.sample(range(len(x)), 2)) for _ in range(3000)]
    found = runs.Extensions(np.array(x)).of(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for (i, j), n in zip(pairs, found.tolist()):
        assert x[i:i + n] == x[j:j + n] and x[i + n] != x[j + n]
    assert sorted({(b - a) % runs.MODULUS for a in runs.COVER for b in runs.COVER}) == list(range(runs.MODULUS)) and runs.SHIFT.min() == 0


def changed(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc, text):
    words = changed(doc, text)
    found = by_brute_force(words)
    drop = {k for s, n, p in found for k in range(s + p, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def result(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, " \n"[k % 2].join(rng.choice(["the", "The", "é", "x,y", "𝒳"]) for _ in range(rng.randint(0, 90)))) for k in range(300)]
    rows += [(1000, "a b c d e f " * 40), (1001, "line one\nline one\n" * 6)]
    found = result(spark, tmp_path, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found == sorted((expected(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 20


def test_awkward_rows(spark, tmp_path):
    found = {r[0]: r for r in result(spark, tmp_path, edge_docs(spark))}
    assert len(found) == len({d for d, *_ in TEXTS})
    for doc, text, *_ in TEXTS:
        if text is None or len(text) < 1000:
            assert found[doc] == expected(doc, text)
    plain = {r.doc_id: r for r in runs.periodic_runs(edge_docs(spark)).collect()}
    assert plain[6].runs == plain[7].runs == [(0, 80_000, 4)]
    assert plain[6].collapsed == "alpha beta gamma delta" and plain[7].collapsed == "alpha beta gamma delta omega"
    assert plain[3].collapsed == plain[5].collapsed == "" and plain[3].runs == []
    assert runs.periodic_runs(no_docs(spark)).count() == 0
