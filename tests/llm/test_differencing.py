import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseflow.llm import differencing
from caseflow.llm.queries import BYTE_BPE, QUERIES

from .rows import TEXTS, edge_docs, no_docs


def sums(sizes, windows):
    return np.bincount(differencing.difference(np.array(sizes), windows), sizes, windows).astype(int).tolist()


def two_way(sizes):
    """The difference that the classical two-way form leaves."""
    while len(sizes) > 1:
        *sizes, b, a = sorted(sizes)
        sizes = [*sizes, a - b]
    return sizes[0]


def test_two_windows_differ_as_by_the_classical_form():
    rng = random.Random(1)
    assert sorted(sums([8, 7, 6, 5, 4], 2)) == [14, 16]
    for _ in range(200):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 20))]
        a, b = sums(sizes, 2)
        assert abs(a - b) == two_way(sizes) and a + b == sum(sizes)


def test_windows_are_nearly_equal():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(7)]
        best = min(max(np.bincount(of, sizes, 3)) for of in itertools.product(range(3), repeat=7))
        assert max(sums(sizes, 3)) <= 4 / 3 * best
    sizes = [min(2047, 1 + int(rng.lognormvariate(5.5, 1))) for _ in range(2000)]
    found = sums(sizes, sum(sizes) // 2048)
    assert sum(found) == sum(sizes) and max(found) - min(found) < 400 and np.std(found) < 20


@pytest.mark.parametrize("count", [0, 1, 2, 3, 50, 1500])
def test_every_id_is_placed_once_and_nothing_is_padded(count):
    rng = random.Random(count)
    sizes = np.array([rng.randint(1, 2047) for _ in range(count)], np.int64)
    found = differencing.levelled(sizes, 2048)
    pieces = defaultdict(list)
    for own in found:
        total = sum(n for _, _, n in own)
        assert 0 < total <= 2048 and total & total - 1 == 0 and all(n > 0 for _, _, n in own)
        for k, start, n in own:
            pieces[k].append((start, start + n))
    for k, size in enumerate(sizes.tolist()):
        own = sorted(pieces[k])
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in itertools.pairwise(own))
    assert len(found) <= sizes.sum() // 2048 + 11
    assert sum(map(len, found)) <= len(sizes) + 2 * len(found)


def test_whole_documents(spark, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_differencing_packing"](spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    left = defaultdict(int)  # how often each id of a document must be held
    ids = {}
    for doc, text, *_ in TEXTS:
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert ids.setdefault(doc, own) == own
        left[doc] += 1
    held = defaultdict(lambda: defaultdict(int))
    filled = defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
        for k in range(r.start, r.start + r.length):
            held[r.doc_id][k] += 1
        filled[r.sequence_id].append((r.offset, r.length))
    assert all(set(held[d].values()) == {n} and len(held[d]) == len(ids[d]) for d, n in left.items())
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048 and at & at - 1 == 0
    again = differencing.pack(edge_docs(spark), BYTE_BPE).collect()
    assert all(len(r.ids) == 4 * r.length for r in again) and sum(r.length for r in again) == sum(r.length for r in rows)
    assert differencing.pack(no_docs(spark), BYTE_BPE).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        differencing.pack(no_docs(spark), BYTE_BPE, length=1000)
