import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseflow.llm import packing
from caseflow.llm.queries import BYTE_BPE
from caseflow.llm.tokens import TextTokenizer

from .rows import TEXTS, edge_docs, no_docs


def test_ids_are_the_librarys():
    rng = random.Random(1)
    atoms = ["a", "Bc", " ", "  ", "\n", "\t", "é", "12", "'s", ".", "<|endoftext|>", "日本", "　", "\x85", "\x1c", "𝒳", "don't", "a" * 60]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    of = TextTokenizer(BYTE_BPE)
    assert of.fast is not None and of.ids(texts) == of.encode(texts) == of.ids(texts)


def test_each_placement_is_least():
    rng = random.Random(2)
    for _ in range(30):
        capacity = 12
        sizes = np.array([rng.randint(1, capacity) for _ in range(40)])
        bins = packing.place(sizes, capacity)
        fill = defaultdict(int)

        def squares(fill):
            gaps = np.bincount([capacity - f for f in fill.values()], minlength=capacity + 1)
            return int((gaps[1:capacity] ** 2).sum())

        for size, chosen in zip(sizes.tolist(), bins.tolist()):
            options = [b for b in fill if fill[b] + size <= capacity] + [len(fill)]
            best = min(squares({**fill, b: fill[b] + size if b in fill else size}) for b in options)
            fill[chosen] += size
            assert fill[chosen] <= capacity and squares(fill) == best


@pytest.mark.parametrize("count", [0, 1, 2, 700])
def test_bins_are_gapless_and_few(count):
    rng = random.Random(count)
    sizes = np.array([rng.randint(1, 2048) for _ in range(count)], np.int64)
    bins, offsets = packing.packed(sizes, 2048)
    for number in set(bins.tolist()):
        own = sorted(zip(offsets[bins == number].tolist(), sizes[bins == number].tolist()))
        assert [o for o, _ in own] == np.r_[0, np.cumsum([s for _, s in own])][:-1].tolist() and sum(s for _, s in own) <= 2048
    if count > 100:
        assert bins.max() + 1 <= 1.1 * sizes.sum() / 2048


def test_whole_documents(spark):
    rows = packing.pack(edge_docs(spark), BYTE_BPE).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    expected = []
    for doc, text, *_ in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start, end = 0, (len(ids) - 1) % 2048 + 1
        for piece in range(-(-len(ids) // 2048)):
            part = np.array(ids[start:end], "<u4").tobytes()
            expected.append((str(doc), piece, start, end - start, zlib.crc32(part)))
            start, end = end, end + 2048
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(no_docs(spark), BYTE_BPE).count() == 0
