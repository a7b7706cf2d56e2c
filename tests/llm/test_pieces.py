import random

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as formats

from caseflow.llm import pieces
from caseflow.llm.queries import PIECE_BPE

from .rows import TEXTS, edge_docs, no_docs

ATOMS = ["a", "Bc", " ", "  ", "\n", "\t", "é", "12", "▁", ".", "<s>", "日本", "　", "\x85", "𝒳", "don't", "ﬁ", "①", "\x00", "ｶﾞ", "é", "​"]


def texts(count):
    rng = random.Random(7)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def library_spans(library, text):
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def compare(of, library):
    for text in texts(3000):
        ids, begins, ends = of.encode(text)
        assert ids == library.encode(text) and of.decode(ids) == library.decode(ids)
        assert all(0 <= b <= e <= len(text.encode()) for b, e in zip(begins.tolist(), ends.tolist()))
        assert begins[1:].tolist() == ends[:-1].tolist()  # pieces lie side by side


def test_ids_equal_the_library():
    compare(pieces.OffsetEncoder(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE))


def test_spans_equal_the_library():
    of, library = pieces.OffsetEncoder(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for text in texts(500):
        assert [*zip(*(x.tolist() for x in of.encode(text)[1:]))] == library_spans(library, text)


def with_rules(name, trim):
    model = formats.ModelProto()
    with open(PIECE_BPE, "rb") as file:
        model.ParseFromString(file.read())
    rules = sentencepiece.SentencePieceNormalizer(rule_name=name)
    spec = formats.ModelProto.FromString(rules.serialized_model_proto()).normalizer_spec
    model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.name = spec.precompiled_charsmap, name
    model.normalizer_spec.remove_extra_whitespaces = trim
    return model.SerializeToString()


def test_compiled_character_maps():
    for name in ("nmt_nfkc", "nfkc_cf"):
        for trim in (True, False):
            proto = with_rules(name, trim)
            of, library = pieces.OffsetEncoder(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
            for text in texts(800):
                assert of.encode(text)[0] == library.encode(text), (name, trim, text)
    of = pieces.OffsetEncoder(proto=with_rules("nmt_nfkc", True))
    normal, align = of.normalised("ﬁ①".encode())
    assert normal.decode() == "▁fi1" and align.tolist() == [0, 0, 0, 0, 0, 3, 6]


def test_whole_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rows = pieces.encode(edge_docs(spark), PIECE_BPE).collect()
    expected = [(str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in TEXTS]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted(expected)
    by_id = {i: t for i, t, *_ in TEXTS}
    for r in rows:
        assert sum(e - b for b, e in zip(r.begins, r.ends)) == len((by_id[r.doc_id] or "").encode())
    assert pieces.encode(no_docs(spark), PIECE_BPE).count() == 0
