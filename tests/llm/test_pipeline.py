"""The registered queries and the pipeline, on small tables."""

import importlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from caseflow.llm import jaccard, packing, secrets
from caseflow.llm.oracles import ORACLES
from caseflow.llm.queries import BYTE_BPE, QUERIES

from .rows import edge_docs, no_docs
from .test_jaccard import brute

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id piece start length ids_crc32 sequence_id offset", 2: "doc_id size text_crc32 law shard slot grown_shard",
    3: "doc_id n_assign n_access n_hex base_sha256 spans", 4: "vec_id n_links component_id kept", 5: "doc_id n_tokens ids_sha256 decoded_sha256",
    6: "query_id rank vec_id score", 7: "doc_id held_out score predicted", 8: "doc_id n_shingles component_id", 9: "page_id url text n_chars", 10: "conv_id turn role",
    11: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    12: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 13: "word form root n n_near form_n",
}


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    importlib.reload(entry)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(df.columns)
    assert df.count() > 0


def test_stages_work_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near copies", "secret scans", "packing"]
    for name, stage in list(stages.items())[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    # What is left holds no near copies, and only live values are gone.
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(n == 1 and i == c for (i, _, c), n in brute(rows, corpus_pipeline.WORDS, corpus_pipeline.PERCENT).items())
    packed = stages["packing"](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect())


def test_stages_take_awkward_and_no_rows(spark):
    for docs, some in ((edge_docs(spark), True), (no_docs(spark), False)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns and (after.count() > 0) == some
        assert (packing.pack(secrets.mask(jaccard.first_copies(docs)), BYTE_BPE).count() > 0) == some
