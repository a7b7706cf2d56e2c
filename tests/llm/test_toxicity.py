import zlib

import numpy as np

from caseflow.llm import toxicity
from caseflow.llm.common import table

from .rows import TEXTS, edge_docs, no_docs


def test_held_out_documents_are_told_apart(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    known = labels.withColumn("out", toxicity.held_out()).filter("out").select("doc_id", "toxic")
    rows = toxicity.score(docs, labels).join(known, "doc_id").select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    area = (rank[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (toxic == 0).sum()
    assert area > 0.98 and np.mean([r.predicted == r.toxic for r in rows]) > 0.96


def test_an_ftrl_step_follows_the_definition():
    model = toxicity.Ftrl(8, -0.3)
    rng = np.random.default_rng(1)
    z, n = np.zeros(8), np.zeros(8)
    for _ in range(200):
        at, y = rng.permutation(8)[:3].astype(np.uint32), int(rng.integers(2))
        w = np.array([0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / (
            (toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2) for i in range(8)])
        g = 1 / (1 + np.exp(0.3 - w[at].sum())) - y
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
            n[i] += g * g
        model.learn(at, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_folds_and_awkward_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in [*range(1, 11), 1, 99]] + [(None, 1)], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, labels).withColumn("out", toxicity.held_out()).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    cleaned = toxicity.clean(docs, labels)
    assert cleaned.columns == docs.columns
    unlabelled = toxicity.score(docs, labels.limit(0))
    assert unlabelled.filter("predicted = 0").count() == len(TEXTS)
    assert toxicity.score(no_docs(spark), labels).count() == 0


def test_features_fold_case_and_punctuation():
    assert set(toxicity.features("You, FOOL!")) == set(toxicity.features("you fool"))
    assert len(toxicity.features(None)) == len(toxicity.features(" .. ")) == 0
    assert len(toxicity.features("a b c d")) == 4 + 3 + 2 + 1
