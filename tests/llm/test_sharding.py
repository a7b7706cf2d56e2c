import zlib
from collections import Counter

from pyspark.sql import functions as F

from caseflow.llm import sharding

from .rows import TEXTS, edge_docs, no_docs


def check(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min([*counts.values(), *([0] * (shards - len(counts)))]) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_counts_mixture_and_order(spark):
    docs = spark.range(4003).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("é"), (F.col("id") % 5).cast("int")).alias("text"))
    rows = sharding.shard(docs, rows_per_bucket=50).collect()
    assert len(rows) == 4003
    check(rows, 8)
    total = Counter(r.source for r in rows)
    for (source, _), n in Counter((r.source, r.shard) for r in rows).items():
        assert abs(n - total[source] / 8) <= 1.5
    assert sorted(docs.collect(), key=lambda r: r.doc_id)[4].text == "é" * 4
    assert all(r.size == 2 * (r.doc_id % 5) + 1 and r.text_crc32 == zlib.crc32(("é" * (r.doc_id % 5)).encode()) for r in rows)
    again = sharding.shard(docs.repartition(13), rows_per_bucket=700).collect()
    assert sorted(rows) == sorted(again)
    other = sharding.shard(docs, seed="another").collect()
    assert sorted(rows) != sorted(other)


def test_fractions_are_exact(spark):
    rows = sharding.shard(edge_docs(spark)).collect()
    by_source = Counter(s for _, _, _, s in TEXTS)
    for source, n in by_source.items():
        found = sorted(r.fraction for r in rows if r.source == source)
        assert found == [(2 * k + 1) / (2 * n) for k in range(n)]
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.fraction for r in order] == sorted(r.fraction for r in rows)


def test_awkward_rows(spark):
    rows = sharding.shard(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    check(rows, 8)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)}
    assert sharding.shard(no_docs(spark)).count() == 0
