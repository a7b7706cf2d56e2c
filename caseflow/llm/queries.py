"""The registered queries of the training-data operators: (spark, folder of tables) -> DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import differencing, extraction, hnsw, jaccard, packing, pieces, runs, secrets, sharding, spelling, topk, toxicity, transcripts
from .common import table

#: Vocabulary files of public tokenizers; they are read where they are installed, never copied.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def repository():
    """A source's documents of one language stand for a repository, the source for its owner."""
    return F.concat_ws("/", "source", "lang")


@query
def op1_sum_of_squares_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op2_stratified_shards(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


@query
def op3_secret_ownership(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"), repository=repository())
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans",
                        "n_live", "n_example")


@query
def op5_offset_pieces(spark, sf_dir):
    coded = pieces.encode(table(spark, sf_dir, "documents"), PIECE_BPE)
    # Pieces lie side by side: what they cover is the sum of their lengths.
    covered = F.aggregate(F.zip_with("ends", "begins", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("covered_bytes"))


@query
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op8_size_aware_jaccard(spark, sf_dir):
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op9_main_text(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_cover_tree_top5(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op10_transcript_roles(spark, sf_dir):
    """Roles are learned from four fifths of the conversations and recovered, without looking at them, in all."""
    rows = table(spark, sf_dir, "conversations")
    model = transcripts.train(rows.filter(~toxicity.held_out("conv_id")))
    return transcripts.parse(rows.drop("role"), model)


@query
def op4_small_world_near_dups(spark, sf_dir):
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_periodic_runs(spark, sf_dir):
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), change=runs.repeated)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"), F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_differencing_packing(spark, sf_dir):
    placed = differencing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spoil=True)
