"""Weighted substring search over cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.match import any_contains, contains, count_containing
from ..functions.text import once
from .cases import latest
from .context import CONTEXT_COLUMNS, context_columns

RESULT_COLUMNS = ("case_id", "score", "matches", "summary", "tags", "created_at")
#: What of a case travels with its hits, and the columns of a search for many phrases.
NARROW = ["case_id", "summary", "tags", "created_at", "first_seq"]
BATCH_COLUMNS = ("query_no", "query", "rank", *RESULT_COLUMNS, "first_seq")
DEFAULT_LIMIT = 10


def lowered_fields() -> dict[str, Column]:
    """Per search field, its text in lower case: a string or an array of strings."""
    def each(name: str) -> Column:
        return F.transform(name, F.lower)

    return {"summary": F.lower("summary"), "symptoms": each("symptoms"), "errors": each("error_patterns"),
            "tags": each("tags"), "content": F.lower("content_redacted")}


def field_hits(fields: dict[str, Column], query: Column, accumulate: bool = False) -> dict[str, Column]:
    """Per search field, how often its weight counts: once, or per matching element with ``accumulate``."""
    hits = {}
    for name, value in fields.items():
        if name in ("summary", "content"):
            hits[name] = contains(value, query).cast("int")
        else:
            hits[name] = (count_containing if accumulate else any_contains)(value, query).cast("int")
    return {name: F.coalesce(hit, F.lit(0)) for name, hit in hits.items()}


def score_of(hits: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name, weight in R.SEARCH_WEIGHTS:
        total = total + hits[name] * weight
    return total


def matches_of(hits: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hits[name] > 0, F.lit(name)) for name, _ in R.SEARCH_WEIGHTS]))


def scored(cases: DataFrame, query: str, accumulate: bool = False) -> DataFrame:
    """Cases with ``score`` and ``matches``; every field is looked at once."""
    hits = field_hits(lowered_fields(), F.lower(F.lit(query)), accumulate)
    counted = once(cases, cases.columns, **{f"_{name}": hit for name, hit in hits.items()})
    seen = {name: F.col(f"_{name}") for name in hits}
    return counted.select(*cases.columns, score_of(seen).alias("score"), matches_of(seen).alias("matches"))


def _narrow(found: DataFrame, with_context: bool, keep: Sequence[str]) -> DataFrame:
    """Results without the case text; with ``with_context`` plus the compact context columns."""
    extra = [c for c in CONTEXT_COLUMNS if c not in RESULT_COLUMNS] if with_context else []
    contexts = {name: column for name, column in zip(CONTEXT_COLUMNS, context_columns())}
    return found.select(*RESULT_COLUMNS, *[contexts[name] for name in extra], *keep)


def _best(found: DataFrame, limit: int) -> DataFrame:
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return found.filter(F.col("score") > 0).orderBy(F.desc("score"), "first_seq").limit(limit)


def search(cases: DataFrame, query: str, limit: int = DEFAULT_LIMIT, accumulate: bool = False,
           with_context: bool = False) -> DataFrame:
    """The best ``limit`` current cases for ``query``; equal scores keep the order in which cases first appeared.

    ``with_context`` also returns the columns of a compact context, which saves a look-up afterwards.
    """
    return _best(_narrow(scored(cases, query, accumulate), with_context, ["first_seq"]), limit)


def search_history(history: DataFrame, query: str, limit: int = DEFAULT_LIMIT, accumulate: bool = False,
                   with_context: bool = False) -> DataFrame:
    """``search`` straight on the append-only store.

    Scores every write first and picks the current one afterwards, so case texts are read but never shuffled.
    """
    found = latest(_narrow(scored(history, query, accumulate), with_context, ["ingest_seq"]))
    return _best(found.drop("ingest_seq"), limit)


def top_per_query(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits of every query.

    The hits of a query are ranked in as many parts as there are shuffle partitions, so that a query that a third of all
    cases match is not sorted in one task; the final ranking sees at most ``limit`` rows per part.
    """
    order = (F.desc("score"), F.asc("first_seq"))
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = (hits.withColumn("_part", F.pmod(F.xxhash64("case_id"), F.lit(parts)))
            .withColumn("_rank", F.row_number().over(W.partitionBy("query_no", "_part").orderBy(*order)))
            .filter(F.col("_rank") <= limit).drop("_part", "_rank"))
    return (hits.withColumn("rank", F.row_number().over(W.partitionBy("query_no").orderBy(*order)))
            .filter(F.col("rank") <= limit))


def hits_of(cases: DataFrame, accumulate: bool = False) -> DataFrame:
    """Hits of cases with the phrases of their ``_wanted``, an array of (query_no, query, needle in lower case)."""
    names = [name for name, _ in R.SEARCH_WEIGHTS]
    # Lower-casing happens once per case, not once per case and query.
    return _compared(once(cases, [*NARROW, "_wanted"], **{f"_{n}": c for n, c in lowered_fields().items()}), names, accumulate)


def _compared(lowered: DataFrame, names: list[str], accumulate: bool) -> DataFrame:
    def count(q: Column) -> Column:
        hits = field_hits({n: F.col(f"_{n}") for n in names}, q["needle"], accumulate)
        return F.struct(q["query_no"].alias("query_no"), q["query"].alias("query"),
                        *[hits[n].alias(n) for n in names])

    def any_hit(r: Column) -> Column:
        return F.greatest(*[r[n] for n in names]) > 0

    found = once(lowered, NARROW, _found=F.filter(F.transform("_wanted", count), any_hit))
    one = found.select(*NARROW, F.explode("_found").alias("_hit"))
    seen = {n: F.col(f"_hit.{n}") for n in names}
    return one.select("_hit.query_no", "_hit.query", *NARROW, score_of(seen).alias("score"),
                      matches_of(seen).alias("matches"))


def _hits(cases: DataFrame, queries: list[tuple[int, str]], accumulate: bool, per_pass: int) -> DataFrame:
    names = [name for name, _ in R.SEARCH_WEIGHTS]
    lowered = once(cases, NARROW, **{f"_{n}": c for n, c in lowered_fields().items()})
    phrases = [F.struct(F.lit(i).alias("query_no"), F.lit(q).alias("query"), F.lower(F.lit(q)).alias("needle")) for i, q in queries]
    passes = [F.array(*phrases[k:k + per_pass]) for k in range(0, len(phrases), per_pass)]
    return _compared(lowered.withColumn("_wanted", F.explode(F.array(*passes))), names, accumulate)


def numbered(queries: Sequence[str]) -> list[tuple[int, str]]:
    if not queries:
        raise ValueError("no queries given")
    return list(enumerate(queries))


def search_batch(cases: DataFrame, queries: Sequence[str], limit: int = DEFAULT_LIMIT, accumulate: bool = False,
                 per_pass: int = 200) -> DataFrame:
    """``search`` for many phrases: ``query_no``, ``query``, ``rank`` and the result columns.

    Each case is scored against a list of phrases in place and only hits leave the row, so cases and phrases are never
    paired up.  A longer list is cut: a case, prepared once, goes through it ``per_pass`` phrases at a time.
    """
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return top_per_query(_hits(cases, numbered(queries), accumulate, per_pass), limit).select(*BATCH_COLUMNS)
