"""Column functions that read structured fields out of raw case text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import (
    empty_strings,
    extract,
    extract_all,
    java_regex,
    rule_regex,
    trim,
)


# ``lowered`` is the text in lower case where the caller has it as a column: then it is not made again for every hint.


def _may_match(text: Column, rule: R.Rule, lowered: Column | None = None) -> Column:
    test = F.lit(not rule.hints)
    for hint in rule.hints:
        test = test | F.contains(F.lower(text) if lowered is None else lowered, F.lit(hint))
    return test


def _found(text: Column, rule: R.Rule, group: int = 0, lowered: Column | None = None) -> Column:
    return F.when(_may_match(text, rule, lowered), extract_all(text, rule_regex(rule), group)).otherwise(empty_strings())


def summary(line_text: Column) -> Column:
    """First meaningful line of newline-joined trimmed lines."""
    regex = (rf"(?<![^\n])(?!{R.SUMMARY_SKIP_PREFIX})(?![^\n]*{R.SUMMARY_SKIP_TEXT})"
             rf"[^\n]{{{R.SUMMARY_MIN_LENGTH + 1},}}")
    return F.coalesce(extract(line_text, regex), F.lit(R.NO_SUMMARY))


def detected_case_id(text: Column, rules: Sequence[R.Rule] = R.CASE_ID_RULES, lowered: Column | None = None) -> Column:
    """Whole match of the first rule that matches anywhere, else NULL."""
    return F.coalesce(*[F.when(_may_match(text, r, lowered), extract(text, rule_regex(r))) for r in rules])


def fallback_case_id(source: Column, ingest_seq: Column, text: Column) -> Column:
    """A stable id, so that a retried task names the case the same way."""
    key = F.concat_ws("|", source, ingest_seq.cast("string"), text)
    return F.concat(F.lit("CASE-"), F.md5(key))


def environment(text: Column, rules: Sequence[R.Rule] = R.ENVIRONMENT_RULES, lowered: Column | None = None) -> Column:
    """Map of the fields found; the value is trimmed, fields without a match are left out."""
    entries = F.array(*[
        F.struct(F.lit(r.name).alias("key"),
                 F.when(_may_match(text, r, lowered), F.regexp_extract(text, rule_regex(r), 1)).otherwise("").alias("value"))
        for r in rules
    ])
    found = F.filter(entries, lambda e: e["value"] != "")
    return F.map_from_entries(
        F.transform(found, lambda e: F.struct(e["key"].alias("key"), trim(e["value"]).alias("value"))))


def symptoms(text: Column, rules: Sequence[R.Rule] = R.SYMPTOM_RULES,
             min_length: int = R.MIN_SYMPTOM_LENGTH, lowered: Column | None = None) -> Column:
    """Every phrase after a symptom word, rule by rule, longer than ``min_length`` once trimmed."""
    found = F.concat(*[_found(text, r, 1, lowered) for r in rules])
    return F.filter(F.transform(found, trim), lambda s: F.length(s) > min_length)


def error_patterns(line_text: Column, words: Sequence[str] = R.ERROR_WORDS,
                   limit: int = R.MAX_ERROR_LINES) -> Column:
    """The first ``limit`` lines holding an error word, then without repeats (in that order)."""
    def told(line: Column) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(line, F.lit(word))
        return test

    found = F.filter(F.split(line_text, "\n", -1), told)
    return F.when(~told(line_text), empty_strings()).otherwise(F.array_distinct(F.slice(found, 1, limit)))


def tags(text: Column, rules: Sequence[R.Rule] = R.TAG_RULES, lowered: Column | None = None) -> Column:
    """Names of the rules that match, in rule order."""
    return F.array_compact(F.array(*[
        F.when(_may_match(text, r, lowered) & F.rlike(text, F.lit(rule_regex(r))), F.lit(r.name)) for r in rules]))


def discussion(text: Column) -> Column:
    """Discussion entries as (author, timestamp)."""
    regex = java_regex(R.DISCUSSION_PATTERN)
    # No entry ends behind the last hint and the time after it, and the regex need not look for one there.
    rest = F.substring_index(text, R.DISCUSSION_HINT, -1)
    held = F.concat(F.left(text, F.char_length(text) - F.char_length(rest)), F.regexp_extract(rest, java_regex(R.DISCUSSION_TIME), 0))
    pairs = F.arrays_zip(extract_all(held, regex, 1).alias("author"), extract_all(held, regex, 2).alias("timestamp"))
    entries = F.transform(
        pairs, lambda e: F.struct(trim(e["author"]).alias("author"), trim(e["timestamp"]).alias("timestamp")))
    none = F.array().cast("array<struct<author:string,timestamp:string>>")
    return F.when(F.contains(text, F.lit(R.DISCUSSION_HINT)), entries).otherwise(none)


def detect_case_ids(text: Column, rules: Sequence[R.Rule] = R.DETECT_ID_RULES) -> Column:
    """All matches of all rules, rule by rule, without repeats; the first one is the suggested id."""
    return F.array_distinct(F.concat(*[_found(text, r) for r in rules]))


def is_case_content(text: Column, min_length: int = R.MIN_CONTENT_LENGTH,
                    rules: Sequence[R.Rule] = R.CONTENT_INDICATORS) -> Column:
    """Long enough and holding at least one case indicator."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.rlike(text, F.lit(rule_regex(r)))
    return (F.length(text) >= min_length) & hit


def content_hash(text: Column) -> Column:
    return F.md5(text)


def linked_items(text: Column) -> Column:
    """Numbers of the work items a text refers to."""
    return F.array_distinct(extract_all(text, java_regex(R.LINKED_ITEM_PATTERN), 1))


def entities(text: Column, rules: Sequence[R.Rule] = R.ENTITY_RULES) -> Column:
    """Small entities as (kind, value), rule by rule, without repeats."""
    def found(rule: R.Rule) -> Column:
        return F.transform(extract_all(text, rule_regex(rule)),
                           lambda v: F.struct(F.lit(rule.name).alias("kind"), v.alias("value")))

    return F.array_distinct(F.concat(*[found(r) for r in rules]))


__all__ = [
    "content_hash", "detect_case_ids", "detected_case_id", "discussion", "entities", "environment",
    "error_patterns", "fallback_case_id", "is_case_content", "linked_items", "summary", "symptoms", "tags",
]
