import pytest
from pyspark.sql import functions as F

from caseflow.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, expected", [
    (" a b ", "a b"), ("\u00a0\ufeff x\t\r\n", "x"), ("", ""), (" \n\t", ""), ("x\u0085", "x\u0085"),
])
def test_trim_strips_every_ecmascript_blank(spark, value, expected):
    assert one(spark, value, T.trim) == expected


def test_lines_are_trimmed_and_not_empty(spark):
    value = "  a \n\n \u00a0\nb\r\n\tc d\t\n"
    assert one(spark, value, T.lines) == ["a", "b", "c d"]
    assert one(spark, value, T.trimmed_lines) == "a\nb\nc d"
    assert one(spark, "", T.lines) == []


@pytest.mark.parametrize("value, expected", [("", 1), ("a", 1), (" a b ", 4), ("a\u3000b\n\nc", 3), ("   ", 2)])
def test_word_count_counts_pieces_between_blank_runs(spark, value, expected):
    assert one(spark, value, T.word_count) == expected


@pytest.mark.parametrize("pattern, value, expected", [
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "\u00e91.2.3.4", "1.2.3.4"),
    (r"\b[\w.-]+@[\w-]+\.[\w.-]+\b", "-x-@h.org.", "x-@h.org"),
    (r"a\sb", "a\u00a0b", "a\u00a0b"),
    (r"a.b", "a\nb", ""),
    (r"a.b", "a\u0085b", "a\u0085b"),
    (r"^b", "a\nb", "b"),
    (r"[\w\s]+", "x \u2003y!", "x \u2003y"),
])
def test_java_regex_matches_what_ecmascript_matches(spark, pattern, value, expected):
    assert one(spark, value, lambda c: F.regexp_extract(c, T.java_regex(pattern), 0)) == expected


def test_quoted_survives_sql_parsing(spark):
    value = r"it's \d+ \\ 'x' \u212A"
    assert spark.range(1).select(F.expr(T.quoted(value)).alias("r")).first()["r"] == value


def test_once_is_a_barrier_for_filters(spark):
    df = T.once(spark.range(3), ["id"], doubled=F.expr("sha2(cast(id as string), 256)"))
    plan = df.filter("doubled like 'a%' or doubled like 'b%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
