import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from caseflow import rules as R
from caseflow.functions import fields as X
from caseflow.functions.text import word_count
from caseflow.operators import parse

SCHEMA = "source string, ingest_seq bigint, ts timestamp, given_case_id string, content string"
GUID = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"


def raw(spark, *texts, given=None):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", i, at, given, t) for i, t in enumerate(texts, 1)], SCHEMA)


def parsed(spark, text, **options):
    return parse.parse_case(raw(spark, text), **options).first()


def field(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


def test_short_text_has_no_summary_and_no_symptom(spark):
    row = parsed(spark, "ICM-111: some issue")
    assert (row.case_id, row.summary, row.symptoms) == ("ICM-111", R.NO_SUMMARY, [])


def test_tags_keep_rule_order(spark):
    row = parsed(spark, "ICM-1: the AMA of a Windows host ran into a timeout")
    assert row.tags == ["AMA", "Windows", "Timeout"] and row.case_id == "ICM-1"
    assert row.summary == "ICM-1: the AMA of a Windows host ran into a timeout"


def test_given_id_wins_unless_detected_first(spark):
    df = raw(spark, "ICM-111: some issue", given="MY-CASE-1")
    assert parse.parse_case(df).first().case_id == "MY-CASE-1"
    assert parse.parse_case(df, detected_first=True).first().case_id == "ICM-111"


def test_first_matching_rule_wins_not_the_leftmost_match(spark):
    assert field(spark, "Support-5 then Incident:7", X.detected_case_id) == "Incident:7"
    assert field(spark, "Support Request Number:\n 42", X.detected_case_id) == "Support Request Number:\n 42"


def test_fallback_id_is_stable(spark):
    df = raw(spark, "nothing to see here", "nothing to see here")
    ids = [r.case_id for r in parse.parse_case(df).collect()]
    assert ids == [r.case_id for r in parse.parse_case(df.repartition(3)).orderBy("ingest_seq").collect()]
    assert len(set(ids)) == 2 and all(i.startswith("CASE-") and len(i) == 37 for i in ids)


def test_environment_omits_what_is_absent(spark):
    row = parsed(spark, f"Subscription ID: {GUID}\nMajor OS Version:  Windows 11 \nAgent version 1.35.")
    assert row.environment == {"subscriptionId": GUID, "osVersion": "Windows 11", "agentVersion": "1.35."}
    assert parsed(spark, "nothing").environment == {}


def test_symptoms_of_all_rules_in_rule_order_with_repeats(spark):
    text = "Problem: disk is nearly full\nSymptoms:\n agent stops sending\nissue agent stops sending\nsymptom: short"
    assert field(spark, text, X.symptoms) == ["agent stops sending", "agent stops sending", "disk is nearly full"]


def test_errors_take_five_lines_before_dropping_repeats(spark):
    text = "\n".join(["Error a", "Error a", " Failed b", "Exception c", "Error a", "Error late", "error lower"])
    row = parsed(spark, text)
    assert row.error_patterns == ["Error a", "Failed b", "Exception c"]


def test_summary_skips_rulers_and_headings(spark):
    text = "--- a ruler that is quite long\nsome ADDITIONAL INFORMATION is here\nshort\n  the real summary is this one  \n"
    assert parsed(spark, text).summary == "the real summary is this one"


def test_discussion(spark):
    text = "x\nJane Doe\nnote Submitted at 2024-02-03 10:11:12\nBob\nSubmitted at 2024-02-04"
    assert [(e.author, e.timestamp) for e in field(spark, text, X.discussion)] == [
        ("x\nJane Doe", "2024-02-03 10:11:12\n"[:-1]), ("Bob", "2024-02-04")]


def test_detect_case_ids_by_rule_without_repeats(spark):
    text = "Case 12345678, ICM 600000001 and icm-600000001; Ticket: AB12CD, ICM 600000001"
    assert field(spark, text, X.detect_case_ids) == [
        "ICM 600000001", "icm-600000001", "Case 12345678", "Ticket: AB12CD"]


@pytest.mark.parametrize("text, valid", [
    ("Customer reports that the disk of the machine is full again", True),
    ("Customer", False),
    ("nothing in this long sentence would make anyone open a record", False),
])
def test_case_content(spark, text, valid):
    assert field(spark, text, X.is_case_content) is valid


def test_blank_content_is_refused(spark):
    assert parse.reject_blank(raw(spark, " \n\u00a0", "x", "")).count() == 1


def test_ingest_keeps_originals_out_of_the_fields(spark):
    df = raw(spark, "Error while mailing kim@example.org via 10.1.2.3")
    assert parse.ingest(df).first().error_patterns == ["Error while mailing [EMAIL_1] via [IP_1]"]
    row = parse.ingest(df, fields="raw").first()
    assert row.error_patterns == ["Error while mailing kim@example.org via 10.1.2.3"]
    assert row.content_redacted == "Error while mailing [EMAIL_1] via [IP_1]"
    with pytest.raises(ValueError):
        parse.ingest(df, fields="some")


def test_ingest_splits_into_cases_and_vault(spark):
    done = parse.ingest(raw(spark, "ICM-5: mail a@b.co about the broken printer", "ICM-6: nothing personal in here"))
    assert "content" not in parse.cases_of(done).columns and "mappings" not in parse.cases_of(done).columns
    assert [r.case_id for r in parse.vault_of(done).collect()] == ["ICM-5"]
    assert [tuple(r) for r in parse.case_counts(done).orderBy("ingest_seq").collect()] == [
        ("ICM-5", 1, 0, 0, 1), ("ICM-6", 2, 0, 0, 0)]


def test_ingest_can_compress_first(spark):
    done = parse.ingest(raw(spark, "TID:1 Error x\nTID:2 Error x"), compress=True).first()
    assert done.content_redacted.split("\n") == ["TID:1 Error x", R.REPEATED_HEADER, "[REPEATED 2x] [TID] Error x..."]


def test_texts_are_lower_cased_a_few_times_not_once_per_hint(spark):
    done = parse.ingest(raw(spark, "ICM-1: AMA timeout"), fields="raw")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 4


def test_error_lines_and_words_with_odd_blanks(spark):
    assert field(spark, "a\nan Error\n\nFailed\nan Error\nException\rx", X.error_patterns) == ["an Error", "Failed", "Exception\rx"]
    assert field(spark, "error", X.error_patterns) == [] and field(spark, None, X.error_patterns) is None
    for text, n in (("", 1), (" a", 2), ("a\u00a0b\u3000 c", 3), ("a\x0b\tb ", 3), ("a\u200bb \u4e00", 2), ("\ufeff", 2)):
        assert field(spark, text, word_count) == n


def test_discussion_is_read_up_to_its_last_time(spark):
    text = "Jane Doe\nNote Submitted at 2024-02-03 10:11:12\nBob\nx Submitted at 1\n2 \nMore\nwords " + "Some Words\n" * 3000
    start = time.monotonic()
    assert [(e.author, e.timestamp) for e in field(spark, text, X.discussion)] == [("Jane Doe", "2024-02-03 10:11:12"), ("Bob", "1\n2")]
    assert time.monotonic() - start < 8
    assert field(spark, "Submitted at ", X.discussion) == [] and field(spark, "A\nSubmitted at 5 Submitted at x", X.discussion)[0].timestamp == "5"
