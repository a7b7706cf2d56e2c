import dataclasses
import random
import time

import pytest
from pyspark.sql import functions as F

from caseflow import rules as R
from caseflow.functions.fields import entities
from caseflow.functions.text import rule_regex
from caseflow.operators import redact as D
from caseflow.plans.corpus import raw_cases

from . import reference_fold as ref

EDGES = [
    "", "x", "Please write to pat@sample.org today", "The host 10.20.30.40 is down", "a@b.co a@b.co", "a@b.c-@d.e x..-@y.z a@b@c.d",
    "..a@b.c -.-x@y.z- a.b.c@d", "9x@corp.com.9y@corp.netx 1@corp.com", "-@microsoft.com a-@microsoft.com-b@microsoft.com",
    "\u00e91.2.3.4", "-x-@host.org and .a.@b-c.de.", "1.2.3.4.5 999.999.999.999", "[EMAIL_1] a@b.co",
    "\\\\srv\\share one two\nC:\\Users\\joe\\a.log; HKEY_LOCAL_MACHINE\\Soft.ware", "xserver=db.a;Database=m",
    "VM-prod_1 vm- 555-123-4567 1555-123-4567", "\u00a0/subscriptions/" + "a" * 36 + "/resourceGroups/x",
    "mark \ufdd0 and \ufdd1 then 1.2.3.4 \ufdd0", "user\u212a key john@microsoft.com.au MICROSOFT@Microsoft.COM",
    "Customer John Smith Doe", "John Smith" + " x" * 60 + " customer", "John Smith" + " x" * 30 + " user",
    "contact" + " y" * 48 + " Ann Lee", "contact" + " y" * 50 + " Ann Lee", "tenant ABCDEFGH12 account ZZZZZZZZ",
    "to\u212aen abcdefghij0123456789XYZ", "abcdefghij0123456789XYZ" + "." * 72 + "auth",
    "abcdefghij0123456789XYZ" + "." * 73 + "auth", "abcdefghij0123456789XYZ" + "." * 74 + "auth",
    "c:\\users\\ann b\\x server=a", "AB123456 AB1234 XYZ12345678 KB50012x",
]


def soup(seed: int) -> str:
    rng = random.Random(seed)
    words = ["customer", "Contact", "user", "account", "token", "Ann Lee", "Bob", "Smith", "a.b@c.org", "-", "@", ".",
             "10.0.0.1", "vm-a", "555-123-4567", "\\\\s\\t", "C:\\", "\\Users\\", "server=", "database=x", "\u00e9",
             "\n", "\u00a0", "AB1234567", "HKEY_A\\b", "abcdefghij0123456789", "[IP_1]", "key", "0a1b2c3d", " ", " "]
    return "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 120)))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    corpus = [r.content for r in raw_cases(spark, sf_dir).select("content").collect()]
    return EDGES + [soup(i) for i in range(400)] + corpus


@pytest.mark.parametrize("rules", [R.PII_RULES, R.PII_RULES_LEGACY, R.CONTEXT_RULES,
                                   R.PII_RULES_LEGACY + R.CONTEXT_RULES, R.PII_RULES_EXTENDED])
def test_equals_a_plain_fold(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string").repartition(8)
    for row in D.redact(df, rules=rules).collect():
        text, mappings = ref.redact(texts[row.i], rules)
        assert row.content_redacted == text
        assert [(m.token, m.original) for m in row.mappings] == mappings


def test_no_match_leaves_the_text_alone(spark):
    row = D.redact(spark.createDataFrame([("The printer on the second floor is out of paper",)], "content string")).first()
    assert row.content_redacted == row.content and row.mappings == [] and row.token_collision is False


def test_collision_is_flagged(spark):
    row = D.redact(spark.createDataFrame([("see [EMAIL_1] a@b.co",)], "content string")).first()
    assert row.token_collision is True and row.content_redacted == "see [EMAIL_1] [EMAIL_1]"


def test_rehydrate_restores_everything_without_collision(spark, texts):
    df = D.redact(spark.createDataFrame([(t,) for t in texts], "content string")).filter("not token_collision")
    restored = df.withColumn("back", D.rehydrated(F.col("content_redacted"), F.col("mappings")))
    assert restored.filter("back <> content").count() == 0 and restored.count() > 300


def test_newest_first_restores_swallowed_tokens(spark):
    text = "user at C:\\Users\\x 10.0.0.1 customer"
    df = D.redact_legacy(spark.createDataFrame([(text,)], "content string"))
    back = df.select(D.rehydrated(F.col("content_redacted"), F.col("mappings"), newest_first=True)).first()[0]
    assert back == text


def test_nothing_is_left_of_closed_patterns_in_real_texts(spark, sf_dir):
    # Where values touch, as in "10.0.0.1vm-a", replacing the second bares the first after its rule has run; the
    # sequential definition leaves it, and the outbound check reports it (test_governance).
    df = D.redact(raw_cases(spark, sf_dir))
    for rule in R.PII_RULES:
        if rule.category in ("GUID", "IP_ADDRESS", "PHONE"):
            assert df.filter(F.rlike("content_redacted", F.lit(rule_regex(rule)))).count() == 0


def test_rules_sharing_a_token_share_its_numbers(spark):
    rules = [R.PiiRule("A", "X", r"a\d"), R.PiiRule("B", "X", r"b\d")]
    row = D.redact(spark.createDataFrame([("b1 a1 a2 b2",)], "content string"), rules=rules).first()
    assert row.content_redacted == "[X_3] [X_1] [X_2] [X_4]"
    assert [m.token for m in row.mappings] == ["[X_1]", "[X_2]", "[X_3]", "[X_4]"]


def test_every_stage_runs_once_whatever_is_put_on_top(spark):
    df = D.redact(spark.createDataFrame([("x",)], "content string"))
    on_top = df.filter(F.size("mappings") > 0).filter(F.contains("content_redacted", F.lit("zz"))).select("mappings")
    plan = on_top._jdf.queryExecution().optimizedPlan().toString()
    marks = 1  # the longest run of a mark, looked up for a text that holds them all
    assert plan.count("regexp_extract_all(") == len(R.PII_RULES) + marks


def test_a_text_with_every_mark_is_redacted(spark):
    marks = "".join(D._MARKS)
    for text in (marks + " 1.2.3.4 " + marks[1] * 3 + " a@b.co " + marks[:2], marks * 2 + "customer Ann Lee" + marks[1] * 5):
        for rules in (R.PII_RULES, R.PII_RULES_LEGACY + R.CONTEXT_RULES):
            row = D.redact(spark.createDataFrame([(text,)], "content string"), rules=rules).first()
            assert (row.content_redacted, [(m.token, m.original) for m in row.mappings]) == ref.redact(text, rules)


@pytest.mark.parametrize("unit", ["a", "a.", "1.", "A1", "a-", "a@", "a@b.", ".", "-", "@", "x@y", "1.1 "])
def test_a_long_word_is_read_in_seconds(spark, unit):
    text = unit * (1_000_000 // len(unit)) + " @ a@b.co"
    df = spark.createDataFrame([(text,)], "content string")
    start = time.monotonic()
    for rules in (R.PII_RULES, R.PII_RULES_LEGACY, R.PII_RULES_EXTENDED):
        small = [r for r in rules if r.hint == "@" or r.token in ("MS_EMAIL", "IP")]
        D.redact(df, rules=small).select(F.length("content_redacted"), F.size("mappings")).collect()
    df.select(F.size(entities(F.col("content")))).collect()
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("rules", [R.PII_RULES, R.PII_RULES_LEGACY + R.CONTEXT_RULES, R.PII_RULES_EXTENDED])
def test_newest_first_restores_every_pack(spark, texts, rules):
    df = spark.createDataFrame([(t,) for t in [*texts[:300], "see /home/a@b.co/x"]], "content string").repartition(8)
    done = D.redact(df, rules=rules).filter(~F.col("token_collision"))
    restored = D.rehydrated(F.col("content_redacted"), F.col("mappings"), newest_first=True)
    assert done.filter(restored != F.col("content")).count() == 0


@pytest.mark.parametrize("rules", [R.PII_RULES, R.PII_RULES_LEGACY, R.PII_RULES_EXTENDED])
def test_searching_around_a_character_finds_what_the_whole_text_holds(spark, rules):
    rng, parts = random.Random(7), ["a", "b-c", "@", "@microsoft.com", "x.org", " ", "  ", "\n", "-", ".", "vm-1", "555-123-4567", "\u00e9", "\u00a0",
                                    "0a1b2c3d-0000-1111-2222-0a1b2c3d4e5f", "\ufdd0", "_"]
    texts = ["", " ", "@", "-", " @ ", "@ -", *["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(600)]]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, content string").repartition(8)
    whole = [dataclasses.replace(r, around=None) for r in rules]
    assert any(r.around for r in rules)
    done = [{r.n: (r.content_redacted, r.mappings) for r in D.redact(df, rules=some).collect()} for some in (rules, whole)]
    assert done[0] == done[1] and sum(len(m) for _, m in done[0].values()) > 200


def test_inventory(spark):
    df = spark.createDataFrame([("c1", "a@b.co 1.2.3.4"), ("c2", "x@y.z 1.1.1.1 2.2.2.2")], "case_id string, content string")
    done = D.redact(df)
    assert {tuple(r) for r in D.pii_inventory(done).collect()} == {("EMAIL", 2), ("IP_ADDRESS", 3)}
    assert ("c2", "IP_ADDRESS", 2) in {tuple(r) for r in D.pii_inventory(done, ["case_id"]).collect()}


def test_token_names_are_checked():
    with pytest.raises(ValueError):
        R.PiiRule("A", "a b", "x")
