import random

from caseflow.operators import logs
from caseflow.plans.corpus import raw_cases

from . import reference_fold as ref


def soup(seed):
    rng = random.Random(seed)
    stamp = ["2024-01-01T00:00:00.001", "2024-01-01T00:00:09.999", ""]
    return "\n".join(f"{rng.choice(stamp)}{rng.choice(['', ' '])}TID:{rng.randint(1, 3)} {rng.choice(['a', 'b', 'TID:9'])}"
                     if rng.random() < 0.8 else rng.choice(["", " ", "x" * 130]) for _ in range(rng.randint(1, 30)))


def test_equals_brute_force(spark, sf_dir):
    texts = ["", "a", "a\na", "\n\n", "TID:1 TID:2\nTID:3 TID:2"] + [soup(i) for i in range(200)]
    texts += [r.content for r in raw_cases(spark, sf_dir).select("content").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string").repartition(4)
    for row in logs.compress_logs(df).collect():
        assert row.content_compressed == ref.compress(texts[row.i])


def test_in_place_and_without_shuffle(spark):
    df = spark.createDataFrame([("a\na",)], "content string")
    done = logs.compress_logs(df, into="content")
    assert done.columns == ["content"]
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_pattern_counts_over_cases(spark):
    df = spark.createDataFrame([("c1", "TID:1 x\nTID:2 x\ny"), ("c1", "y"), ("c2", "TID:4 x")],
                               "case_id string, content string")
    assert {tuple(r) for r in logs.log_pattern_counts(df).collect()} == {("[TID] x", 3, 2), ("y", 2, 1)}
