import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from caseflow.operators import recall
from caseflow.operators.governance import fingerprint

PRINTS = "case_id bigint, fingerprint array<string>, words string"


def by_brute_force(sets, percent=80):
    groups = {}
    for case, words in sets:
        groups.setdefault(frozenset(words), []).append(case)
    found = []
    for words, cases in groups.items():
        linked = [c for w, c in groups.items() if w != words and w and words
                  and 100 * len(w & words) >= percent * max(len(w), len(words))]
        own = len(cases) - 1 if words else 0
        found.append((min(cases), len(cases), own + sum(map(len, linked)), len(linked)))
    return sorted(found)


def rows(spark, sets):
    return spark.createDataFrame([(c, w, "clash") for c, w in sets], PRINTS)


def matched(spark, sets, **options):
    return sorted(tuple(r) for r in recall.fingerprint_match(rows(spark, sets), **options).collect())


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnop"
    sets = [(k, rng.sample(letters, rng.randint(1, 9))) for k in range(150)]
    base = [f"w{k}" for k in range(40)]
    for k in range(150, 230):  # near copies at and beside the limit, and copies of them
        sets.append((k, rng.sample(base, rng.randint(30, 40)) + rng.sample(letters, rng.randint(0, 4))))
        sets.append((k + 1000, sets[-1][1][::-1]))
    for percent in (80, 55):
        assert matched(spark, sets, percent=percent) == by_brute_force(sets, percent)
    assert max(n for *_, n in by_brute_force(sets)) > 3


def test_copies_are_not_paired(spark):
    words = [f"w{k}" for k in range(20)]
    sets = [(k, words) for k in range(2000)] + [(5000, [*words, "x"]), (5001, words[:9])]
    assert matched(spark, sets) == [(0, 2000, 2000, 1), (5000, 1, 2000, 1), (5001, 1, 0, 0)]
    members, found = recall.classes(rows(spark, sets))
    assert Counter(r.class_id for r in members.collect()) == {0: 2000, 5000: 1, 5001: 1}
    assert [tuple(r) for r in recall.links(found).collect()] == [(0, 5000, 20)]


def test_signatures_tell_unlike_sets_apart(spark):
    """Sets that share a rare word and little else are told apart by their signatures, and linked ones never are."""
    rng = random.Random(2)
    sets = [(k, [f"rare{k // 2}", *rng.sample([f"w{i}" for i in range(4000)], rng.choice((200, 230, 400, 700)))]) for k in range(24)]
    sets += [(100 + k, [*words[:-9], *(f"new{k}-{i}" for i in range(9))]) for k, words in sets]
    _, found = recall.classes(rows(spark, sets))
    words = {r.class_id: set(r.words) for r in found.collect()}
    pruned = 0
    for a, b in combinations(recall.prefixes(found).collect(), 2):
        if a.band == b.band:
            odd = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a.signature, b.signature))
            assert odd <= len(words[a.class_id] ^ words[b.class_id])
            pruned += odd > a.n + b.n - 2 * -(-max(a.n, b.n) * recall.PERCENT // 100)
    assert pruned > 100
    assert matched(spark, sets) == by_brute_force(sets)


def test_awkward_rows(spark):
    sets = [(1, None), (2, []), (3, ["a"]), (3, ["a"]), (None, ["a"]), (4, ["a", "a"])]
    assert matched(spark, sets) == [(1, 2, 0, 0), (3, 4, 3, 0)]
    assert recall.fingerprint_match(rows(spark, [])).count() == 0


def test_fingerprints_of_texts(spark):
    text = " ".join(f"word{k}" for k in range(10))
    df = spark.createDataFrame([("a", text), ("b", f"{text} word3 "), ("c", f"{text} more"), ("d", "")], "case_id string, text string")
    found = recall.fingerprint_match(df.select("case_id", fingerprint(F.col("text")).alias("fingerprint")))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 2, 2, 1), ("c", 1, 2, 1), ("d", 1, 0, 0)]


def near_copies(rng, count, words, changed):
    """Sets that share most of ``words``; what is changed is drawn from few other words, so it is rarer, but not unique."""
    other = [f"other{k}" for k in range(40 * changed)]
    return [(k, [*rng.sample(words, len(words) - changed), *rng.sample(other, changed)]) for k in range(count)]


def linked(sets, percent=80):
    return {(a, b, len(x & y)) for (a, x), (b, y) in combinations([(k, set(w)) for k, w in sets], 2)
            if 100 * len(x & y) >= percent * max(len(x), len(y))}


def test_a_pair_is_taken_about_once(spark):
    """Near copies share dozens of prefix words; their pairs leave the index about once, not once for each word."""
    sets = near_copies(random.Random(3), 120, [f"w{k}" for k in range(300)], 20)
    _, found = recall.classes(rows(spark, sets))
    index = recall._index(recall.prefixes(found), recall.LONGEST).filter("band = 256").toArrow()
    taken = Counter()
    for table in recall._whole(index.to_batches(max_chunksize=100)):
        ids = table.column("class_id").to_numpy()
        for small, large in recall._meetings(table, 256, 8, 80):
            taken.update(frozenset(p) for p in zip(ids[small].tolist(), ids[large].tolist()))
    expected = linked(sets)
    assert len(expected) > 5000 and {frozenset(p[:2]) for p in expected} <= set(taken)
    assert sum(taken.values()) < 3 * len(taken)
    assert {tuple(r) for r in recall.links(found).collect()} == expected


def test_long_lists_are_dealt_into_parts(spark):
    """With lists and candidates dealt into small parts, no link is lost or found twice."""
    rng = random.Random(4)
    sets = [(k, w) for k, w in near_copies(rng, 40, [f"w{i}" for i in range(600)], 66)]
    sets += [(100 + k, w) for k, w in near_copies(rng, 40, [f"w{i}" for i in range(30)], 3)]
    sets += [(200 + k, rng.sample([f"w{i}" for i in range(8)], rng.randint(1, 6))) for k in range(40)]
    _, found = recall.classes(rows(spark, sets))
    kept = {r.class_id for r in found.collect()}
    expected = linked([s for s in sets if s[0] in kept])
    assert len(expected) > 900
    for longest, most in ((5, 7), (50, 100_000)):
        assert sorted(tuple(r) for r in recall.links(found, longest=longest, most=most).collect()) == sorted(expected)


def test_common_words_of_pairs():
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(-60, 60), rng.randint(1, 50))) for _ in range(30)]
    sizes = np.array([len(s) for s in sets])
    words = np.array([w for s in sets for w in s], np.int64)
    one, two = (np.array(x) for x in zip(*combinations(range(30), 2)))
    expected = [len(set(sets[a]) & set(sets[b])) for a, b in zip(one, two)]
    members = np.cumsum(sizes) - sizes, sizes, words
    assert recall._common(*members, one, two).tolist() == expected
    assert recall._common_of_group(*members, one, two).tolist() == expected
    assert recall._common_of_group(*members, one[:20:19], two[:20:19]) is not None
    assert recall._common_of_group(*members, np.arange(15), np.arange(15, 30)) is None
