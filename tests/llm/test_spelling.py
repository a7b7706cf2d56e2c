import random
import re
import zlib
from collections import Counter, defaultdict

from caseflow.llm import spelling
from caseflow.llm.queries import QUERIES

from .rows import TEXTS, edge_docs, no_docs


def edited(word, letters):
    """All words one edit away."""
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1:]
            yield from (word[:k] + c + word[k + 1:] for c in letters if c != word[k])


def counted(rows):
    upper = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    total = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(upper)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if doc is not None and h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def expected(words):
    letters = {c for w in words for c in w}
    near = {w: {x for x in edited(w, letters) if x in words} - {w} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, form[w], root(w), len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "root", "n_near", "form_n").collect())


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(900):  # few letters: many near words, and many with the same letters in another order
        word = "".join(rng.choice("abé") for _ in range(rng.randint(7, 8)))
        words[word] = int(10 ** rng.uniform(0.4, 7))
    long = "ab" * 400
    words |= {long: 5, long + "c": 60, long[:300] + "x" + long[301:]: 700, "𝒳" * 8: 2, "𝒳" * 7: 20, "aaaaaaa": 3, "aaaaaaaa": 3}
    found = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert found == expected(words)
    assert max(r[4] for r in found) > 3 and any(r[3] != r[0] and r[3] != r[2] for r in found)


def test_words_one_edit_apart_share_a_signature_and_a_half():
    rng = random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 14)))
        other = rng.choice([*edited(word, "abxé")])
        if other == word:
            continue
        a, b = sorted((word, other), key=len)
        assert set(spelling.multiset_signatures(a)) & set(spelling.multiset_signatures(b))
        assert set(spelling.halves(a, len(a))) & set(spelling.halves(b, len(a)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    stems = ["".join(rng.choice("thernoiaÉèx") for _ in range(rng.randint(6, 12))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice([w, w.upper(), w + "1", f"({w})"]) for w in rng.choices(stems, k=80))) for k in range(400)]
    rows += [(None, "nowhere nowhere"), (7, None), (8, ""), (9, "×÷×÷×÷×÷ " * 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of(QUERIES["op13_spelling_variants"](spark, str(tmp_path)))
    assert found == expected(counted(rows)) and sum(r[2] is not None for r in found) > 50


def test_awkward_rows(spark):
    found = rows_of(spelling.spelling_variants(edge_docs(spark), spoil=True))
    assert found == expected(counted([(d, t) for d, t, *_ in TEXTS]))
    assert spelling.spelling_variants(no_docs(spark)).count() == 0


def test_chains_end_at_their_root(spark):
    chain = ["a" * k for k in range(7, 14)]
    words = defaultdict(int, {w: 2 * 10 ** k for k, w in enumerate(chain)})
    found = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert found == expected(words) and {r[3] for r in found} == {chain[-1]}
