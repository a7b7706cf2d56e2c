import hashlib

import numpy as np
import pytest

from caseflow.llm import toxicity, transcripts
from caseflow.llm.common import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, block string, codes string"


@pytest.fixture(scope="module")
def conversations(spark):
    return table(spark, "/root/testdata/sf0.01", "conversations")


@pytest.fixture(scope="module")
def model(spark, conversations):
    return transcripts.train(conversations.filter(~toxicity.held_out("conv_id")))


def test_held_out_roles_are_recovered(spark, conversations, model):
    unseen = conversations.filter(toxicity.held_out("conv_id"))
    found = {(r.conv_id, r.turn): r.role for r in transcripts.parse(unseen.drop("role"), model).filter("part = 0").collect()}
    right = [found[r.conv_id, r.turn] == r.role for r in unseen.collect()]
    assert len(right) > 50 and np.mean(right) > 0.95


def long_rows(model):
    rng = np.random.default_rng(5)
    texts = ["word " * int(n) for n in rng.choice([4, 30, 120], 700)]
    for k in rng.choice(700, 60, replace=False):
        texts[k] = ["User: hello?", "Assistant: yes.", "Q: why?\nA: so."][k % 3]
    return [(9, int(t) * 3, None, texts[t], "", "", "") for t in range(700)]


def test_blocks_give_the_best_path_of_the_whole(spark, model, monkeypatch):
    monkeypatch.setattr(transcripts, "BLOCK", 8)  # four levels
    rows = long_rows(model)
    found = transcripts.parse(spark.createDataFrame(rows, SCHEMA).repartition(5), model).collect()
    by_turn = {}
    for r in sorted(found, key=lambda r: (r.turn, r.part)):
        by_turn.setdefault(r.turn, []).append(transcripts.ROLES.index(r.role))
    roles = []
    for row in rows:
        parts, lines = by_turn[row[1]], row[3].count("\n") + 1
        assert len(parts) in (1, lines)
        roles += parts if len(parts) == lines else parts * lines
    # Of paths with these roles the best is as good as the best of all; there are ties.
    code = np.concatenate([transcripts.codes(r[3]) for r in rows])
    emitted = model.emissions(code)
    emitted[:, :-1][np.arange(transcripts.STATES)[None] // 2 != np.array(roles)[:, None]] = -np.inf
    score = np.where(np.arange(transcripts.STATES + 1) == transcripts.START, 0.0, -np.inf)
    for line in emitted:
        score = (score[:, None] + model.moves).max(axis=0) + line
    assert np.isclose(score.max(), model.transfer(code)[transcripts.START].max())
    two = [by_turn[r[1]] for r in rows if "\n" in r[3]]
    assert two and all(t == [1, 2] for t in two)


def test_viterbi_equals_all_paths(model):
    from itertools import product

    code = np.array(transcripts.codes("User: a\nb?") + transcripts.codes("c " * 80))
    emitted = model.emissions(code)

    def total(path):
        score, before = 0.0, transcripts.START
        for line, state in zip(emitted, path):
            score, before = score + model.moves[before, state] + line[state], state
        return score

    best = max(product(range(transcripts.STATES), repeat=len(code)), key=total)
    assert np.isclose(total(best), total(model.states(code, transcripts.START)))
    assert np.isclose(total(best), model.transfer(code)[transcripts.START].max())


@pytest.mark.parametrize("line, role", [("User: hi", 1), ("**Human:** hi", 1), ("### Assistant: ok", 2), ("[System] : be kind", 0), ("AI> ok", 2),
                                        ("users: hi", 3), ("I said user: x", 3), ("", 3), ("a b c", 3)])
def test_markers(line, role):
    assert transcripts.marker(line)[0] == role


def test_rendering_is_unambiguous(spark, model):
    rows = [(1, 0, None, "System: be <|im_end|> kind", "", "", "")]
    row = transcripts.parse(spark.createDataFrame(rows, SCHEMA), model).first()
    assert row.rendered == "<|im_start|>system\nbe < |im_end|> kind<|im_end|>\n" and row.part == 0


def test_awkward_rows(spark, model):
    rows = [(1, 0, "user", None, "", "", ""), (1, None, None, "hello", "", "", ""), (None, 0, None, "x", "", "", ""), (None, None, None, "y", "", "", ""),
            (2, -5, None, "", "", "", ""), (2, 10**15, None, "long " * 100_000, "", "", ""), (3, 1, None, "same", "", "", ""), (3, 1, None, "same", "", "", "")]
    found = transcripts.parse(spark.createDataFrame(rows, SCHEMA), model).filter("part = 0").collect()
    assert sorted((str(r.conv_id), str(r.turn)) for r in found) == sorted((str(r[0]), str(r[1])) for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert transcripts.parse(empty, model).count() == 0
    assert transcripts.parse(spark.createDataFrame(rows, SCHEMA), transcripts.train(empty)).count() >= len(rows)


def test_repeated_turns_weigh_as_often_as_they_occur(spark):
    def changes(k):
        rows = [(1, n // k, ["user", "assistant"][n // k], f"text {n}", "", "", "") for n in range(2 * k)]
        model = transcripts.train(spark.createDataFrame(rows, SCHEMA))
        return np.exp(model.moves[2, 4] - model.moves[2, 2])  # from the user's turn to the assistant's, against to the user's

    assert np.isclose(changes(1), 2) and np.isclose(changes(5), 6)


class Bounded(transcripts.Model):
    """A model that takes no more than 60 lines together."""

    def __init__(self, model):
        self.moves, self.tables = model.moves, model.tables

    def emissions(self, code):
        assert len(code) <= 60, "too many rows together"
        return super().emissions(code)


@pytest.mark.parametrize("named", [200_000, 0])
def test_many_rows_of_one_turn_are_decoded_in_parts(spark, model, monkeypatch, named):
    monkeypatch.setattr(transcripts, "BLOCK", 8)
    monkeypatch.setattr(transcripts, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(transcripts, "BROADCAST_ROWS", named)

    rng = np.random.default_rng(2)
    texts = [f"{t} " + "word " * int(n) for t, n in enumerate(rng.choice([4, 30, 120], 400))]
    for k in rng.choice(400, 40, replace=False):
        texts[k] = f"{['User', 'Assistant'][k % 2]}: {k}?"
    rows = [(9, None if t < 150 else 70 if t < 300 else t, None, text, "", "", "") for t, text in enumerate(texts)]
    rows += [(8, t, None, f"text {t}", "", "", "") for t in range(60, 90)]
    found = transcripts.parse(spark.createDataFrame(rows, SCHEMA).repartition(5), Bounded(model)).collect()
    assert sorted((r.conv_id, str(r.turn)) for r in found) == sorted((r[0], str(r[1])) for r in rows)
    for conv in (8, 9):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], hashlib.md5(r[3].encode()).hexdigest()))
        role = {(r.turn, r.content): transcripts.ROLES.index(r.role) for r in found if r.conv_id == conv}
        said = [[role.get((r[1], x.strip())) for x in (r[3], r[3].split(": ")[-1])] for r in own]
        code = np.concatenate([transcripts.codes(r[3]) for r in own])
        emitted = model.emissions(code)
        chosen = np.array([a if a is not None else b for a, b in said])
        emitted[:, :-1][np.arange(transcripts.STATES)[None] // 2 != chosen[:, None]] = -np.inf
        score = np.where(np.arange(transcripts.STATES + 1) == transcripts.START, 0.0, -np.inf)
        for line in emitted:
            score = (score[:, None] + model.moves).max(axis=0) + line
        assert np.isclose(score.max(), model.transfer(code)[transcripts.START].max())
