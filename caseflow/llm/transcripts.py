"""Transcript parsing: a hidden Markov model recovers who speaks, and turns are rendered in one canonical form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import BROADCAST_ROWS, buckets_for, fraction_below, stored

ROLES = ("system", "user", "assistant")
#: What speakers are called at the beginning of a line, by role.
MARKERS = {"system": "system|instructions?|context", "user": "user|human|customer|client|question|q|you|me",
           "assistant": "assistant|ai|bot|agent|support|model|answer|a"}
#: Turns, and later blocks of turns, that one task decodes together.
BLOCK = 64
#: A block with more rows than this, as turn numbers are repeated or null, is cut at ranges of the texts' hashes.
ROWS_PER_BLOCK = 4 * BLOCK
#: What each state is taken to have had beside what is counted: lines of every value, lines with its own marker and with
#: another role's; and the share of turns that begin within a row.
SMOOTHING, OWN_MARKER, OTHER_MARKER, WITHIN_ROW = 0.5, 50.0, 0.0001, 0.1
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Each role begins a turn or continues it; the last state stands before the first line.
STATES = 2 * len(ROLES)
START = STATES

_MARKER = re.compile(r"^[\s*#>\[(-]*(?:<\|(?:im_start\|>)?\s*)?(?:" + "|".join(f"(?P<{r}>{m})" for r, m in MARKERS.items())
                     + r")\s*(?:\|>|[\])*]*\s*[:>]|(?<=[\s#>|])$)[\s*]*", re.I)
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s|^(?:\s{4}|```)")
#: Values of each line feature: marker, first line of a row, length, ending, kind, length of a first line's whole row.
_SIZES = (len(ROLES) + 1, 2, 12, 3, 2, 16)


def marker(line: str) -> tuple[int, int]:
    """(role or len(ROLES), characters): the speaker marker that a line begins with."""
    found = _MARKER.match(line)
    if not found:
        return len(ROLES), 0
    return ROLES.index(found.lastgroup), found.end()


def codes(text: str | None) -> list[int]:
    """One number per line of a row: its features in mixed radix."""
    whole = text or ""
    out = []
    for k, line in enumerate(whole.split("\n")):
        bare = line.strip()
        values = (marker(line)[0], int(k == 0), min(len(bare).bit_length(), 11), 0 if bare.endswith("?") else 1 if bare.endswith(":") else 2,
                  int(bool(_ITEM.match(line))), min(len(whole).bit_length(), 14) + 1 if k == 0 else 0)
        code = 0
        for value, size in zip(values, _SIZES):
            code = code * size + value
        out.append(code)
    return out


def _features(code: np.ndarray) -> list[np.ndarray]:
    out = []
    for size in reversed(_SIZES):
        out.append(code % size)
        code = code // size
    return out[::-1]


class Model:
    """Logarithms: ``moves`` from state to state (the row START is the beginning), and ``tables`` per feature and state."""

    def __init__(self, lines: pd.DataFrame, turns: pd.DataFrame) -> None:
        """``lines``: role, starts, code, n.  ``turns``: before (null at the beginning), role, n."""
        self.tables = []
        state = np.array([2 * ROLES.index(r) + (not s) for r, s in zip(lines["role"], lines["starts"])], np.int64)
        weight = lines["n"].to_numpy(float)
        for values, size in zip(_features(lines["code"].to_numpy(np.int64)), _SIZES):
            table = np.full((STATES, size), SMOOTHING)
            np.add.at(table, (state, values), weight)
            if not self.tables:  # the marker: a turn's own one is likely, another's is not, whether or not any was counted
                table[:, :len(ROLES)] += OTHER_MARKER - SMOOTHING
                table[np.arange(0, STATES, 2), np.arange(len(ROLES))] += OWN_MARKER
            elif len(self.tables) in (1, 5):  # turns can begin within a row, even if every counted one began a row
                table[0:STATES:2, 0] = table[0:STATES:2].sum(axis=1) * WITHIN_ROW
            self.tables.append(np.log(table / table.sum(axis=1, keepdims=True)))
        first, change = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
        for before, role, n in zip(turns["before"], turns["role"], turns["n"]):
            if before in ROLES:
                change[ROLES.index(before), ROLES.index(role)] += n
            else:
                first[ROLES.index(role)] += n
        per_state = np.bincount(state, weight, STATES) + 1
        moves = np.full((STATES + 1, STATES + 1), -np.inf)
        moves[START, 0:STATES:2] = np.log(first / first.sum())
        for r in range(len(ROLES)):
            goes_on = per_state[2 * r + 1] / (per_state[2 * r] + per_state[2 * r + 1])
            for s in (2 * r, 2 * r + 1):
                moves[s, 2 * r + 1] = np.log(goes_on)
                moves[s, 0:STATES:2] = np.log((1 - goes_on) * change[r] / change[r].sum())
        self.moves = moves

    def emissions(self, code: np.ndarray) -> np.ndarray:
        """Lines x states; the state before the first line cannot recur."""
        out = np.zeros((len(code), STATES + 1))
        for table, values in zip(self.tables, _features(code)):
            out[:, :STATES] += table.T[values]
        out[:, START] = -np.inf
        return out

    def transfer(self, code: np.ndarray) -> np.ndarray:
        """The best score from each state before the lines to each state of the last line."""
        total = np.where(np.eye(STATES + 1, dtype=bool), 0.0, -np.inf)
        for line in self.emissions(code):
            total = (total[:, :, None] + self.moves[None]).max(axis=1) + line
        return total

    def states(self, code: np.ndarray, entry: int, leave: int | None = None) -> np.ndarray:
        """The best states of the lines, given the state before them and, if known, that of the last line."""
        emitted = self.emissions(code)
        steps = [np.broadcast_to(self.moves + line, self.moves.shape) for line in emitted]
        return best_path(steps, entry, leave)


def best_path(steps: list[np.ndarray], entry: int, leave: int | None = None) -> np.ndarray:
    """Viterbi over matrices of scores from state to state."""
    score = np.full(STATES + 1, -np.inf)
    score[entry] = 0.0
    back = []
    for step in steps:
        total = score[:, None] + step
        back.append(total.argmax(axis=0))
        score = total.max(axis=0)
    state = int(score.argmax()) if leave is None else leave
    out = np.empty(len(steps), np.int64)
    for k in range(len(steps) - 1, -1, -1):
        out[k] = state
        state = int(back[k][state])
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([codes(text) for text in batch])


def train(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Count the lines and the changes of speaker of all rows with a known role.

    The counts have a row per role and feature combination, a bounded number; rows with an unknown or null role count for
    nothing.  The turn before is found by a join on the conversation and the turn's number, which splits long conversations.
    Rows of one number are combined before it: each counts one change, shared among the rows of the number before.
    """
    known = rows.filter(F.col(role).isin(*ROLES)).select(
        F.col(conv_id).alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"))
    lines = known.select("role", F.posexplode(_codes("text")).alias("at", "code")).groupBy(
        "role", (F.col("at") == 0).alias("starts"), "code").agg(F.count("*").alias("n"))
    said = known.groupBy("c", "t").agg(*[F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ROLES])
    before = said.select("c", (F.col("t") + 1).alias("t"), F.struct(*ROLES).alias("before"))
    of_before = {b: F.col(f"before.{b}") / sum(F.col(f"before.{r}") for r in ROLES) for b in ROLES}
    of_before[None] = F.when(F.col("before").isNull(), 1.0)
    pairs = F.array(*[F.struct(F.lit(b).cast("string").alias("before"), F.lit(r).alias("role"), (F.col(r) * share).alias("n"))
                      for b, share in of_before.items() for r in ROLES])
    turns = said.join(before, ["c", "t"], "left").select(F.inline(pairs)).filter("n > 0").groupBy("before", "role").agg(F.sum("n").alias("n"))
    return Model(lines.toPandas(), turns.toPandas())


def rendered(role: str, content: str) -> str:
    """A turn in the canonical form; marks of the form within the content are taken apart."""
    return f"{OPEN}{role}\n{content.replace('<|', '< |')}{CLOSE}\n"


def _turns(text: str | None, states: np.ndarray) -> list[tuple[str, str]]:
    """The turns of a row's lines.  A marker that named the speaker is not part of what was said."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip((text or "").split("\n"), states.tolist()):
        role = ROLES[state // 2]
        found, size = marker(line)
        if state % 2 == 0 or not out:
            out.append((role, [line[size:] if found < len(ROLES) and ROLES[found] == role else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(said).strip()) for role, said in out]


def parse(rows: DataFrame, model: Model, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """One row per recovered turn: (conv_id, turn, part, role, content, rendered).

    The lines of a conversation, in the order of its rows, are decoded together: the result is the best sequence of
    states for the whole conversation.  A conversation of any length is decoded in blocks: the best scores from each state
    before a block to each state after it form a small matrix, matrices are combined block by block in as many levels as
    the turn numbers need, and the states chosen at the borders go back down.  A block of ``BLOCK`` turn numbers that has
    more than ``ROWS_PER_BLOCK`` distinct rows is decoded in cells: ranges of the texts' hashes within a turn number, whose
    matrices are combined first.  So no task holds more than a bounded number of rows together.  ``part`` counts the turns within a row, which has several if markers stand in its text.

    A null or empty text is one empty line; a null turn comes first; a row with a null conv_id is a conversation of its
    own; equal rows are decoded together and each returned; of one turn number, rows go by their text; an empty table
    gives an empty result; a role column and others are ignored.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    said = F.col(text).cast("string")
    own = F.md5(F.coalesce(said, F.lit("")))
    given = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), said.alias("text"), own.alias("h"))
    given = given.groupBy("conv_id", "turn", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    bounds = given.agg(F.min("turn"), F.max("turn")).first()
    low, high = (bounds[0] or 0) - 1, bounds[1] or 0
    given = given.withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row "), "h"))).withColumn(
        "at", F.coalesce(F.col("turn") - low, F.lit(0))).withColumn("block", F.expr(f"at div {BLOCK}"))
    crowded = stored(given.groupBy("c", "block").agg(F.count("*").alias("n")).filter(F.col("n") > ROWS_PER_BLOCK), "crowded")
    most, blocks = crowded.agg(F.max("n"), F.count("*")).first()
    ranges = buckets_for(most or 0, ROWS_PER_BLOCK)
    cell = F.expr(f"at % {BLOCK}") * ranges + fraction_below(F.col("h"), ranges)
    if not blocks:
        given = given.withColumn("cell", F.lit(0).cast("long"))
    elif blocks > BROADCAST_ROWS:  # too many to name: every block is cut
        given = given.withColumn("cell", cell)
    else:
        given = given.join(F.broadcast(crowded), ["c", "block"], "left").withColumn(
            "cell", F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(cell)).drop("n")
    given = given.withColumn("codes", _codes("text"))

    def matrix(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["at", "h"])
        total = sent.value.transfer(np.concatenate(some["codes"].to_list()))
        return pd.DataFrame({"c": [key[0]], "at": [key[1]], "cell": [key[2]], "scores": [total.ravel()]})

    def product(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["at", "cell"])
        total = None
        for scores in some["scores"]:
            step = np.asarray(scores).reshape(STATES + 1, STATES + 1)
            total = step if total is None else (total[:, :, None] + step[None]).max(axis=1)
        return pd.DataFrame({"c": [key[0]], "at": [key[1]], "cell": [key[2]], "scores": [total.ravel()]})

    def choose(key: tuple, border: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["at", "cell"])
        steps = [np.asarray(s).reshape(STATES + 1, STATES + 1) for s in some["scores"]]
        entry, leave = int(border["entry"].iloc[0]), int(border["leave"].iloc[0])
        path = best_path(steps, entry, None if leave < 0 else leave)
        return pd.DataFrame({"c": some["c"], "at": some["at"], "cell": some["cell"], "entry": np.r_[entry, path[:-1]], "leave": path})

    def above(level: DataFrame, cells: bool) -> DataFrame:
        """What is combined goes together: cells of a block, or blocks."""
        at, cell = (F.col("at"), F.expr(f"cell div {BLOCK}")) if cells else (F.expr(f"at div {BLOCK}"), F.lit(0).cast("long"))
        return level.select("*", at.alias("above_at"), cell.alias("above_cell"))

    schema = "c string, at bigint, cell bigint, scores array<double>"
    levels = [given.select("c", "block", "cell", "at", "h", "codes").groupBy("c", "block", "cell").applyInPandas(matrix, schema)]
    if blocks:
        levels[0] = stored(levels[0], "matrices")
    steps, count = [], BLOCK * ranges if blocks else 1
    for cells, count in ((True, count), (False, (high - low) // BLOCK + 1)):
        while count > 1:
            steps.append(cells)
            levels.append(above(levels[-1], cells).groupBy("c", "above_at", "above_cell").applyInPandas(product, schema))
            count = (count - 1) // BLOCK + 1
    zero = F.lit(0).cast("long")
    ends = levels[-1].select("c", zero.alias("at"), zero.alias("cell"), F.lit(START).alias("entry"), F.lit(-1).alias("leave"))
    for level, cells in zip(reversed(levels), [False, *reversed(steps)]):
        ends = ends.groupBy("c", "at", "cell").cogroup(above(level, cells).groupBy("c", "above_at", "above_cell")).applyInPandas(
            choose, "c string, at bigint, cell bigint, entry int, leave int")

    def decode(key: tuple, border: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["at", "h"])
        entry, leave = int(border["entry"].iloc[0]), int(border["leave"].iloc[0])
        states = sent.value.states(np.concatenate(some["codes"].to_list()), entry, leave)
        out, k = [], 0
        for conv, number, said, copies, lines in zip(some["conv_id"], some["turn"], some["text"], some["copies"], some["codes"]):
            found = _turns(said, states[k:k + len(lines)])
            k += len(lines)
            out += [(conv, number, part, role, content, rendered(role, content)) for _ in range(copies) for part, (role, content) in enumerate(found)]
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "part", "role", "content", "rendered"])
        return frame.astype({"conv_id": "Int64", "turn": "Int64"})

    return ends.groupBy("c", "at", "cell").cogroup(given.groupBy("c", "block", "cell")).applyInPandas(
        decode, "conv_id bigint, turn bigint, part int, role string, content string, rendered string")
