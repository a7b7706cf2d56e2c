"""Replace sensitive values by numbered tokens, and put them back.

Rules apply one after the other, each to the output of the one before, so a text is folded over the rule list: a step
finds the matches of its rule, and only where there are any rebuilds the text around numbered tokens.  The fold is a
single expression of built-in functions with literal regexes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import java_regex, once, quoted, rule_regex

MAPPINGS_TYPE = "array<struct<token:string,original:string>>"

# Unicode noncharacters: they mark cut points inside a stage; a text's first unused one is taken.
_MARKS = [chr(0xFDD0 + i) for i in range(8)]


def _unused_mark(text: Column) -> Column:
    """A mark that the text does not hold: a single character, or for a text that holds them all the first one followed
    by one more of the second than the text has in a row."""
    first, second = _MARKS[:2]
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(second + "+"), F.lit(0)), F.length))
    choices = [F.when(~F.contains(text, F.lit(m)), F.lit(m)) for m in _MARKS]
    return F.coalesce(*choices, F.concat(F.lit(first), F.repeat(F.lit(second), longest + 1)))


def _near(words: Sequence[str], window: int) -> str:
    """Zero-width: one of ``words`` lies wholly inside the ``window`` characters before or after this point."""
    parts = []
    for word in words:
        # U+212A lower-cases to k.
        any_case = "".join(r"[kK\u212A]" if c == "k" else f"[{c}{c.upper()}]" for c in word)
        parts.append(rf"(?=(?s:.{{0,{window - len(word)}}}?){any_case})")
        parts.append(rf"(?<=(?={any_case})(?s:.{{1,{window}}}))")
    return f"(?:{'|'.join(parts)})"


def _context_regex(rule: R.PiiRule) -> str:
    """Group 1 holds an accepted match; a match without context is consumed too but leaves group 1 empty."""
    if re.compile(rule.pattern).groups:
        raise ValueError(f"rule {rule.category}: use non-capturing groups in a pattern with context")
    body = f"(?{'i' if rule.ignore_case else ''}:{java_regex(rule.pattern)})"
    return f"(?={body})(?:({_near(rule.context, R.CONTEXT_WINDOW)}{body})|{body})"


# Steps are written as SQL text: one call into the JVM, where building nested lambdas from Python takes hundreds.


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _pieces(regex: str, lead: bool, around: bool) -> str:
    """The text between the matches.  Splitting at a single character avoids compiling the regex for every row."""
    marked = f"regexp_replace({'w' if around else 's.t'}, {quoted(regex)}, {chr(39) + '$1' + chr(39) + ' || ' if lead else ''}_mark)"
    if around:
        marked = f"array_join(zip_with(split({marked}, ' ', -1), concat(apart, array('')), (m, x) -> concat(m, x)), '')"
    return f"split({marked}, _mark, -1)"


# A text around a character: cut at the character, each piece keeps what is next to it, up to a space.  What lies between is
# set apart, and one space stands for it.


def _held(x: str, k: str, parts: str) -> str:
    before, after = f"if({k} = 0, '', substring_index({x}, ' ', 1))", f"if({k} = size({parts}) - 1, '', substring_index({x}, ' ', -1))"
    return f"if(contains({x}, ' '), concat({before}, ' ', {after}), {x})"


def _around(character: str) -> str:
    """The stretches of ``s.t`` without spaces that hold the character; there is one at least."""
    return _let("parts", f"split(s.t, {quoted(re.escape(character))}, -1)", f"array_join(transform(parts, (x, k) -> {_held('x', 'k', 'parts')}), {quoted(character)})")


def _let_apart(character: str, body: str) -> str:
    """``body`` with ``apart`` bound to what ``_around`` has left out, in order."""
    cut = ("substr(x, if(k = 0, 1, 1 + char_length(substring_index(x, ' ', 1))), char_length(x) - if(k = 0, 0, char_length(substring_index(x, ' ', 1)))"
           " - if(k = size(parts) - 1, 0, char_length(substring_index(x, ' ', -1))))")
    apart = _let("parts", f"split(s.t, {quoted(re.escape(character))}, -1)", f"filter(transform(parts, (x, k) -> if(contains(x, ' '), {cut}, null)), x -> x is not null)")
    return _let("apart", apart, body)


def _interleaved(separators: str, pieces: str) -> str:
    return f"array_join(zip_with(concat(array(''), {separators}), {pieces}, (m, x) -> concat(m, x)), '')"


def _step(rule: R.PiiRule, try_it: str, continued: bool, pseudonym: str | None) -> str:
    """One rule as an expression of the state ``s``: its text ``s.t`` and its mappings ``s.m``."""
    if rule.around and rule.context:
        raise ValueError(f"rule {rule.category}: a rule with context looks further than a space")
    regex = rule_regex(rule)
    # Numbers go on where an earlier rule with the same token stopped.
    before = f"size(filter(s.m, e -> startswith(e.token, '[{rule.token}_')))" if continued else "0"
    lead = rule.lead is not None
    pieces = _pieces(regex, lead, bool(rule.around))
    if rule.context:
        cuts = "zip_with(a, ok, (m, k) -> if(k != '', _mark, m))"
        pieces = f"split({_interleaved(cuts, pieces)}, _mark, -1)"
    if pseudonym:
        text, mappings = _interleaved(f"transform(f, x -> {pseudonym})", pieces), "s.m"
    else:
        text = (f"array_join(transform({pieces}, (x, n) -> "
                f"if(n = 0, x, concat('[{rule.token}_', n + {before}, ']', x))), '')")
        mappings = (f"concat(s.m, transform(f, (x, n) -> "
                    f"struct(concat('[{rule.token}_', n + 1 + {before}, ']') as token, x as original)))")
    rebuilt = f"struct({text} as t, {mappings} as m)"
    if not rule.around:
        rebuilt = f"if(size(f) > 0, {rebuilt}, s)"
    if rule.around:
        found = _let("f", f"regexp_extract_all(w, {quoted(regex)}, {2 * lead})", f"if(size(f) > 0, {_let_apart(rule.around, rebuilt)}, s)")
        return f"if({try_it} and contains(s.t, {quoted(rule.around)}), {_let('w', _around(rule.around), found)}, s)"
    if not rule.context:
        return f"if({try_it}, {_let('f', f'regexp_extract_all(s.t, {quoted(regex)}, {2 * lead})', rebuilt)}, s)"
    whole = quoted(_context_regex(rule))
    accepted = _let("ok", f"regexp_extract_all(s.t, {whole}, 1)", _let("f", "array_remove(ok, '')", rebuilt))
    found = _let("a", f"regexp_extract_all(s.t, {whole}, 0)", f"if(size(a) > 0, {accepted}, s)")
    return f"if({try_it}, {found}, s)"


def _applies(rule: R.PiiRule, lowered: Column, tokens: Sequence[str] = ()) -> Column:
    """Whether a text, before any of ``tokens`` came into it, can hold a match."""
    applies = F.contains(lowered, F.lit(rule.hint)) if rule.hint else F.lit(True)
    if not rule.context or any(word in token.lower() for word in rule.context for token in tokens):
        return applies
    near = F.lit(False)
    for word in rule.context:
        near = near | F.contains(lowered, F.lit(word))
    return applies & near


def any_token_regex(rules: Sequence[R.PiiRule]) -> str:
    names = "|".join(re.escape(t) for t in dict.fromkeys(r.token for r in rules))
    return rf"\[(?:{names})_\d+\]"


def redact(
    df: DataFrame,
    text: str = "content",
    rules: Sequence[R.PiiRule] = R.PII_RULES,
    redacted: str = "content_redacted",
    mappings: str = "mappings",
    pseudonym: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``redacted``, ``mappings`` (token and original, in order of replacement) and ``token_collision``.

    ``token_collision`` tells that the input already held text that looks like a token, so restoring is ambiguous.
    ``pseudonym`` maps a category to an SQL expression of the match ``x`` (see ``governance.pseudonymize``); such matches
    are replaced by its value instead of a numbered token and leave no mapping.
    """
    pseudonym = pseudonym or {}
    kept = df.columns
    prepared = df.withColumn("_text", F.col(text)).withColumn("_lower", F.lower(text))
    # A token never contains a hint, so hints can all be looked up once, on the input.
    prepared = prepared.select(
        *kept, "_text", _unused_mark(F.col("_text")).alias("_mark"),
        *[_applies(r, F.col("_lower"), [earlier.token for earlier in rules[:i]]).alias(f"_try{i}") for i, r in enumerate(rules)])

    tokens = [r.token for r in rules if r.category not in pseudonym]
    steps = [f"when {i} then " + _step(r, f"_try{i}", tokens.count(r.token) > 1, pseudonym.get(r.category))
             for i, r in enumerate(rules)]
    start = f"struct(_text as t, cast(array() as {MAPPINGS_TYPE}) as m)"
    folded = (f"aggregate(sequence(0, {len(rules) - 1}), {start}, (s, i) -> case i {' '.join(steps)} else s end)"
              if rules else start)
    done = prepared.select(*kept, F.expr(folded).alias("_done"))
    collision = F.contains(F.col(text), F.lit("[")) & F.rlike(F.col(text), F.lit(any_token_regex(rules)))
    return once(done, kept, **{
        redacted: F.col("_done.t"),
        mappings: F.when(F.col(text).isNotNull(), F.col("_done.m")),
        "token_collision": collision if rules else F.lit(False),
    })


def redact_contextual(df: DataFrame, text: str = "content", rules: Sequence[R.PiiRule] = R.CONTEXT_RULES,
                      **names) -> DataFrame:
    """The second pass alone: rules that need a context word near the match."""
    return redact(df, text, rules, **names)


def redact_legacy(df: DataFrame, text: str = "content", **names) -> DataFrame:
    """The older pack followed by its contextual pass; token names of the two passes are disjoint."""
    return redact(df, text, R.PII_RULES_LEGACY + R.CONTEXT_RULES, **names)


def rehydrated(text: Column, mappings: Column, newest_first: bool = False) -> Column:
    """Replace every token by its original, literally, in mapping order.

    ``newest_first`` goes through the mappings backwards, which also restores tokens swallowed by a later match: with
    packs in which a rule's pattern can match a token, or a part of one, it is needed.
    """
    ordered = F.reverse(mappings) if newest_first else mappings
    return F.aggregate(F.coalesce(ordered, F.array().cast(MAPPINGS_TYPE)), text,
                       lambda acc, e: F.replace(acc, e["token"], e["original"]))


def pii_token_count(mappings: Column) -> Column:
    return F.coalesce(F.size(mappings), F.lit(0))


def categories(mappings: Column, rules: Sequence[R.PiiRule] = R.PII_RULES) -> Column:
    """The category of every mapping."""
    by_token = F.create_map(*[F.lit(v) for r in rules for v in (r.token, r.category)])
    return F.transform(mappings, lambda e: F.element_at(
        by_token, F.regexp_extract(e["token"], r"^\[(.+)_\d+\]$", 1)))


def pii_inventory(df: DataFrame, by: Sequence[str] = (), mappings: str = "mappings",
                  rules: Sequence[R.PiiRule] = R.PII_RULES) -> DataFrame:
    """Tokens per category: over the corpus, or per value of ``by`` (for example ``case_id``)."""
    return (df.select(*by, F.explode(categories(F.col(mappings), rules)).alias("category"))
            .groupBy(*by, "category").agg(F.count("*").alias("tokens")))
