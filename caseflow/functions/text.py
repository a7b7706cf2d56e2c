"""Text helpers: ECMAScript regex semantics on Spark's Java regexes, trimming and line handling."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The members of ECMAScript \s; Java's \s is ASCII only.  Usable inside a character class.
BLANK = r" \t\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = r"\n" + BLANK
SPACE_CHARS = "\n \t\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff")
NOT_EOL = r"[^\n\r\u2028\u2029]"
LINE_START = rf"(?<!{NOT_EOL})"
# Java's \b follows Unicode letters, ECMAScript's is ASCII.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# A pattern that surely starts / ends with a word character needs only a one-sided boundary.
_STARTS_WORD = re.compile(r"(\(\?:)?(\w|\\d|\[(?:\w-\w)+\])")
_ENDS_WORD = re.compile(r"(?:(?<!\\)\w|\\d(?:\{[^}]*\})?|\[(?:\w-\w)+\](?:\+|\{[^}]*\})?)$")


def _word_boundary(before: str, after: str) -> str:
    r"""``\b`` between two pattern texts.

    Looking at what must follow comes first where that is cheap: it fails at nearly every position of a text.
    """
    word = _STARTS_WORD.match(after)
    if word:
        group, atom = word.groups()
        common = atom.startswith("[") and "a-z" in atom  # most characters of a text would pass
        peek = "" if common or (group and "|" in after) else f"(?={atom})"
        return peek + r"(?<!\w)"
    if _ENDS_WORD.search(before):
        return r"(?!\w)"
    return BOUNDARY


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    r"""The Java regex that matches what ``pattern`` matches in ECMAScript.

    Replaces ``\s``, ``\b``, ``.`` and ``^`` (a line start), the constructs on which the dialects differ.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        atom = pattern[i:i + step]
        if atom == r"\s":
            atom = SPACE if in_class else f"[{SPACE}]"
        elif not in_class and atom == r"\b":
            atom = _word_boundary(pattern[:i], pattern[i + 2:])
        elif not in_class and atom == ".":
            atom = NOT_EOL
        elif not in_class and atom == "^":
            atom = LINE_START
        elif atom == "[":
            in_class = True
        elif atom == "]":
            in_class = False
        out.append(atom)
        i += step
    return ("(?i)" if ignore_case else "") + "".join(out)


def rule_regex(rule) -> str:
    """The Java regex of a rule.  With a ``lead`` the match itself is group 2 and group 1 stands before it."""
    if getattr(rule, "java", ""):
        return rule.java
    if getattr(rule, "lead", None) is not None:
        return ("(?i)" if rule.ignore_case else "") + f"({rule.lead})({java_regex(rule.pattern)})"
    return java_regex(rule.pattern, rule.ignore_case)


def quoted(value: str) -> str:
    """``value`` as an SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def over(function: str, *args: Column | str) -> Column:
    """Call a function some of whose arguments are lambdas, given as SQL text.

    Building a lambda from Python takes dozens of calls into the JVM, from text it takes one; the plan is the same.
    """
    return F.call_function(function, *[F.expr(a) if isinstance(a, str) else a for a in args])


def trim(text: Column) -> Column:
    """Strip every ECMAScript blank from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def lines(text: Column) -> Column:
    """Trimmed, non-empty lines as an array."""
    trimmed = F.transform(F.split(text, "\n", -1), trim)
    return F.array_remove(trimmed, "")


def trimmed_lines(text: Column) -> Column:
    """The trimmed, non-empty lines joined by newlines, for regexes that look at whole lines."""
    return F.array_join(lines(text), "\n")


def word_count(text: Column) -> Column:
    r"""Number of pieces after splitting on blank runs; blanks at an end count as one empty piece.

    Java's ``\s`` is several times faster than the full class.  A text that may hold other blanks gets spaces for them first.
    """
    spaced = F.when(F.rlike(text, F.lit(r"[\u00A0\u1680-\uFEFF]")), F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))).otherwise(text)
    return F.size(F.split(spaced, r"\s+", -1))


def extract(text: Column, regex: str, group: int = 0) -> Column:
    """First match, or NULL where there is none or it is empty; the regex runs once."""
    return F.get(F.filter(F.array(F.regexp_extract(text, regex, group)), lambda x: x != ""), 0)


def extract_all(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def shorten(text: Column, size: int, always: bool = False) -> Column:
    """First ``size`` characters; ``...`` follows if the text is longer, or always."""
    head = F.substring(text, 1, size)
    if always:
        return F.concat(head, F.lit("..."))
    return F.when(F.length(text) > size, F.concat(head, F.lit("..."))).otherwise(head)


def iso_instant(ts: Column) -> Column:
    """A timestamp as UTC text with milliseconds, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def once(df, keep: list[str], **computed: Column):
    """Select ``keep`` plus ``computed`` so that each computed column is evaluated exactly once.

    A filter or projection above a plain select is rewritten in terms of the select's input; over a chain of regex stages
    that copies every stage twice per level.  Reading the columns back from a one-element generator stops the rewriting
    and moves no data.
    """
    values = df.select(*keep, *[c.alias(f"_once_{name}") for name, c in computed.items()])
    packed = F.struct(*[F.col(f"_once_{name}").alias(name) for name in computed])
    return values.select(*keep, F.inline(F.array(packed)))
