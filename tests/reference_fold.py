"""Brute-force versions of the text operators in plain Python, for small inputs only."""

from __future__ import annotations

import re

from caseflow import rules as R

SPACE = ("\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))


def compiled(pattern: str, ignore_case: bool) -> re.Pattern:
    out, in_class, i = "", False, 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        atom = pattern[i:i + step]
        if atom == r"\s":
            atom = SPACE if in_class else f"[{SPACE}]"
        elif atom == "." and not in_class:
            atom = "[^\n\r\u2028\u2029]"
        elif atom in ("[", "]"):
            in_class = atom == "["
        out += atom
        i += step
    return re.compile(out, re.ASCII | (re.IGNORECASE if ignore_case else 0))


def redact(text: str, rules) -> tuple[str, list[tuple[str, str]]]:
    counts: dict[str, int] = {}
    mappings = []
    for rule in rules:
        before = text

        def replace(match, rule=rule, shift=[0], before=before):
            if rule.context:
                # Where the match stands in the text as rewritten so far is not needed: the window is on ``before``.
                at = match.start()
                near = before[max(0, at - R.CONTEXT_WINDOW):at + R.CONTEXT_WINDOW].lower()
                if not any(w in near for w in rule.context):
                    return match.group(0)
            counts[rule.token] = counts.get(rule.token, 0) + 1
            token = f"[{rule.token}_{counts[rule.token]}]"
            mappings.append((token, match.group(0)))
            return token

        text = compiled(rule.pattern, rule.ignore_case).sub(replace, text)
    return text, mappings


def compress(text: str) -> str:
    kept, counts = [], {}
    for line in text.split("\n"):
        key = re.sub(R.LOG_TIMESTAMP, "[TIMESTAMP]", line, count=1, flags=re.ASCII)
        key = re.sub(R.LOG_THREAD, "[TID]", key, count=1, flags=re.ASCII)
        counts[key] = counts.get(key, 0) + 1
        if counts[key] == 1:
            kept.append(line)
    repeated = [f"[REPEATED {n}x] {key[:100]}..." for key, n in counts.items() if n > 1]
    return "\n".join(kept + ([R.REPEATED_HEADER] if repeated else []) + repeated)


def changed(rows: list[tuple]) -> list[tuple]:
    """(source, order, text) rows that differ from the previous non-empty text of the source."""
    last, out = {}, []
    for source, order, text in sorted(rows, key=lambda r: r[1]):
        if text and last.get(source) != text:
            out.append((source, order, text))
        if text:
            last[source] = text
    return out
