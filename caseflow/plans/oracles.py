"""The same results in plain SQL, for a second engine to check the registered queries against.

Its regex dialect has an ASCII word boundary but no look-around, and its list functions count from 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from .. import rules as R
from ..operators import recall
from . import corpus
from . import queries as Q

BLANK = r" \t\v\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE = r"\n" + BLANK
NOT_EOL = r"[^\n\r\x{2028}\x{2029}]"


def re2(pattern: str, ignore_case: bool = False) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        atom = pattern[i:i + step]
        if atom == r"\s":
            atom = SPACE if in_class else f"[{SPACE}]"
        elif atom == "." and not in_class:
            atom = NOT_EOL
        elif atom == "^" and not in_class:
            atom = "(?m:^)"
        elif atom in "[]":
            in_class = atom == "["
        out.append(atom)
        i += step
    return ("(?i)" if ignore_case else "") + "".join(out)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regex(rule) -> str:
    return text(re2(rule.pattern, rule.ignore_case))


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def lines(c: str) -> str:
    return (f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')")


def summary(c: str) -> str:
    return (f"coalesce(list_filter({lines(c)}, lambda l: length(l) > {R.SUMMARY_MIN_LENGTH} "
            f"AND NOT starts_with(l, '{R.SUMMARY_SKIP_PREFIX}') AND NOT contains(l, '{R.SUMMARY_SKIP_TEXT}'))[1], "
            f"'{R.NO_SUMMARY}')")


def case_id(c: str, detected_first: bool = False) -> str:
    found = ", ".join(f"nullif(regexp_extract({c}, {regex(r)}), '')" for r in R.CASE_ID_RULES)
    known = f"{found}, given_case_id" if detected_first else f"given_case_id, {found}"
    return f"coalesce({known}, 'CASE-' || md5(source || '|' || CAST(ingest_seq AS VARCHAR) || '|' || {c}))"


def joined(values: str) -> str:
    return f"array_to_string({values}, '|')"


def environment(c: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_extract({c}, {regex(r)}, 1) <> '' THEN '{r.name}=' || "
                      f"{trim(f'regexp_extract({c}, {regex(r)}, 1)')} END" for r in R.ENVIRONMENT_RULES)
    return joined(f"list_sort(list_filter([{parts}], lambda x: x IS NOT NULL))")


def symptom_list(c: str) -> str:
    found = "[]"
    for r in R.SYMPTOM_RULES:
        found = f"list_concat({found}, regexp_extract_all({c}, {regex(r)}, 1))"
    return f"list_filter(list_transform({found}, lambda x: {trim('x')}), lambda x: length(x) > {R.MIN_SYMPTOM_LENGTH})"


def distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def error_list(c: str) -> str:
    words = "|".join(R.ERROR_WORDS)
    first = f"(list_filter({lines(c)}, lambda l: regexp_matches(l, '{words}')))[1:{R.MAX_ERROR_LINES}]"
    return distinct(first)


def tag_list(c: str, rules=R.TAG_RULES) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({c}, {regex(r)}) THEN '{r.name}' END" for r in rules)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def word_count(c: str) -> str:
    return f"CAST(length(string_split_regex({c}, '[{SPACE}]+')) AS BIGINT)"


# Redaction: one materialised step per rule --------------------------------------------------------------------------

LEAD = f"raw AS MATERIALIZED ({corpus.SQL})"


def _plain_step(rule, i: int, source: str) -> str:
    return f"""r{i} AS MATERIALIZED (
  SELECT * EXCLUDE (t, m, sp), m AS m{i}, array_to_string(list_transform(sp, lambda x, k:
      CASE WHEN k = 1 THEN x ELSE '[{rule.token}_' || CAST(k - 1 AS VARCHAR) || ']' || x END), '') AS t
  FROM (SELECT *, regexp_extract_all(t, {regex(rule)}) AS m, string_split_regex(t, {regex(rule)}) AS sp
        FROM {source}))"""


def _context_step(rule, i: int, source: str) -> str:
    words, w = "|".join(rule.context), R.CONTEXT_WINDOW
    return f"""r{i} AS MATERIALIZED (
  SELECT * EXCLUDE (t, a, sp, lens, offs, ok, num), list_filter(a, lambda x, k: ok[k] = 1) AS m{i},
    array_to_string(list_transform(sp, lambda x, k: CASE WHEN k = 1 THEN x WHEN ok[k - 1] = 1
      THEN '[{rule.token}_' || CAST(num[k - 1] AS VARCHAR) || ']' || x ELSE a[k - 1] || x END), '') AS t
  FROM (SELECT *, list_transform(ok, lambda x, k: CAST(list_sum(ok[1:k]) AS BIGINT)) AS num
  FROM (SELECT *, list_transform(offs, lambda o: CASE WHEN regexp_matches(lower(substring(t, greatest(o - {w}, 0) + 1,
      o + {w} - greatest(o - {w}, 0))), '{words}') THEN 1 ELSE 0 END) AS ok
  FROM (SELECT *, list_transform(a, lambda x, k: CAST(list_sum(lens[1:2 * k - 1]) AS BIGINT)) AS offs
  FROM (SELECT *, flatten(list_transform(sp, lambda x, k: [length(x), coalesce(length(a[k]), 0)])) AS lens
  FROM (SELECT *, regexp_extract_all(t, {regex(rule)}) AS a, string_split_regex(t, {regex(rule)}) AS sp
        FROM {source}))))))"""


def redaction(rules: Sequence[R.PiiRule] = R.PII_RULES, source: str = "raw") -> str:
    """CTEs ending in ``red(source, ingest_seq, content, t, mappings, collision)``."""
    steps = [f"start AS (SELECT *, content AS t FROM {source})"]
    before = "start"
    for i, rule in enumerate(rules):
        steps.append((_context_step if rule.context else _plain_step)(rule, i, before))
        before = f"r{i}"
    entries = "[]"
    for i, rule in enumerate(rules):
        entries = (f"list_concat({entries}, list_transform(m{i}, lambda x, k: {{'token': '[{rule.token}_' || "
                   f"CAST(k AS VARCHAR) || ']', 'original': x}}))")
    names = "|".join(r.token for r in rules)
    steps.append(f"red AS MATERIALIZED (SELECT source, ingest_seq, given_case_id, content, t, {entries} AS mappings, "
                 f"regexp_matches(content, '\\[(?:{names})_\\d+\\]') AS collision FROM {before})")
    return ",\n".join(steps)


# Replace the tokens one after the other; the text travels in the "original" field.
RESTORED = """list_reduce(list_prepend({'token': '', 'original': t}, mappings), lambda a, e:
  {'token': '', 'original': replace(a.original, e.token, e.original)}).original"""
FLAT_MAPPINGS = joined("list_transform(mappings, lambda e: e.token || '=' || e.original)")


def _redacted_query(rules, columns: str) -> str:
    return f"WITH {LEAD},\n{redaction(rules)}\nSELECT ingest_seq, {columns} FROM red"


# Cases --------------------------------------------------------------------------------------------------------------

# Fields come from the redacted text, id, tags and word count from the raw one.
CASES = f"""cases AS MATERIALIZED (
  SELECT {case_id('content')} AS case_id, ingest_seq, {summary('t')} AS summary, {symptom_list('t')} AS symptoms,
    {environment('t')} AS environment, {error_list('t')} AS error_patterns, {tag_list('content')} AS tags,
    t AS content_redacted, {word_count('content')} AS word_count FROM red)"""
VAULT = f"""vault AS MATERIALIZED (
  SELECT {case_id('content')} AS case_id, ingest_seq, mappings FROM red WHERE len(mappings) > 0)"""
CURRENT = """cur AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ingest_seq DESC) AS rn,
    min(ingest_seq) OVER (PARTITION BY case_id) AS first_seq FROM cases) WHERE rn = 1)"""
IDS = f"ids AS MATERIALIZED (SELECT {case_id('content')} AS case_id, ingest_seq, content FROM raw)"
CURRENT_IDS = """cur AS (SELECT case_id, max(ingest_seq) AS ingest_seq, min(ingest_seq) AS first_seq
  FROM ids GROUP BY case_id)"""
REQUESTS = """wanted AS (SELECT doc_id AS pos, 'ICM-' || CAST(600000000 + doc_id - doc_id % 2 AS VARCHAR) AS case_id
  FROM labels)"""
WITH_RED = f"WITH {LEAD},\n{redaction()}"
WITH_CASES = f"{WITH_RED},\n{CASES},\n{CURRENT}"


def _hit(field: str, phrase: str) -> str:
    if field in ("summary", "content_redacted"):
        return f"CASE WHEN contains(lower({field}), {phrase}) THEN 1 ELSE 0 END"
    return f"len(list_filter({field}, lambda x: contains(lower(x), {phrase})))"


def scored(phrase: str, accumulate: bool = False, source: str = "cur", extra: str = "") -> str:
    fields = {"summary": "summary", "symptoms": "symptoms", "errors": "error_patterns", "tags": "tags",
              "content": "content_redacted"}
    hits = {n: _hit(f, phrase) if accumulate else f"least({_hit(f, phrase)}, 1)" for n, f in fields.items()}
    score = " + ".join(f"h_{n} * {w}" for n, w in R.SEARCH_WEIGHTS)
    names = ", ".join(f"CASE WHEN h_{n} > 0 THEN '{n}' END" for n, _ in R.SEARCH_WEIGHTS)
    return (f"SELECT *, CAST({score} AS BIGINT) AS score, list_filter([{names}], lambda x: x IS NOT NULL) AS matches "
            f"FROM (SELECT *{extra}, " + ", ".join(f"{h} AS h_{n}" for n, h in hits.items()) + f" FROM {source})")


HITS = f"case_id, score, {joined('matches')} AS matches, summary, {joined('tags')} AS tags, first_seq"
CONTEXT = f"""case_id, summary, {joined('symptoms[1:3]')} AS symptoms, environment,
  {joined('error_patterns[1:3]')} AS key_errors, {joined('tags')} AS tags,
  substr(content_redacted, 1, 500) || CASE WHEN length(content_redacted) > 500 THEN '...' ELSE '' END
  AS content_preview"""


def _found(phrase: str, limit: int, accumulate: bool = False) -> str:
    return f"found AS MATERIALIZED (SELECT * FROM ({scored(text(phrase), accumulate)}) WHERE score > 0 " \
           f"ORDER BY score DESC, first_seq LIMIT {limit})"


def _batch(phrases) -> str:
    """The best cases of each phrase."""
    return f"""{WITH_CASES},
phrases(query_no, query) AS (VALUES {', '.join(f'({i}, {text(q)})' for i, q in enumerate(phrases))})
SELECT CAST(query_no AS BIGINT) AS query_no, query, CAST(rank AS BIGINT) AS rank, {HITS} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, first_seq) AS rank
  FROM ({scored('lower(query)', source='cur, phrases')}) WHERE score > 0) WHERE rank <= {Q.BATCH_LIMIT}"""


def _raw_query(columns: str) -> str:
    return f"WITH {LEAD}\nSELECT ingest_seq, {columns} FROM raw"


def _flat_case(c: str, tag_rules=R.TAG_RULES, detected_first: bool = False) -> str:
    return (f"{case_id('content', detected_first)} AS case_id, {summary(c)} AS summary, {joined(symptom_list(c))} AS symptoms, "
            f"{environment(c)} AS environment, {joined(error_list(c))} AS error_patterns, "
            f"{joined(tag_list('content', tag_rules))} AS tags, {word_count('content')} AS word_count")


def _detected(c: str) -> str:
    found = "[]"
    for r in R.DETECT_ID_RULES:
        found = f"list_concat({found}, regexp_extract_all({c}, {regex(r)}))"
    return distinct(found)


NORMAL = "regexp_replace(regexp_replace(x, '{}', '[TIMESTAMP]'), '{}', '[TID]')".format(R.LOG_TIMESTAMP, R.LOG_THREAD)
LINES = f"""lines AS MATERIALIZED (SELECT ingest_seq, pos, x AS line, {NORMAL} AS key FROM (
  SELECT ingest_seq, unnest(string_split(content, chr(10))) AS x,
    generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM raw))"""

COMPRESSED = f"""keys AS (SELECT ingest_seq, key, min(pos) AS pos, arg_min(line, pos) AS line, count(*) AS n
  FROM lines GROUP BY ingest_seq, key),
compressed AS MATERIALIZED (SELECT ingest_seq, string_agg(line, chr(10) ORDER BY pos) || CASE WHEN max(n) > 1 THEN
  chr(10) || '{R.REPEATED_HEADER}' || chr(10) || string_agg('[REPEATED ' || CAST(n AS VARCHAR) || 'x] ' ||
  substr(key, 1, {R.REPEATED_KEY_CHARS}) || '...', chr(10) ORDER BY pos) FILTER (WHERE n > 1) ELSE '' END
  AS content_compressed FROM keys GROUP BY ingest_seq)"""

DISCUSSION = text(re2(R.DISCUSSION_PATTERN))

def discussion(c: str) -> str:
    return joined(f"list_transform(regexp_extract_all({c}, {DISCUSSION}, 1), lambda a, i: {trim('a')} || '@' || "
                  f"{trim(f'regexp_extract_all({c}, {DISCUSSION}, 2)[i]')})")


ORACLES: dict[str, str] = {
    "parse_lines": _raw_query(f"{joined(lines('content'))} AS lines"),
    "parse_summary": _raw_query(f"{summary('content')} AS summary"),
    "parse_case_id": _raw_query(f"{case_id('content')} AS case_id"),
    "parse_case_id_legacy": _raw_query(f"{case_id('content', detected_first=True)} AS case_id"),
    "parse_environment": _raw_query(f"{environment('content')} AS environment"),
    "parse_symptoms": _raw_query(f"{joined(symptom_list('content'))} AS symptoms"),
    "parse_errors": _raw_query(f"{joined(error_list('content'))} AS error_patterns"),
    "parse_tags": _raw_query(f"{joined(tag_list('content'))} AS tags"),
    "parse_tags_legacy": _raw_query(f"{joined(tag_list('content', R.TAG_RULES_LEGACY))} AS tags"),
    "parse_word_count": _raw_query(f"{word_count('content')} AS word_count"),
    "parse_discussion": _raw_query(f"{discussion('content')} AS discussion"),
    "detect_case_ids": _raw_query(f"{joined(_detected('content'))} AS case_ids"),
    "valid_content": "SELECT conv_id, turn FROM (SELECT conv_id, turn, role || ': ' || text AS said FROM conversations) "
                     f"WHERE length(said) >= {R.MIN_CONTENT_LENGTH} AND ("
                     + " OR ".join(f"regexp_matches(said, {regex(r)})" for r in R.CONTENT_INDICATORS) + ")",
    "content_hash": _raw_query("md5(content) AS content_md5"),
    "reject_blank": f"SELECT conv_id, count(*) AS turns FROM conversations WHERE {trim('text')} <> '' GROUP BY conv_id",
    "parse_case": _raw_query(_flat_case("content")),
    "ingest_cases": f"{WITH_RED}\nSELECT ingest_seq, {_flat_case('t')} FROM red",
    "case_counts": f"""{WITH_RED}
SELECT {case_id('content')} AS case_id, ingest_seq, CAST(len({symptom_list('t')}) AS BIGINT) AS n_symptoms,
  CAST(len({error_list('t')}) AS BIGINT) AS n_errors, CAST(len(mappings) AS BIGINT) AS n_tokens FROM red""",
    "compress_logs": f"""WITH {LEAD}, {LINES}, {COMPRESSED}
SELECT ingest_seq, content_compressed FROM compressed""",
    "log_pattern_counts": f"""WITH {LEAD}, {LINES}, {IDS}
SELECT key AS pattern, count(*) AS occurrences, count(DISTINCT case_id) AS cases
FROM lines JOIN ids USING (ingest_seq) GROUP BY key""",
    "redact_text": _redacted_query(R.PII_RULES, "t AS content_redacted, collision AS token_collision"),
    "redact_mappings": _redacted_query(
        R.PII_RULES, f"CAST(len(mappings) AS BIGINT) AS tokens, {FLAT_MAPPINGS} AS mappings"),
    "redact_legacy_pack": _redacted_query(
        R.PII_RULES_LEGACY, f"t AS content_redacted, {FLAT_MAPPINGS} AS mappings"),
    "redact_contextual": _redacted_query(R.CONTEXT_RULES, f"t AS content_redacted, {FLAT_MAPPINGS} AS mappings"),
    "redact_legacy": _redacted_query(
        R.PII_RULES_LEGACY + R.CONTEXT_RULES, f"t AS content_redacted, {FLAT_MAPPINGS} AS mappings"),
    "redact_extended_pack": _redacted_query(
        R.PII_RULES_EXTENDED, f"t AS content_redacted, {FLAT_MAPPINGS} AS mappings"),
    "rehydrate_roundtrip": _raw_query("content") + " WHERE NOT regexp_matches(content, '\\[(?:"
                           + "|".join(r.token for r in R.PII_RULES) + ")_\\d+\\]')",
    "current_cases": f"{WITH_CASES}\nSELECT case_id, ingest_seq, first_seq, summary, content_redacted FROM cur",
    "current_vault": f"""{WITH_RED},\n{VAULT}
SELECT case_id, max(ingest_seq) AS ingest_seq, arg_max({FLAT_MAPPINGS}, ingest_seq) AS mappings
FROM vault GROUP BY case_id""",
    "cases_without_pii": f"""{WITH_RED},\n{VAULT},\n{IDS},\n{CURRENT_IDS}
SELECT case_id, first_seq FROM cur WHERE case_id NOT IN (SELECT case_id FROM vault)""",
    "cases_with_pii": f"""{WITH_RED},\n{VAULT},\n{IDS},\n{CURRENT_IDS}
SELECT case_id, first_seq FROM cur WHERE case_id IN (SELECT case_id FROM vault)""",
    "get_cases": f"""{WITH_CASES},\n{REQUESTS}
SELECT case_id, ingest_seq, summary, {joined('tags')} AS tags FROM cur
WHERE case_id IN (SELECT case_id FROM wanted)""",
    "case_with_vault": f"""{WITH_CASES},\n{VAULT}
SELECT cur.case_id, cur.ingest_seq, cur.summary, {FLAT_MAPPINGS} AS mappings
FROM cur LEFT JOIN vault ON cur.case_id = vault.case_id AND cur.ingest_seq = vault.ingest_seq""",
    "get_full": f"""{WITH_CASES},\n{REQUESTS}
SELECT cur.case_id, cur.ingest_seq, CASE WHEN len(red.mappings) > 0 THEN {RESTORED} END AS content_full
FROM cur JOIN red USING (ingest_seq) WHERE cur.case_id IN (SELECT case_id FROM wanted)""",
    "content_dedupe": """SELECT min(doc_id) AS ingest_seq, md5(text) AS content_md5, count(*) AS copies
FROM documents GROUP BY text""",
    "changed_only": """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS before FROM events WHERE event_type <> '')
WHERE before IS DISTINCT FROM event_type""",
    "search_scores": f"{WITH_CASES}\nSELECT {HITS} FROM ({scored(text(Q.SEARCH_PHRASE))})",
    "search_topk": f"{WITH_CASES},\n{_found(Q.SEARCH_PHRASE, 10)}\nSELECT {HITS} FROM found",
    "search_accumulate": f"{WITH_CASES},\n{_found('socket', 10, True)}\nSELECT {HITS} FROM found",
    "search_batch": _batch(Q.BATCH_PHRASES),
    "search_indexed": _batch(Q.INDEX_PHRASES),
    "case_context": f"{WITH_CASES}\nSELECT first_seq AS pos, {CONTEXT} FROM cur",
    "export_context": f"{WITH_CASES},\n{REQUESTS}\nSELECT pos, {CONTEXT} FROM wanted JOIN cur USING (case_id)",
    "context_pack": f"""{WITH_CASES},\n{_found(Q.SEARCH_PHRASE, 10)},
ctx AS (SELECT score, first_seq, {CONTEXT} FROM found)
SELECT 'support_cases' AS context_type, count(*) AS total_cases, '2024-01-01T00:00:00.000Z' AS generated_at,
  string_agg(case_id, '|' ORDER BY score DESC, first_seq) AS case_ids,
  string_agg(content_preview, '|' ORDER BY score DESC, first_seq) AS previews FROM ctx""",
    "render_search": f"""{WITH_CASES},\n{_found(Q.SEARCH_PHRASE, 5)}
SELECT 'Found ' || CAST(count(*) AS VARCHAR) || ' similar cases for: "{Q.SEARCH_PHRASE}"' || chr(10) || chr(10) ||
  string_agg('**' || case_id || '**: ' || summary || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) ||
  'Key symptoms: ' || array_to_string(symptoms[1:2], '; ') || chr(10), chr(10) ORDER BY score DESC, first_seq) AS text
FROM found""",
    "render_context": f"""{WITH_CASES},\n{_found(Q.SEARCH_PHRASE, 5)},
ctx AS (SELECT score, first_seq, tags AS tag_list, error_patterns AS errors, {CONTEXT} FROM found)
SELECT '**Support Case Context for Analysis:**' || chr(10) || chr(10) || string_agg('## Case ' || case_id || chr(10) ||
  '**Summary**: ' || summary || chr(10) || '**Environment**: ' || replace(replace(environment, '|', ', '), '=', ': ')
  || chr(10) || '**Key Errors**: ' || array_to_string(errors[1:3], '; ') || chr(10) || '**Tags**: ' ||
  array_to_string(tag_list, ', ') || chr(10) || '**Content Preview**: ' || content_preview || chr(10),
  chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, first_seq) AS text FROM ctx""",
    "top_tags": f"""WITH {LEAD}, {IDS}, {CURRENT_IDS},
tagged AS (SELECT cur.case_id, first_seq, {tag_list('content')} AS tags FROM cur JOIN ids USING (case_id, ingest_seq)),
each_tag AS (SELECT first_seq, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM tagged)
SELECT tag, count(*) AS count FROM each_tag GROUP BY tag
ORDER BY count(*) DESC, min(first_seq * 100 + pos) LIMIT 10""",
}

_BY_CATEGORY = "CASE regexp_extract(e.token, '^\\[(.+)_\\d+\\]$', 1) " + " ".join(
    f"WHEN '{r.token}' THEN '{r.category}'" for r in R.PII_RULES) + " END AS category"
ORACLES["pii_inventory"] = f"""{WITH_RED}
SELECT category, count(*) AS tokens FROM (SELECT {_BY_CATEGORY} FROM (SELECT unnest(mappings) AS e FROM red))
GROUP BY category"""
ORACLES["pii_by_case"] = f"""{WITH_RED},\n{VAULT}
SELECT case_id, category, count(*) AS tokens FROM (SELECT case_id, {_BY_CATEGORY}
  FROM (SELECT case_id, unnest(mappings) AS e FROM vault)) GROUP BY case_id, category"""
ORACLES["search_history"] = ORACLES["search_topk"]
ORACLES["store_stats"] = f"""{WITH_RED},\n{VAULT},\n{IDS},\n{CURRENT_IDS},
tagged AS (SELECT cur.case_id, first_seq, {tag_list('content')} AS tags FROM cur JOIN ids USING (case_id, ingest_seq)),
each_tag AS (SELECT first_seq, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM tagged),
top AS (SELECT tag, count(*) AS n, min(first_seq * 100 + pos) AS f FROM each_tag GROUP BY tag
  ORDER BY count(*) DESC, f LIMIT 10)
SELECT (SELECT count(*) FROM cur) AS total_cases, (SELECT count(DISTINCT case_id) FROM vault) AS cases_with_pii,
  string_agg(tag || '=' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, f) AS top_tags FROM top"""
ORACLES["flagship"] = f"{WITH_CASES},\n{_found(Q.SEARCH_PHRASE, 10)}\nSELECT first_seq AS pos, {CONTEXT} FROM found"

# Governance, stores, streams ----------------------------------------------------------------------------------------


def _hmac(value: str) -> str:
    """HMAC-SHA256 in hex, from the hash function alone; the padded keys are constants."""
    key = bytes.fromhex(Q.DEMO_SECRET).ljust(64, b"\0")
    inner = "".join(f"\\x{b ^ 0x36:02X}" for b in key)
    outer = "".join(f"\\x{b ^ 0x5C:02X}" for b in key)
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({value}))))"


def _hash_step(rule, i: int, source: str) -> str:
    name = f"'__{rule.token}_' || upper({_hmac('a[k - 1]')}) || '__'"
    return f"""r{i} AS MATERIALIZED (
  SELECT * EXCLUDE (t, a, sp), CAST([] AS VARCHAR[]) AS m{i}, array_to_string(list_transform(sp, lambda x, k:
      CASE WHEN k = 1 THEN x ELSE {name} || x END), '') AS t
  FROM (SELECT *, regexp_extract_all(t, {regex(rule)}) AS a, string_split_regex(t, {regex(rule)}) AS sp
        FROM {source}))"""


def policy_redaction(rules, hashed: set[str]) -> str:
    steps, before = ["start AS (SELECT *, content AS t FROM raw)"], "start"
    for i, rule in enumerate(rules):
        steps.append((_hash_step if rule.category in hashed else _plain_step)(rule, i, before))
        before = f"r{i}"
    return ",\n".join(steps)


_LAST = f"r{len(R.PII_RULES) - 1}"
ORACLES["pseudonymize"] = (f"WITH {LEAD},\n{policy_redaction(R.PII_RULES, {r.category for r in R.PII_RULES})}\n"
                           f"SELECT ingest_seq, t AS content_redacted FROM {_LAST}")

_CHOSEN = {r.category: Q.DEMO_POLICY.get(r.category, Q.CategoryRule()) for r in R.PII_RULES}
_ACTIVE = [r for r in R.PII_RULES if _CHOSEN[r.category].redact != "none"]
_KEPT = "[]"
for _i, _r in enumerate(_ACTIVE):
    if _CHOSEN[_r.category].reversible:
        _KEPT = (f"list_concat({_KEPT}, list_transform(m{_i}, lambda x, k: '[{_r.token}_' || CAST(k AS VARCHAR) || "
                 f"']=' || x))")
_DENIED = "|".join(r.token for r in R.PII_RULES if _CHOSEN[r.category].export == "deny")
ORACLES["policy_rules"] = f"""WITH {LEAD},
{policy_redaction(_ACTIVE, {c for c, p in _CHOSEN.items() if p.redact == 'hash'})}
SELECT ingest_seq, t AS content_redacted, {joined(_KEPT)} AS mappings,
  regexp_replace(t, '\\[(?:{_DENIED})_\\d+\\]|__(?:{_DENIED})_[0-9A-F]+__', '', 'g') AS outbound
FROM r{len(_ACTIVE) - 1}"""


def _pack_counts(rules, profile: str) -> str:
    """Tokens per category as columns of the last step, unpivoted; ``rules`` run in their own CTE scope."""
    sums = " UNION ALL ".join(f"SELECT '{profile}' AS profile, '{r.category}' AS category, "
                              f"CAST(sum(len(m{i})) AS BIGINT) AS tokens FROM {{last}}" for i, r in enumerate(rules))
    last = f"r{len(rules) - 1}"
    steps, before = ["start AS (SELECT *, content AS t FROM raw)"], "start"
    for i, rule in enumerate(rules):
        steps.append(_plain_step(rule, i, before))
        before = f"r{i}"
    return f"(WITH {LEAD},\n" + ",\n".join(steps) + "\nSELECT * FROM (" + sums.format(last=last) + ") WHERE tokens > 0)"


ORACLES["policy_check"] = (f"SELECT * FROM {_pack_counts(R.PII_RULES, 'default')} UNION ALL "
                           f"SELECT * FROM {_pack_counts(R.PII_RULES_EXTENDED, 'extended')}")
ORACLES["assert_no_pii"] = f"WITH {LEAD}\n" + " UNION ALL ".join(
    f"SELECT '{r.category}' AS category, count(*) FILTER (WHERE regexp_matches(content, {regex(r)})) AS rows FROM raw"
    for r in R.PII_RULES)
ORACLES["audit_rows"] = f"""{WITH_RED}
SELECT {case_id('content')} AS case_id, ingest_seq, 'ingest' AS operation, 'strict' AS profile,
  CAST(len(mappings) AS BIGINT) AS tokens, NOT ({' OR '.join(f'regexp_matches(t, {regex(r)})' for r in R.PII_RULES)})
  AS pii_free FROM red"""
_WORDS = f"list_filter(string_split_regex(t, '[{SPACE}]+'), lambda x: x <> '')"
ORACLES["fingerprint"] = f"""{WITH_RED},
words AS (SELECT ingest_seq, unnest(w) AS x, generate_subscripts(w, 1) AS pos
  FROM (SELECT ingest_seq, {_WORDS} AS w FROM red)),
firsts AS (SELECT ingest_seq, x, min(pos) AS pos FROM words GROUP BY ingest_seq, x)
SELECT CAST(ingest_seq AS VARCHAR) AS case_id,
  string_agg(sha256(x), '|' ORDER BY pos) AS fingerprint FROM firsts GROUP BY ingest_seq"""
ORACLES["fingerprint_match"] = f"""WITH raw AS MATERIALIZED (SELECT source, doc_id AS ingest_seq, NULL AS given_case_id,
  text AS content FROM documents),
{redaction()},
sets AS (SELECT ingest_seq, list_sort(list_distinct({_WORDS})) AS w FROM red),
classes AS MATERIALIZED (SELECT min(ingest_seq) AS first_seq, count(*) AS n_cases, len(w) AS n, w FROM sets GROUP BY w),
words AS MATERIALIZED (SELECT first_seq, n, n_cases, unnest(w) AS x FROM classes),
links AS (SELECT a.first_seq, any_value(b.n_cases) AS other_cases FROM words AS a JOIN words AS b USING (x)
  WHERE a.first_seq <> b.first_seq AND 100 * least(a.n, b.n) >= {recall.PERCENT} * greatest(a.n, b.n)
  GROUP BY a.first_seq, b.first_seq HAVING 100 * count(*) >= {recall.PERCENT} * any_value(greatest(a.n, b.n))),
linked AS (SELECT first_seq, sum(other_cases) AS cases, count(*) AS n_classes FROM links GROUP BY first_seq)
SELECT first_seq, n_cases, CAST(CASE WHEN n > 0 THEN n_cases - 1 ELSE 0 END + coalesce(cases, 0) AS BIGINT) AS n_links,
  coalesce(n_classes, 0) AS n_classes FROM classes LEFT JOIN linked USING (first_seq)"""
ORACLES["linked_items"] = f"""WITH {LEAD}
SELECT DISTINCT {case_id('content')} AS case_id,
  unnest(regexp_extract_all(content, {text(re2(R.LINKED_ITEM_PATTERN))}, 1)) AS item_id FROM raw"""
ORACLES["entities"] = f"WITH {LEAD},\n{IDS}\n" + " UNION ALL ".join(
    f"SELECT DISTINCT case_id, '{r.name}' AS kind, unnest(regexp_extract_all(content, {regex(r)})) AS value FROM ids"
    for r in R.ENTITY_RULES)
ORACLES["vault_roundtrip"] = (f"{WITH_RED},\n{VAULT}\n"
                              f"SELECT case_id, ingest_seq, {FLAT_MAPPINGS} AS mappings FROM vault")
ORACLES["vault_rotation"] = f"""WITH whole AS MATERIALIZED ({ORACLES['vault_roundtrip']})
SELECT case_id, ingest_seq, mappings, true AS readable FROM whole
UNION ALL SELECT case_id || ' moved', ingest_seq, NULL, false FROM whole"""
ORACLES["vault_transfer"] = ORACLES["current_vault"]
ORACLES["encrypt_cbc"] = _raw_query("content")
ORACLES["case_store"] = ORACLES["current_cases"]
ORACLES["case_store_json"] = f"""{WITH_CASES}
SELECT case_id, summary, {joined('symptoms')} AS symptoms, environment, {joined('error_patterns')} AS error_patterns,
  {joined('tags')} AS tags, content_redacted, word_count FROM cur"""

_ARRIVED = "SELECT source, doc_id AS ingest_seq, 'Support note: ' || text AS content FROM documents"
ORACLES["case_store_object"] = (f"SELECT case_id, summary, tags, content_redacted, word_count, true AS readable "
                                f"FROM ({ORACLES['case_store_json']})")
ORACLES["stream_ingest"] = f"""WITH raw AS MATERIALIZED (SELECT min(source) AS source, min(ingest_seq) AS ingest_seq,
  NULL AS given_case_id, content FROM ({_ARRIVED}) WHERE length(content) >= {R.MIN_CONTENT_LENGTH} GROUP BY content),
{redaction()}
SELECT ingest_seq, md5(content) AS content_md5, t AS content_redacted, {word_count('content')} AS word_count FROM red"""
ORACLES["stream_dedupe"] = f"SELECT DISTINCT md5(content) AS content_md5 FROM ({_ARRIVED})"
ORACLES["stream_changed"] = f"SELECT event_id, user_id FROM ({ORACLES['changed_only']})"
# Arrival by arrival, all users at once: the memory of each as a list.
ORACLES["stream_newest"] = f"""WITH RECURSIVE texts AS MATERIALIZED (SELECT event_id, user_id, concat_ws(' ', event_type, event_id % {Q.NEWEST_KINDS}) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
steps(n, user_id, event_id, fresh, held) AS (
  SELECT CAST(0 AS BIGINT), user_id, CAST(NULL AS BIGINT), false, CAST([] AS VARCHAR[]) FROM texts GROUP BY user_id
  UNION ALL SELECT texts.n, texts.user_id, texts.event_id, NOT list_contains(held, t), CASE WHEN list_contains(held, t) THEN held
    WHEN len(held) >= {Q.NEWEST_MOST} THEN list_append(held[len(held) - {Q.NEWEST_KEPT - 2}:], t) ELSE list_append(held, t) END
  FROM steps JOIN texts ON texts.user_id = steps.user_id AND texts.n = steps.n + 1)
SELECT event_id, user_id FROM steps WHERE fresh"""
ORACLES["stream_tag_counts"] = f"""WITH {LEAD},
tagged AS (SELECT 1704067200 + ingest_seq AS s, unnest({tag_list('content')}) AS tag FROM raw)
SELECT CAST(s - s % 600 AS BIGINT) AS start, tag, count(*) AS count FROM tagged GROUP BY ALL"""

# The older composition: compress, parse the raw text with the older rules, redact with both older passes.
ORACLES["ingest_legacy"] = f"""WITH given AS MATERIALIZED ({corpus.SQL}), {LINES.replace('FROM raw', 'FROM given')},
{COMPRESSED},
raw AS MATERIALIZED (SELECT source, ingest_seq, given_case_id, content_compressed AS content
  FROM given JOIN compressed USING (ingest_seq)),
{redaction(R.PII_RULES_LEGACY + R.CONTEXT_RULES)}
SELECT ingest_seq, {_flat_case('content', R.TAG_RULES_LEGACY, detected_first=True)},
  {discussion('content')} AS discussion, t AS content_redacted, {FLAT_MAPPINGS} AS mappings FROM red"""
ORACLES["case_context_legacy"] = f"""{WITH_CASES}
SELECT case_id, substr(content_redacted, 1, 500) || '...' AS content_preview FROM cur"""
ORACLES["context_json"] = f"""{WITH_CASES},\n{_found(Q.SEARCH_PHRASE, 10)}
SELECT 'support_cases' AS context_type, CAST(count(*) AS VARCHAR) AS total_cases,
  arg_max(case_id, score * 1000000000 - first_seq) AS first_case,
  arg_max(summary, score * 1000000000 - first_seq) AS first_summary FROM found"""

for _name, _rules in (("rehydrate_legacy", R.PII_RULES_LEGACY + R.CONTEXT_RULES), ("rehydrate_extended", R.PII_RULES_EXTENDED)):
    ORACLES[_name] = (_raw_query("content") + " WHERE NOT regexp_matches(content, '\\[(?:"
                      + "|".join(r.token for r in _rules) + ")_\\d+\\]')")
ORACLES["strict_gate"] = f"""{WITH_CASES},\n{VAULT},\n{REQUESTS}
SELECT case_id, ingest_seq, CAST(NULL AS VARCHAR) AS content_full FROM cur
WHERE case_id IN (SELECT case_id FROM wanted) AND case_id NOT IN (SELECT case_id FROM vault)"""
ORACLES["chunk_context"] = f"""{WITH_RED},
words AS (SELECT ingest_seq, {_WORDS} AS w FROM red),
starts AS (SELECT ingest_seq, w, unnest(range(0, greatest(len(w) - {R.CHUNK_OVERLAP}, 1),
  {R.CHUNK_WORDS[0] - R.CHUNK_OVERLAP})) AS s FROM words WHERE len(w) > 0)
SELECT ingest_seq, CAST(s // {R.CHUNK_WORDS[0] - R.CHUNK_OVERLAP} AS BIGINT) AS chunk,
  array_to_string(w[s + 1:s + {R.CHUNK_WORDS[0]}], ' ') AS chunk_text FROM starts"""
ORACLES["export_summary"] = f"{WITH_CASES}\nSELECT {CONTEXT} FROM cur"
ORACLES["export_diagnostic"] = f"""{WITH_CASES}
SELECT case_id, summary, {joined('tags')} AS tags, content_redacted FROM cur"""
ORACLES["export_full"] = f"SELECT case_id, content_full FROM ({ORACLES['get_full']})"
ORACLES["policy_flags"] = """SELECT profile, count(*) AS requests, true AS require_redaction, profile = 'trusted' AS
  allow_full_rehydration, true AS encrypt_vault, profile = 'strict' AS audit_log, profile = 'strict' AS outbound_scrub
FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'strict' ELSE 'trusted' END AS profile FROM documents) GROUP BY profile"""
ORACLES["policy_add"] = f"""{WITH_RED}
SELECT {case_id('content')} AS case_id, ingest_seq, 'add' AS operation, 'strict' AS profile,
  CAST(len(mappings) AS BIGINT) AS tokens, NOT ({' OR '.join(f'regexp_matches(t, {regex(r)})' for r in R.PII_RULES)})
  AS pii_free, t AS content_redacted FROM red"""
ORACLES["policy_export"] = f"SELECT case_id, summary, content_preview, 'export' AS operation, 'strict' AS profile, true AS pii_free FROM ({ORACLES['case_context']})"
ORACLES["case_files"] = f"""SELECT doc_id // {Q.DOCS_PER_FILE} AS part, CAST(sum(length(text) + 1) AS BIGINT) AS chars
FROM documents GROUP BY 1"""
ORACLES["stream_files"] = ORACLES["case_files"]
ORACLES["data_size"] = "SELECT count(*) AS documents, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents"
