"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

import string

from . import hnsw, jaccard, secrets, topk

ORACLES: dict[str, str] = {}

#: Component ids from ``links(a, b)``, which holds both directions.
REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rank: int, kind: str) -> str:
    pattern, group = _quoted(secrets.PATTERNS[kind]), secrets.VALUE_GROUP[kind]
    return f"""SELECT doc_id, owner, repository, {rank} AS rank, '{kind}' AS kind, v[i] AS value, pos AS "start", pos + length(m[i]) AS "end"
  FROM (SELECT *, CAST(list_sum(list_transform(sp[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(
      m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT *, regexp_extract_all(body, {pattern}) AS m, regexp_extract_all(body, {pattern}, {group}) AS v,
      string_split_regex(body, {pattern}) AS sp FROM docs))) WHERE length(v[i]) >= {secrets.LEAST_LENGTH[kind]}"""


_KINDS = " UNION ALL ".join(_spans(rank, kind) for rank, kind in enumerate(secrets.PATTERNS))
_LISTED = """coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank, "end"), '')"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in (*secrets.PATTERNS, *secrets.VERDICTS))
ORACLES["op3_secret_ownership"] = f"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang)
  AS repository, coalesce(text, '') AS body FROM documents),
base AS MATERIALIZED ({_KINDS}),
values_ AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT owner || ' ' || repository) AS repositories FROM base GROUP BY value),
judged AS (SELECT value, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} OR repositories >= {secrets.EXAMPLE_REPOSITORIES} THEN 'example'
  WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_CHARACTERS} THEN 'live' END AS verdict FROM values_),
added AS (SELECT DISTINCT doc_id, CASE verdict WHEN 'live' THEN {len(secrets.PATTERNS)} ELSE {len(secrets.PATTERNS) + 1} END AS rank, verdict AS kind,
  "end" - length(value) AS "start", "end" FROM base JOIN judged USING (value) WHERE verdict IS NOT NULL),
spans AS (SELECT doc_id, rank, kind, "start", "end" FROM base UNION ALL SELECT doc_id, rank, kind, "start", "end" FROM added),
of AS (SELECT doc_id, {_COUNTS}, {_LISTED} AS spans FROM spans GROUP BY doc_id),
of_base AS (SELECT doc_id, {_LISTED} AS listed FROM base GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example FROM docs LEFT JOIN of USING (doc_id) LEFT JOIN of_base USING (doc_id)"""

ORACLES["op4_small_world_near_dups"] = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x:
  CAST(x AS DOUBLE)) AS x FROM embeddings WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v AS p JOIN v AS q ON p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.x, q.x) >= {hnsw.COSINE}),
{REACH},
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id"""

ORACLES["op6_cover_tree_top5"] = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x:
  floor({topk.SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {_SOUND}),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores) WHERE place <= 5"""

_N = jaccard.WORDS
ORACLES["op8_size_aware_jaccard"] = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {_N - 1}], ' ')) AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {_N - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM sets AS p JOIN sets AS q USING (shingle)
  WHERE p.doc_id <> q.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
  WHERE 100 * common.n >= {jaccard.PERCENT} * (x.n + y.n - common.n)),
{REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = doc_id"""
