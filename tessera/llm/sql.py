"""DuckDB SQL for the operators that SQL can express, over whole tables. The others are tested against brute force."""

from __future__ import annotations

from tessera.llm.line_dedup import MIN_WORDS, RUN_WORDS
from tessera.llm.quality import LEAST_KEPT, LINE_WORDS, MAX_DOCS, MAX_SHARE
from tessera.llm.secrets import BASE, MORE

SPLIT = r"string_split_regex({}, '[\x20\x09-\x0D]+')"


def words(text: str) -> str:
    return f"list_filter({SPLIT.format(text)}, lambda x: x <> '')"


QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, {words('text')} AS w FROM d),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t),
often AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g SEMI JOIN often USING (doc_id, g)) GROUP BY 1),
l AS (SELECT doc_id, source, md5(text) AS digest, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, {words('line')} AS lw FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw WHERE len(lw) > 0 GROUP BY 1),
short AS (SELECT doc_id, source, digest, lower(array_to_string(lw, ' ')) AS key, len(lw) AS n FROM lw WHERE len(lw) BETWEEN 1 AND {LINE_WORDS}),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS n FROM d GROUP BY 1),
limits AS (SELECT source, key FROM short JOIN hosts USING (source) GROUP BY source, key HAVING count(DISTINCT digest) > {MAX_DOCS} AND count(DISTINCT digest) > {MAX_SHARE} * any_value(hosts.n)),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM short SEMI JOIN limits USING (source, key) GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {LEAST_KEPT} * n_words AS kept FROM m"""

LINES = rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(range(len(l))) AS unit, unnest(l) AS line FROM l),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start, string_split_regex(line, '[.!?] ') AS parts FROM u),
s AS (SELECT doc_id, unit, unnest(range(1, len(parts) + 1)) AS place, len(parts) AS n_parts, unnest(parts) AS line, line_start FROM p),
t AS (SELECT doc_id, unit, CASE WHEN n_parts > 1 THEN place ELSE 0 END AS part, line, line_start + coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id, unit ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
w AS (SELECT *, {words('line')} AS w FROM t),
k AS (SELECT doc_id, unit, part, len(w) AS n, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS "end", rtrim(lower(array_to_string(w, ' ')), '.!?') AS key FROM w WHERE len(w) >= {MIN_WORDS}),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit, part) AS seq, first_value(doc_id) OVER q AS kept_doc_id, first_value(unit) OVER q AS kept_unit, first_value(part) OVER q AS kept_part FROM k WINDOW q AS (PARTITION BY key ORDER BY doc_id, unit, part)),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM f WHERE doc_id <> kept_doc_id OR unit <> kept_unit OR part <> kept_part),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, run) AS total FROM g)
SELECT doc_id, unit, CAST(part AS BIGINT) AS part, start, "end", kept_doc_id, kept_unit, CAST(kept_part AS BIGINT) AS kept_part FROM r WHERE total >= {RUN_WORDS}"""


def secret_part(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start, length(found[i]) AS n
  FROM (SELECT doc_id, found, tested, gaps, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {group}) AS tested, string_split_regex(text, '{p}') AS gaps
    FROM d WHERE regexp_matches(text, '{p}'))) WHERE length(tested[i]) >= {least}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(secret_part(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate((*BASE, *MORE)))}),
s AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR) AS x FROM m),
g AS (SELECT doc_id, count(CASE WHEN place = 0 THEN 1 END) AS n_assign, count(CASE WHEN place = 1 THEN 1 END) AS n_access, count(CASE WHEN place = 2 THEN 1 END) AS n_hex,
  string_agg(CASE WHEN place < 3 THEN x END, ',' ORDER BY start, place) AS base, string_agg(x, ',' ORDER BY start, place) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
