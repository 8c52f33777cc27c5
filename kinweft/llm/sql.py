"""What the operators return, said in DuckDB SQL over the same tables."""

from __future__ import annotations

from kinweft.llm.secret_scan import RULES

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, source: str, key: str) -> str:
    """CTEs ``{name}_w`` (words) and ``{name}`` (key, s): the distinct five-word shingles of each row."""
    return rf"""
{name}_w AS (SELECT {key}, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_SPACE}'), lambda x: x <> '') AS w FROM {source}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, least(len(w) + 1, 2)))) AS i FROM {name}_w))"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE {_shingles("sh", "documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS c FROM (SELECT doc_id, list(s ORDER BY s) AS k FROM sh GROUP BY doc_id)),
rep AS (SELECT sh.* FROM sh JOIN cls ON sh.doc_id = cls.doc_id AND cls.doc_id = cls.c),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM rep x JOIN rep y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT x, b FROM reach JOIN e ON y = a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, cls.c, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, cls.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.x = cls.c
"""

CONTAINED = rf"""
WITH {_shingles("sh", "documents", "doc_id")},
{_shingles("it", "benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n FROM it GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS m FROM sh JOIN it USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, m AS n_shared FROM hit JOIN n USING (item_id) WHERE 100 * m >= 75 * n
"""

LINES = rf"""
WITH l AS (SELECT doc_id, i, x[i] AS line, {_LOWER.format(r"regexp_replace(x[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k GROUP BY doc_id
"""


def _found(order: int) -> str:
    rule = RULES[order]
    # what may not stand before a match is matched as a group of its own and taken off again
    pattern = (f"(^|[^{rule.after}])" if rule.after else "()") + rule.pattern.replace("'", "''")
    group = rule.group and rule.group + 1
    return rf"""f{order} AS (SELECT doc_id, len(a[i]) + len(b[i]) AS before, len(m[i]) - len(b[i]) AS size, len(g[i]) AS part, i FROM (SELECT doc_id, a, b, m, g, unnest(range(1, len(m) + 1)) AS i
  FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS a, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, regexp_extract_all(text, '{pattern}', 1) AS b FROM d))),
s{order} AS (SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, stop - size AS start, stop FROM (SELECT *, sum(before + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM f{order}) WHERE part >= {rule.least})"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(_found(i) for i in range(len(RULES)))},
s AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(RULES)))}),
t AS (SELECT *, concat(kind, ':', start::BIGINT, ':', stop::BIGINT) AS x FROM s)
SELECT d.doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY start, o) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY start, o), '') AS spans
FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id
"""
