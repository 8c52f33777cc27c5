"""The queries' results said in DuckDB SQL, from the star-schema tables up."""

from __future__ import annotations

CLOCK = "TIMESTAMP '2001-08-02 00:00:00'"


def _age(ts: str) -> str:
    return f"floor((epoch_ms({CLOCK}) - epoch_ms({ts})) / 86400000.0)::BIGINT"


_BASE = f"""
edges AS (SELECT l_suppkey AS s, o_custkey AS c, max(l_shipdate) AS seen, max(l_discount) AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
months AS (SELECT DISTINCT who, month FROM (SELECT l_suppkey AS who, strftime(l_shipdate, '%Y%m') AS month FROM lineitem UNION ALL SELECT o_orderkey % 10, strftime(o_orderdate, '%Y%m') FROM orders UNION ALL SELECT c_custkey % 10, '199501' FROM customer)),
snapshots AS (SELECT 'n' || who || '_' || month AS n, who, CASE WHEN month::INT % 2 = 0 THEN 'orders' ELSE 'lineitem' END AS kind FROM months WHERE (who * 100 + month::INT) % 89 <> 0),
consent AS (SELECT s_suppkey AS k, s_suppkey % 3 <> 1 AS individual, s_suppkey % 11 <> 5 AS purpose_ok,
  CASE WHEN s_suppkey % 7 = 3 THEN ['orders'] ELSE ['lineitem', 'orders'] END AS classes,
  CASE s_suppkey % 6 WHEN 2 THEN ['A', 'C'] WHEN 3 THEN ['B', 'D'] WHEN 5 THEN ['A', 'B', 'C'] ELSE ['A', 'B', 'C', 'D'] END AS cats,
  s_suppkey % 10 <> 7 AS active_contributor, s_suppkey % 9 <> 0 AS export_ok,
  CASE WHEN s_suppkey % 13 = 6 THEN 'withdrawn' WHEN s_suppkey % 10 = 7 THEN 'inactive' WHEN s_suppkey % 19 = 8 THEN 'not_yet_active'
    WHEN s_suppkey % 5 = 3 OR (s_suppkey % 5 = 4 AND s_suppkey % 2 = 0) THEN 'expired' ELSE 'active' END AS disposition FROM supplier),
emp AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderkey % 25 AS org, o_orderdate AS seen, o_orderstatus AS st, o_orderpriority AS title, {_age("o_orderdate")} AS age,
  'n' || (o_orderkey % 10) || '_' || strftime(o_orderdate, '%Y%m') AS n FROM orders),
cur AS (SELECT c, count(DISTINCT org) FILTER (st = 'O' AND age <= 365) AS current_organizations FROM emp GROUP BY c),
latest AS (SELECT emp.*, current_organizations FROM emp JOIN cur USING (c) QUALIFY row_number() OVER (PARTITION BY emp.c ORDER BY seen DESC, 'm' || o) = 1),
cand0 AS (SELECT 'e' || e.s || '_' || e.c AS edge, e.s, e.c, e.seen AS edge_at, 1 - e.discount AS edge_confidence, 'n' || e.s || '_' || strftime(e.seen, '%Y%m') AS edge_n, l.o, l.org, l.seen AS emp_at, l.st, l.title, l.age AS emp_age, l.n AS emp_n, l.current_organizations,
  {_age("e.seen")} AS rel_age, l.org % 3 = 0 AS target, l.org % 5 < 3 AS icp, (CASE WHEN l.org % 5 < 3 THEN 60 ELSE 0 END + CASE WHEN l.org >= 5 THEN 40 ELSE 0 END) AS icp_score,
  l.title IN ('1-URGENT', '2-HIGH') AS persona, CASE WHEN l.title IN ('1-URGENT', '2-HIGH') THEN 50 ELSE 0 END AS persona_score, e.s % 4 = 0 AS direct FROM edges e JOIN latest l ON e.c = l.c),
cand AS (SELECT * FROM (SELECT *, CASE WHEN direct AND persona AND icp THEN 'A' WHEN direct AND target THEN 'B' WHEN NOT direct AND target AND persona THEN 'C' WHEN NOT direct AND target THEN 'D' END AS category FROM cand0) WHERE category IS NOT NULL),
own AS (SELECT DISTINCT * FROM (SELECT edge, org, edge_n AS n FROM cand UNION ALL SELECT edge, org, emp_n FROM cand WHERE o % 97 <> 0)),
claims AS (SELECT o, org, n, o % 60 = 0 AS conflicted FROM emp WHERE o % 3 = 0),
scoped AS (SELECT DISTINCT own.edge, claims.o, claims.n, claims.conflicted FROM own JOIN claims USING (org, n)),
refs AS (SELECT edge, 'er' || s || '_' || c AS ref, edge_n AS n FROM cand UNION ALL SELECT edge, 'ee' || o, CASE WHEN o % 97 <> 0 THEN emp_n END FROM cand
  UNION ALL SELECT edge, 'ei' || c, 'n' || (c % 10) || '_199501' FROM cand UNION ALL SELECT edge, 'eo' || o, n FROM scoped),
deps AS (SELECT DISTINCT edge, n FROM refs WHERE n IS NOT NULL),
dep AS (SELECT edge, deps.n, who, kind, k.* FROM deps LEFT JOIN snapshots USING (n) LEFT JOIN consent k ON k.k = who),
supp AS (SELECT * FROM (VALUES ('person', 'c17', 'PERSON_SUPPRESSED'), ('organization', 'o9', 'ORGANIZATION_EXCLUDED'), ('domain', 'o12.example.com', 'DOMAIN_EXCLUDED'), ('snapshot', 'n3_200105', 'SNAPSHOT_SUPPRESSED')) AS t(kind, value, code)),
reason AS (SELECT DISTINCT edge, code FROM (
  SELECT edge, unnest([
    CASE WHEN (s + c) % 20 = 0 THEN 'RELATIONSHIP_EDGE_INELIGIBLE' END,
    CASE WHEN NOT k.active_contributor THEN 'CONTRIBUTOR_INACTIVE' END,
    CASE WHEN k.disposition <> 'active' THEN 'CONSENT_' || upper(k.disposition) END,
    CASE WHEN NOT k.purpose_ok THEN 'CONSENT_PURPOSE_MISMATCH' END,
    CASE WHEN NOT list_contains(k.cats, category) OR NOT coalesce(list_contains(k.classes, sn.kind), false) THEN 'CONSENT_SCOPE_DISALLOWS_CATEGORY_OR_SOURCE' END,
    CASE WHEN category IN ('C', 'D') AND NOT k.individual THEN 'BROKER_INDIVIDUAL_CONSENT_REQUIRED' END,
    CASE WHEN c % 41 = 0 OR (c % 43 = 0 AND c % 2 = 1) THEN 'IDENTITY_UNRESOLVED_OR_CONFLICTED' END,
    CASE WHEN org = 15 THEN 'ORGANIZATION_UNRESOLVED_OR_CONFLICTED' END,
    CASE WHEN st = 'F' THEN 'EMPLOYMENT_ENDED' END,
    CASE WHEN o % 50 = 0 OR current_organizations > 1 THEN 'EMPLOYMENT_CONFLICTED' END,
    CASE WHEN emp_age > 730 OR emp_age < 0 THEN 'EMPLOYMENT_STALE' WHEN emp_age > 365 THEN 'EMPLOYMENT_REVIEW_REQUIRED' END,
    CASE WHEN rel_age > 730 OR rel_age < 0 THEN 'RELATIONSHIP_STALE' END,
    CASE WHEN o % 97 = 0 OR sn.n IS NULL THEN 'DEPENDENCY_EVIDENCE_INCOMPLETE' END,
    CASE WHEN category = 'B' AND persona THEN 'CATEGORY_B_PERSONA_GATE_FAILED' END]) AS code
  FROM cand JOIN consent k ON k.k = s LEFT JOIN snapshots sn ON sn.n = edge_n
  UNION ALL SELECT edge, 'ORGANIZATION_UNRESOLVED_OR_CONFLICTED' FROM scoped WHERE conflicted
  UNION ALL SELECT edge, unnest([
    CASE WHEN kind IS NULL THEN 'DEPENDENCY_SNAPSHOT_MISSING' END,
    CASE WHEN kind IS NOT NULL AND disposition <> 'active' THEN 'DEPENDENCY_CONSENT_' || upper(disposition) END,
    CASE WHEN kind IS NOT NULL AND NOT purpose_ok THEN 'DEPENDENCY_CONSENT_PURPOSE_MISMATCH' END,
    CASE WHEN kind IS NOT NULL AND NOT list_contains(dep.cats, category) THEN 'DEPENDENCY_CONSENT_CATEGORY_DISALLOWED' END,
    CASE WHEN kind IS NOT NULL AND NOT list_contains(dep.classes, kind) THEN 'DEPENDENCY_CONSENT_SOURCE_DISALLOWED' END,
    CASE WHEN kind IS NOT NULL AND NOT active_contributor THEN 'DEPENDENCY_CONTRIBUTOR_INACTIVE' END]) FROM dep JOIN cand USING (edge)
  UNION ALL SELECT edge, code FROM cand JOIN supp ON (supp.kind = 'person' AND value = 'c' || c) OR (supp.kind = 'organization' AND value = 'o' || org)
  UNION ALL SELECT edge, code FROM scoped JOIN cand USING (edge) JOIN supp ON supp.kind = 'domain' AND value = 'o' || org || '.example.com'
  UNION ALL SELECT edge, code FROM deps JOIN supp ON supp.kind = 'snapshot' AND value = n) WHERE code IS NOT NULL),
why AS (SELECT edge, count(*) FILTER (code <> 'EMPLOYMENT_REVIEW_REQUIRED') AS hard, count(*) AS n, string_agg(code, '|' ORDER BY code) AS codes, string_agg(code, '|' ORDER BY code) FILTER (code <> 'EMPLOYMENT_REVIEW_REQUIRED') AS hard_codes FROM reason GROUP BY edge),
verdict0 AS (SELECT cand.*, CASE WHEN hard > 0 THEN 'blocked' WHEN why.n > 0 THEN 'review_only' ELSE 'eligible' END AS disposition, CASE WHEN hard > 0 THEN hard_codes ELSE coalesce(codes, '') END AS reason_codes,
  CASE WHEN target THEN 100 ELSE icp_score END AS account_fit, persona_score AS persona_fit,
  greatest(0, least(100, floor(edge_confidence * 100 + 0.5)))::INT AS relationship_confidence, greatest(0, least(100, floor((1 - (o % 10) / 20.0::DOUBLE) * 100 + 0.5)))::INT AS employment_confidence,
  greatest(0, least(100, floor(least(edge_confidence, 1 - (o % 10) / 20.0::DOUBLE, 1 - (c % 7) / 20.0::DOUBLE) * 100 + 0.5)))::INT AS path_confidence, greatest(0, least(100, floor(100 - greatest(emp_age, rel_age) * 100 / 730.0::DOUBLE + 0.5)))::INT AS freshness
  FROM cand LEFT JOIN why USING (edge)),
verdict AS (SELECT *, greatest(0, least(100, floor((account_fit * 25 + persona_fit * 20 + relationship_confidence * 20 + employment_confidence * 15 + path_confidence * 10 + freshness * 10) / 100.0::DOUBLE + 0.5)))::INT AS review_priority FROM verdict0),
result AS (SELECT * FROM verdict WHERE disposition = 'eligible' QUALIFY category IN ('C', 'D') OR row_number() OVER (PARTITION BY category IN ('C', 'D'), category, c ORDER BY edge DESC) = 1)
"""

_NORM = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _with(select: str) -> str:
    return f"WITH {_BASE} {select}"


_RULES = {
    "equals": "l.title = '1-URGENT'", "in": "l.org % 5 IN (0, 2)", "not_in": "l.org % 5 NOT IN (0, 2)", "contains_token": "l.title IN ('2-HIGH', '4-NOT SPECIFIED')", "range": "l.org BETWEEN 5 AND 15", "exists": "l.title <> ''",
}

SQL: dict[str, str] = {
    "coverage_audit": _with("SELECT edge, category, disposition, reason_codes, account_fit::INT AS account_fit, persona_fit::INT AS persona_fit, relationship_confidence, employment_confidence, path_confidence, freshness, review_priority FROM verdict"),
    "latest_employment": _with("SELECT 'c' || c AS person_id, 'm' || o AS employment_claim_id, 'o' || org AS organization_id, current_organizations FROM latest"),
    "consent_disposition": _with("SELECT 'k' || k AS consent_record_id, disposition FROM consent"),
    "eligible_edges": _with("SELECT 'e' || s || '_' || c AS relationship_edge_id, 'k' || s AS consent_record_id FROM edges JOIN consent ON k = s WHERE (s + c) % 20 <> 0 AND disposition = 'active'"),
    **{f"rule_{k}": _with(f"SELECT 'c' || c AS person_id, {v} AS matched FROM latest l") for k, v in _RULES.items()},
    "rule_set_score": _with("SELECT DISTINCT 'o' || org AS organization_id, icp AS matched, icp_score AS score, concat_ws('|', CASE WHEN icp THEN 'r_region' END, CASE WHEN org >= 5 THEN 'r_size' END) AS matched_rule_ids, concat_ws('|', CASE WHEN NOT icp THEN 'r_region' END, CASE WHEN org < 5 THEN 'r_size' END) AS failed_rule_ids FROM cand0"),
    "persona_outcome": _with("SELECT 'c' || c AS person_id, CASE WHEN title IN ('1-URGENT', '2-HIGH') THEN 'matched' ELSE 'not_matched' END AS outcome FROM latest"),
    "category_classify": _with("SELECT edge, category FROM cand"),
    "identity_summary": "SELECT 'c' || c_custkey AS person_id, 1 - (c_custkey % 7) / 20.0::DOUBLE AS identity_confidence, c_custkey % 41 = 0 AS identity_conflicted, 1 AS n_refs FROM customer",
    "organization_claims_in_scope": _with("SELECT edge, count(*) AS n_refs, bool_or(conflicted) AS conflicted FROM scoped GROUP BY edge"),
    "dependency_closure": _with("SELECT edge, count(*) AS n_snapshots, count(DISTINCT CASE WHEN kind IS NOT NULL THEN who END) AS n_contributors, count(DISTINCT kind) AS n_kinds FROM dep GROUP BY edge"),
    "evidence_incomplete": _with("SELECT edge FROM reason WHERE code = 'DEPENDENCY_EVIDENCE_INCOMPLETE'"),
    "gate_reasons": _with("SELECT code, count(*) AS n FROM reason GROUP BY code"),
    "disposition_split": _with("SELECT category, disposition, count(*) AS n FROM verdict GROUP BY ALL"),
    "suppression_union": _with("SELECT kind, value, code AS reason_code FROM supp"),
    "suppression_anti": _with("SELECT 'c' || c_custkey AS person_id FROM customer WHERE 'c' || c_custkey NOT IN (SELECT value FROM supp WHERE kind = 'person')"),
    "path_confidence": _with("SELECT edge, path_confidence FROM verdict"),
    "freshness_score": _with("SELECT edge, freshness FROM verdict"),
    "review_priority": _with("SELECT edge, review_priority FROM verdict"),
    "ordered_results": _with("SELECT category, review_priority, dense_rank() OVER (ORDER BY category, review_priority DESC) AS rank, count(*) AS n FROM result GROUP BY category, review_priority"),
    "category_counts": _with("SELECT x.category, count(result.edge) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D')) AS x(category) LEFT JOIN result USING (category) GROUP BY x.category"),
    "account_coverage": _with("SELECT 'o' || org AS organization_id, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, count(*) AS finding_count FROM result GROUP BY org"),
    "evidence_summary": _with("SELECT edge, count(DISTINCT ref) AS evidence_count, count(DISTINCT substr(ref, 2, 1)) AS n_claim_types FROM refs JOIN result USING (edge) WHERE refs.n IS NOT NULL GROUP BY edge"),
    "export_filter": _with("SELECT edge FROM result WHERE edge NOT IN (SELECT edge FROM dep WHERE NOT export_ok) AND s % 9 <> 0"),
    "withdrawal_cascade": _with("SELECT DISTINCT 'e2_' || o_custkey AS relationship_edge_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 2 UNION ALL SELECT edge FROM result WHERE s <> 2 AND edge IN (SELECT edge FROM dep WHERE who = 2)"),
    "employment_conflict": "SELECT DISTINCT 'm' || a.o_orderkey AS employment_claim_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey % 25 <> b.o_orderkey % 25 AND b.o_orderkey < a.o_orderkey AND b.o_orderstatus = 'O' AND abs(epoch_ms(a.o_orderdate) - epoch_ms(b.o_orderdate)) <= 31536000000",
    "employment_disposition": _with("""SELECT 'm' || a.o AS employment_claim_id, CASE
  WHEN a.st = 'F' OR EXISTS (SELECT 1 FROM emp b WHERE b.c = a.c AND b.st = 'F' AND b.seen >= a.seen) THEN 'blocked_ended'
  WHEN EXISTS (SELECT 1 FROM emp b WHERE b.c = a.c AND b.st = 'O' AND b.org <> a.org AND abs(epoch_ms(b.seen) - epoch_ms(a.seen)) <= 31536000000) THEN 'blocked_conflict'
  WHEN a.age < 0 OR a.st = 'P' THEN 'stale' WHEN a.age <= 365 THEN 'potentially_current' WHEN a.age <= 730 THEN 'review_only' ELSE 'stale' END AS disposition FROM emp a"""),
    "terminal_escape": "SELECT conv_id, turn, replace(replace(replace(text, chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS text FROM conversations",
    "alias_mapping": "SELECT 'o' || n_nationkey AS source_organization_id, CASE WHEN n_nationkey % 4 = 1 THEN 'o' || (n_nationkey - 1) ELSE 'o' || n_nationkey END AS organization_id FROM nation",
    "duplicate_groups": "SELECT sha256(concat_ws(chr(10), l_orderkey, l_linenumber)) AS group_digest, count(*) AS n, min(l_partkey) AS first_row FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "row_digest": "SELECT event_id, sha256(concat('{\"event_type\":\"', event_type, '\",\"user_id\":', user_id, '}')) AS digest FROM events",
    "claim_fanout": "SELECT c_custkey, kind, value FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS kind, unnest([c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, c_nationkey::VARCHAR]) AS value FROM customer) WHERE value IS NOT NULL",
    "evidence_fanout": "SELECT 'c' || c_custkey AS record, kind AS claim_type FROM customer, (VALUES ('identity'), ('organization'), ('employment'), ('relationship')) AS k(kind)",
    "anchor_selection": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'provider_person_id' WHEN c_custkey % 5 = 1 THEN 'crm_contact_id' WHEN c_custkey % 5 = 2 THEN 'profile_url' WHEN c_custkey % 5 = 3 AND c_custkey % 2 = 0 THEN 'email' ELSE 'row_group' END AS anchor FROM customer",
    "email_risk": "SELECT c_custkey, CASE WHEN c_custkey % 10 < 8 OR c_custkey % 6 = 0 THEN 'shared_or_role' ELSE 'unique_candidate' END AS risk FROM customer",
    "domain_normalize": "SELECT page_id, CASE WHEN regexp_matches(d, '^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,63}$') THEN d END AS domain FROM (SELECT page_id, split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1) AS d FROM pages)",
    "formula_neutralize": "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '''' ELSE '' END || CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN chr(9) ELSE '' END || lang AS cell FROM documents",
    "adapter_dedup": "SELECT user_id, event_type, count(*) - 1 AS duplicates, min(event_id) AS first_record FROM events GROUP BY ALL",
    "page_slice": "SELECT event_id FROM events ORDER BY event_id LIMIT 100 OFFSET 200",
}
SQL["display_revalidation"] = _with("""SELECT result.edge FROM result WHERE edge NOT IN (SELECT dep.edge FROM dep WHERE who % 13 = 1)""")
