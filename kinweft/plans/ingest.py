"""Queries over what comes in: canonical rows, resolution, claims, provider records; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.functions import scalars
from kinweft.functions.digest import json_object, json_string, scoped_id_column
from kinweft.operators import adapters, governance, materialize, normalize
from kinweft.plans import workload
from kinweft.session import staged as written

REQUEST = materialize.Request(workload.WORKSPACE, "s1", "k1", "generic_contacts_csv", "m", "1", workload.CLOCK, "0" * 64)


def _rows(spark: SparkSession, sf_dir: str, **fields: str) -> DataFrame:
    """Customers as scanned rows: ``row_number`` and some mapped fields, as SQL expressions."""
    return workload.star(spark, sf_dir, "customer").selectExpr("c_custkey AS row_number", *[f"{e} AS {f}" for f, e in fields.items()])


def row_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(
        spark, sf_dir, full_name="if(c_custkey % 11 = 0, '   ', concat('  ', c_name))", email="if(c_custkey % 7 = 0, 'nobody', concat(' U', c_custkey, '@Corp.Example '))", company_domain="if(c_custkey % 13 = 0, '??', concat('HTTPS://N', c_nationkey, '.Example/about'))",
        connected_on="case c_custkey % 5 when 0 then '2001-02-03' when 1 then '2001-02-03T04:05:06.789Z' when 2 then '3 Feb 2001' when 3 then 'someday' end", title="if(c_custkey % 17 = 0, concat('a', char(7), 'b'), c_mktsegment)",
    )
    made = materialize.canonical_rows(rows)
    return made.select("row_number", "full_name", "email", "company_domain", "connected_on", "reject_code")


def row_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize.canonical_rows(_rows(spark, sf_dir, full_name="c_name", company_name="if(c_custkey % 3 = 0, null, c_mktsegment)"))
    return materialize.stage_rows(made, ["full_name", "company_name"], REQUEST).select("row_number", "row_digest", "group_digest", "record_id")


def edge_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize.canonical_rows(_rows(spark, sf_dir, full_name="concat('N', c_nationkey)", company_name="c_mktsegment"))
    return materialize.groups(materialize.stage_rows(made, ["full_name", "company_name"], REQUEST)).select("group_digest", "row_number", F.size("records").cast("long").alias("n_evidence"), F.col("records")[0].alias("first_record"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of an import: one for each person, with the evidence of all equal rows."""
    rows = _rows(spark, sf_dir, full_name="concat('N', c_custkey % 700)", provider_person_id="concat('P', c_custkey % 700)")
    staged = materialize.stage_rows(materialize.canonical_rows(rows), ["full_name", "provider_person_id"], REQUEST)
    edges = materialize.materialize(staged, REQUEST, schemas.complete({}, spark))["relationship_edge"]
    return edges.select("relationship_edge_id", "destination_person_id", F.size("evidence_refs").cast("long").alias("n_evidence"), F.col("evidence_refs")[0].alias("first_evidence"), "eligible", "observed_at")


def person_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, full_name="concat('N', c_custkey)", provider_person_id="if(c_custkey % 3 = 0, concat('P', c_custkey % 50), null)", email="if(c_custkey % 3 < 2, concat('u', (c_custkey * 7) % 240, '@corp.example'), null)")
    staged = materialize.stage_rows(materialize.canonical_rows(rows), ["full_name"], REQUEST)
    made = materialize.resolve_people(materialize.groups(staged), schemas.empty(spark, "identity_claim"), REQUEST)
    made = written(made.select("row_number", "person_id", "person_outcome"), "resolved")
    counted = made.groupBy("person_id").agg(F.count("*").alias("person_rows"), F.min("row_number").alias("first_row"))
    return made.join(counted, "person_id").select("row_number", F.col("person_outcome").alias("outcome"), "person_rows", "first_row")


def organization_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = "case c_custkey % 4 when 0 then concat('d', (c_custkey * 3) % 130, '.example') when 1 then concat('d', (c_custkey * 3) % 130, '.example') when 3 then 'gmail.com' end"
    rows = _rows(spark, sf_dir, full_name="concat('N', c_custkey)", crm_account_id="if(c_custkey % 4 = 0, concat('C', c_custkey % 60), null)", company_domain=domain, company_name="if(c_custkey % 4 = 2, 'Some Firm', null)")
    staged = materialize.stage_rows(materialize.canonical_rows(rows), ["full_name"], REQUEST)
    made = materialize.resolve_organizations(materialize.groups(staged), schemas.empty(spark, "organization_claim"), REQUEST)
    made = written(made.select("row_number", "organization_id", "organization_outcome"), "resolved")
    counted = made.groupBy("organization_id").agg(F.count("*").alias("organization_rows"), F.min("row_number").alias("first_row"))
    return made.join(counted, "organization_id").select("row_number", F.col("organization_outcome").alias("outcome"), "organization_rows", "first_row")


def employment_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = workload.tables(spark, sf_dir)["employment_claim"].withColumns({"position": F.substring("employment_claim_id", 2, 20).cast("long"), "state": F.lit("current")})
    return materialize.employment_status(claims, "position", workload.CLOCK).select("employment_claim_id", "review_status")


def import_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = workload.star(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('r', o_orderkey % 300) AS raw_sha256", "concat('k', o_orderkey % 600) AS idempotency_key")
    snapshots = workload.star(spark, sf_dir, "supplier").selectExpr("concat('n', s_suppkey) AS source_snapshot_id", "concat('r', s_suppkey % 300) AS raw_sha256", "concat('k', s_suppkey % 600) AS idempotency_key")
    return materialize.idempotency(requests, snapshots).select("o_orderkey", "status", "same_snapshot")


def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize.dangling(workload.tables(spark, sf_dir), "evidence_ref").select("id", "missing")


def email_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case c_custkey % 4 when 0 then concat('  A.', c_custkey, '@X.Example') when 1 then concat('a b', c_custkey, '@x.example') when 2 then concat('a', c_custkey, '@x') else concat('t', char(9), c_custkey) end")
    return workload.star(spark, sf_dir, "customer").select("c_custkey", scalars.normalize_email(raw).alias("email"), scalars.is_email(scalars.normalize_email(raw)).alias("valid"), scalars.has_control(raw).alias("control"))


def profile_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case c_custkey % 4 when 0 then concat(' HTTPS://WWW.Site.Example/in/C', c_custkey, '/?x=1#top') when 1 then concat('https://site.example:443/p', c_custkey, '//') when 2 then concat('http://site.example/', c_custkey) else concat('https://site.example:8443/', c_custkey) end")
    return workload.star(spark, sf_dir, "customer").select("c_custkey", scalars.normalize_profile_url(raw).alias("url"))


def scoped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.star(spark, sf_dir, "nation").select("n_nationkey", scoped_id_column(workload.WORKSPACE, "nation", json_object({"name": json_string(F.col("n_name"))})).alias("id"))


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("case c_custkey % 3 when 0 then concat('=', c_name, '\"') when 1 then c_mktsegment end")
    return workload.star(spark, sf_dir, "customer").select("c_custkey", scalars.csv_cell(text).alias("cell"))


def source_class_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.expr("case c_custkey % 3 when 0 then 'connections_csv' when 1 then ' CRM ' else 'other' end")
    kind = F.expr("case c_custkey % 5 when 0 then 'x_Connections_Export' when 1 then 'generic_contacts_csv' when 2 then 'crm' when 3 then 'other' else 'connections_csv' end")
    return workload.star(spark, sf_dir, "customer").select("c_custkey", scalars.source_class_covers(held, kind).alias("covered"))


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workload.star(spark, sf_dir, "events").select(F.concat(F.lit("w"), F.col("user_id") % 20).alias("workspace_id"), F.col("event_id").alias("sequence"), "event_type")
    return governance.latest_events(events.withColumnRenamed("event_type", "hash"))


def adapter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts of provider records: allowed fields, the time window, repeats and rebindings."""
    line = workload.star(spark, sf_dir, "orders")
    fields = F.expr("if(o_orderkey % 9 = 0, '{\"title\":\"x\",\"secret\":\"y\"}', '{\"title\":\"x\"}')")
    records = line.select(F.lit("a").alias("adapter_authorization_id"), F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 8)).alias("provider_record_id"), scalars.iso_millis(F.to_timestamp("o_orderdate")).alias("observed_at"), F.expr("concat('d', floor(o_orderkey / 8), if(floor(o_orderkey / 8) % 10 = 0, o_orderstatus, ''))").alias("record_digest_sha256"), fields.alias("fields"), "o_orderkey")
    stored = line.where("floor(o_orderkey / 8) % 7 = 0").select(F.lit("a").alias("adapter_authorization_id"), F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / 8)).alias("provider_record_id"), F.concat(F.lit("d"), F.floor(F.col("o_orderkey") / 8)).alias("record_digest_sha256")).distinct()
    made = adapters.accept(records, stored, ["title"], "1993-01-01T00:00:00.000Z", "1997-01-01T00:00:00.000Z", "o_orderkey")
    return made.groupBy("verdict").agg(F.count("*").alias("n"))


def adapter_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim that provider records make of people, organizations and employments."""
    records = workload.star(spark, sf_dir, "customer").selectExpr(
        "concat('p', c_custkey) AS provider_record_id", "if(c_custkey % 2 = 0, 'crm', 'mail') AS kind", "'2001-01-01T00:00:00.000Z' AS observed_at", "concat('d', c_custkey) AS record_digest_sha256", "1L AS byte_count", "concat(' ', c_name) AS person_name",
        "if(c_custkey % 3 = 0, concat('u', c_custkey % 50), null) AS person_provider_id", "if(c_custkey % 4 = 0, concat('A', c_custkey, '@X.example'), null) AS person_email", "if(c_custkey % 7 <> 0, c_mktsegment, null) AS organization_name",
        "if(c_custkey % 2 = 1, concat('n', c_nationkey, '.example'), '') AS organization_domain", "if(c_custkey % 5 = 0, concat('c', c_custkey), null) AS crm_contact_id", "if(c_custkey % 3 = 1, concat('a', c_nationkey), null) AS crm_account_id",
    )
    made = normalize.normalize(records, normalize.Source(workload.WORKSPACE, "auth", "prov", "ten", "who", "consent", workload.CLOCK))
    shown = (("identity_claim", "person_id", "kind", "value"), ("organization_claim", "organization_id", "kind", "value"), ("employment_claim", "person_id", "state", "organization_id"))
    parts = [made[t].select(F.col(f"{t}_id").alias("claim_id"), F.col(who).alias("subject_id"), F.col(kind).alias("kind"), F.col(value).alias("value")) for t, who, kind, value in shown]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (adapter_normalization, row_canonicalize, row_staging, edge_derivation, import_edges, person_resolution, organization_resolution, employment_derivation, import_idempotency, referential_check, email_functions, profile_url_normalize, scoped_ids, csv_cells, source_class_cover, latest_event, adapter_verdicts)
    return {f.__name__: f for f in made}


def _hmac(kind: str, body: str) -> str:
    """A keyed id of this workspace in SQL, by the definition of HMAC over SHA-256."""
    key = workload.WORKSPACE.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"'{kind}_' || substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('{kind}' || chr(10) || {body})))), 1, 32)"


_RECORD = """'{"rowDigest":"' || {d} || '","rowNumber":' || {n} || ',"sourceSnapshotId":"' || '{s}' || '"}'"""


def _record(digest: str, number: str) -> str:
    return _hmac("record", _RECORD.replace("{d}", digest).replace("{n}", number).replace("{s}", REQUEST.snapshot()))


def _resolution(subject: str, other: str) -> str:
    """Rows (k, strong, weak): the strong identifier decides; weak ones ask who carried theirs before."""
    return f"""
s AS (SELECT *, min(k) OVER (PARTITION BY strong) AS head FROM r WHERE strong IS NOT NULL),
w AS (SELECT r.k, r.weak, (SELECT count(DISTINCT s.strong) FROM s WHERE s.weak = r.weak AND s.k < r.k) AS c, (SELECT min(s.strong) FROM s WHERE s.weak = r.weak AND s.k < r.k) AS one, min(r.k) OVER (PARTITION BY r.weak) AS f FROM r WHERE r.strong IS NULL AND r.weak IS NOT NULL),
h AS (SELECT w.*, first_value(c) OVER (PARTITION BY weak ORDER BY k) AS c0 FROM w),
x AS (SELECT k, CASE WHEN k = head THEN 'new' ELSE 'exact' END AS outcome, 's' || strong AS who FROM s
  UNION ALL SELECT k, CASE WHEN n = 0 THEN 'new' WHEN n = 1 THEN 'exact' ELSE 'review' END, CASE WHEN n = 0 OR (n = 1 AND c = 0) THEN 'w' || weak WHEN n = 1 THEN 's' || one ELSE {other} END
    FROM (SELECT *, c + CASE WHEN k > f AND c0 = 0 THEN 1 ELSE 0 END AS n FROM h)
  {subject})
SELECT k AS row_number, outcome, count(*) OVER (PARTITION BY who) AS {{rows}}, min(k) OVER (PARTITION BY who) AS first_row FROM x"""


_DIGEST = "sha256('{' || CASE WHEN company IS NULL THEN '' ELSE '\"company_name\":\"' || company || '\",' END || '\"full_name\":\"' || name || '\"}')"

def _json(**fields: str) -> str:
    """A JSON object of SQL texts, its keys in the order given."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in fields.items()) + " || '}'"


_BOUND = _json(adapterAuthorizationId="'auth'", providerRecordId="'p' || k", providerTenantId="'ten'", recordDigest="'d' || k")

SQL = {
    "adapter_normalization": f"""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS n, c_custkey % 2 = 0 AS crm, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS org FROM customer),
r AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'u' || (k % 50) WHEN crm AND k % 5 = 0 THEN 'c' || k ELSE 'p' || k END AS anchor, CASE WHEN crm AND k % 3 = 1 THEN 'a' || n END AS account, CASE WHEN NOT crm THEN 'n' || n || '.example' END AS domain FROM c),
a AS (SELECT *, {_hmac("adapter_snapshot", _BOUND)} AS snap, {_hmac("person", _json(namespace="'prov:ten'", personAnchor="anchor"))} AS person, {_hmac("organization", _json(namespace="'prov:ten'", organizationAnchor="coalesce(account, domain, org)"))} AS firm FROM r),
i AS (SELECT snap, person, 'name' AS kind, name AS v FROM a UNION ALL SELECT snap, person, 'provider_id', anchor FROM a UNION ALL SELECT snap, person, 'email', 'a' || k || '@x.example' FROM a WHERE k % 4 = 0),
o AS (SELECT snap, firm, 'name' AS kind, org AS v FROM a WHERE org IS NOT NULL UNION ALL SELECT snap, firm, 'domain', domain FROM a WHERE org IS NOT NULL AND domain IS NOT NULL UNION ALL SELECT snap, firm, 'crm_id', account FROM a WHERE org IS NOT NULL AND account IS NOT NULL)
SELECT {_hmac("adapter_identity", _json(kind="kind", personId="person", snapshotId="snap", value="v"))} AS claim_id, person AS subject_id, kind, v AS value FROM i
UNION ALL SELECT {_hmac("adapter_org_claim", _json(kind="kind", organizationId="firm", snapshotId="snap", value="v"))}, firm, kind, v FROM o
UNION ALL SELECT {_hmac("adapter_employment", _json(organizationId="firm", personId="person", snapshotId="snap"))}, person, 'unknown', firm FROM a WHERE org IS NOT NULL""",
    "row_canonicalize": r"""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 7 = 0 THEN 'nobody' ELSE 'u' || c_custkey || '@corp.example' END AS email,
  CASE WHEN c_custkey % 13 <> 0 THEN 'n' || c_nationkey || '.example' END AS company_domain, CASE c_custkey % 5 WHEN 0 THEN '2001-02-03T00:00:00.000Z' WHEN 1 THEN '2001-02-03T04:05:06.789Z' WHEN 2 THEN '2001-02-03T00:00:00.000Z' END AS connected_on FROM customer)
SELECT k AS row_number, full_name, email, company_domain, connected_on, CASE WHEN k % 17 = 0 THEN 'CONTROL_CHARACTER_REJECTED' WHEN k % 7 = 0 THEN 'INVALID_EMAIL' WHEN k % 13 = 0 THEN 'INVALID_COMPANY_DOMAIN' WHEN k % 5 = 3 THEN 'INVALID_OBSERVED_AT' WHEN k % 11 = 0 THEN 'PERSON_NAME_REQUIRED' END AS reject_code FROM r""",
    "row_staging": f"""WITH r AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS company FROM customer), d AS (SELECT k, {_DIGEST} AS d FROM r)
SELECT k AS row_number, d AS row_digest, d AS group_digest, {_record("d", "k")} AS record_id FROM d""",
    "edge_derivation": f"""WITH r AS (SELECT min(c_custkey) AS k, count(*) AS n, 'N' || c_nationkey AS name, c_mktsegment AS company FROM customer GROUP BY c_nationkey, c_mktsegment), d AS (SELECT k, n, {_DIGEST} AS d FROM r)
SELECT d AS group_digest, k AS row_number, n AS n_evidence, {_record("d", "k")} AS first_record FROM d""",
    "import_edges": f"""WITH r AS (SELECT c_custkey AS k, 'N' || (c_custkey % 700) AS name, 'P' || (c_custkey % 700) AS pid FROM customer),
d AS (SELECT k, pid, sha256('{{"full_name":"' || name || '","provider_person_id":"' || pid || '"}}') AS d FROM r),
g AS (SELECT pid, count(*) AS n, min(k) AS k, any_value(d) AS d FROM d GROUP BY pid),
p AS (SELECT n, {_record("d", "k")} AS rec, {_hmac("person", """'{"anchor":["provider_id","' || pid || '"],"namespace":"' || '""" + REQUEST.source_kind + """' || '"}'""")} AS person FROM g)
SELECT {_hmac("edge", _json(contributorId="'" + REQUEST.contributor + "'", personId="person", sourceSnapshotId="'" + REQUEST.snapshot() + "'"))} AS relationship_edge_id, person AS destination_person_id, n AS n_evidence,
  {_hmac("evidence", _json(claimType="'relationship'", sourceRecordId="rec", sourceSnapshotId="'" + REQUEST.snapshot() + "'"))} AS first_evidence, true AS eligible, '{workload.CLOCK}' AS observed_at FROM p""",
    "person_resolution": "WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'P' || (c_custkey % 50) END AS strong, CASE WHEN c_custkey % 3 < 2 THEN 'u' || ((c_custkey * 7) % 240) END AS weak FROM customer),"
    + _resolution("UNION ALL SELECT k, 'review', 'n' || k FROM r WHERE strong IS NULL AND weak IS NULL", "'u' || k").replace("{rows}", "person_rows"),
    "organization_resolution": "WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'C' || (c_custkey % 60) END AS strong, CASE WHEN c_custkey % 4 < 2 THEN 'd' || ((c_custkey * 3) % 130) END AS weak FROM customer),"
    + _resolution("UNION ALL SELECT k, 'review', CASE WHEN k % 4 = 3 THEN 'gmail' ELSE 'firm' END FROM r WHERE strong IS NULL AND weak IS NULL", "'w' || weak").replace("{rows}", "organization_rows"),
    "employment_derivation": """SELECT 'm' || a.o_orderkey AS employment_claim_id, CASE WHEN EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.o_orderkey % 25 <> a.o_orderkey % 25 AND abs(epoch_ms(a.o_orderdate) - epoch_ms(b.o_orderdate)) <= 31536000000) THEN 'conflicted'
  WHEN epoch_ms(TIMESTAMP '2001-08-02 00:00:00') - epoch_ms(a.o_orderdate) > 31536000000 THEN 'unreviewed' ELSE 'approved' END AS review_status FROM orders a""",
    "import_idempotency": """WITH s AS (SELECT 'k' || (s_suppkey % 600) AS key, min('n' || s_suppkey) AS id FROM supplier GROUP BY ALL), b AS (SELECT DISTINCT 'r' || (s_suppkey % 300) AS raw FROM supplier)
SELECT o_orderkey, CASE WHEN s.id IS NOT NULL THEN 'idempotent' WHEN b.raw IS NOT NULL THEN 'rebinding' ELSE 'committed' END AS status, s.id AS same_snapshot FROM orders LEFT JOIN s ON s.key = 'k' || (o_orderkey % 600) LEFT JOIN b ON b.raw = 'r' || (o_orderkey % 300)""",
    "referential_check": """WITH e AS (SELECT l_suppkey AS s, o_custkey AS c, max(l_shipdate) AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
months AS (SELECT DISTINCT * FROM (SELECT l_suppkey AS who, strftime(l_shipdate, '%Y%m') AS month FROM lineitem UNION ALL SELECT o_orderkey % 10, strftime(o_orderdate, '%Y%m') FROM orders UNION ALL SELECT c_custkey % 10, '199501' FROM customer)),
there AS (SELECT 'n' || who || '_' || month AS n FROM months WHERE (who * 100 + month::INT) % 89 <> 0),
refs AS (SELECT 'er' || s || '_' || c AS id, 'n' || s || '_' || strftime(seen, '%Y%m') AS n FROM e UNION ALL SELECT 'ee' || o_orderkey, 'n' || (o_orderkey % 10) || '_' || strftime(o_orderdate, '%Y%m') FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT 'eo' || o_orderkey, 'n' || (o_orderkey % 10) || '_' || strftime(o_orderdate, '%Y%m') FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'ei' || c_custkey, 'n' || (c_custkey % 10) || '_199501' FROM customer)
SELECT id, n AS missing FROM refs WHERE n NOT IN (SELECT n FROM there)""",
    "email_functions": """SELECT c_custkey, e AS email, regexp_full_match(e, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS valid, c_custkey % 4 = 3 AS control FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a.' || c_custkey || '@x.example' WHEN 1 THEN 'a b' || c_custkey || '@x.example' WHEN 2 THEN 'a' || c_custkey || '@x' ELSE 't' || chr(9) || c_custkey END AS e FROM customer)""",
    "profile_url_normalize": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://www.site.example/in/C' || c_custkey WHEN 1 THEN 'https://site.example/p' || c_custkey WHEN 3 THEN 'https://site.example:8443/' || c_custkey END AS url FROM customer",
    "scoped_ids": f"""SELECT n_nationkey, {_hmac("nation", "'{\"name\":\"' || n_name || '\"}'")} AS id FROM nation""",
    "csv_cells": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '"''=' || c_name || '\"\""' WHEN 1 THEN '"' || c_mktsegment || '"' ELSE '""' END AS cell FROM customer""",
    "source_class_cover": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 5 IN (0, 1, 4) WHEN 1 THEN c_custkey % 5 = 2 ELSE c_custkey % 5 = 3 END AS covered FROM customer",
    "latest_event": "SELECT 'w' || (user_id % 20) AS workspace_id, max(event_id) AS sequence, arg_max(event_type, event_id) AS hash FROM events GROUP BY ALL",
    "adapter_verdicts": """WITH r AS (SELECT o_orderkey AS o, o_orderkey // 8 AS p, o_orderdate AS seen, 'd' || (o_orderkey // 8) || CASE WHEN (o_orderkey // 8) % 10 = 0 THEN o_orderstatus ELSE '' END AS d FROM orders),
x AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY seen, d) AS place, (SELECT count(DISTINCT q.d) FROM r q WHERE q.p = r.p) AS ds FROM r)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o % 9 = 0 THEN 'FIELD_NOT_AUTHORIZED' WHEN seen < DATE '1993-01-01' OR seen > DATE '1997-01-01' THEN 'RECORD_OUTSIDE_TIME_WINDOW' WHEN ds > 1 OR (p % 7 = 0 AND d <> 'd' || p) THEN 'PROVIDER_RECORD_REBINDING_REJECTED' WHEN p % 7 = 0 OR place > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM x) GROUP BY verdict""",
}
