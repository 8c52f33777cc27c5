"""Queries over files, authorizations, changes of consents, withdrawals and audit chains; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.functions import digest
from kinweft.operators import adapters, consent, governance, operations
from kinweft.operators.materialize import Request
from kinweft.plans import workload
from kinweft.session import shared_dir, staged
from kinweft.sources import csv_scan
from kinweft.sources.csv_scan import Mapping
from kinweft.sources.store import Store

#: Rows of a file that the queries write, about; a file may have 100,000.
FILE_ROWS = 2000


def _mapping(limits: dict[str, int] | None = None, **headers: str) -> Mapping:
    columns = [{"sourceHeader": h, "targetField": t, "required": False} for h, t in headers.items()]
    return Mapping.read({"delimiter": ",", "header": {"mode": "detect_required_headers", "maxPreambleLines": 2}, "columns": columns, "limits": limits or {}})


def _quoted(column: str) -> str:
    return f"concat('\"', replace(coalesce(cast({column} AS string), ''), '\"', '\"\"'), '\"')"


def _files(spark: SparkSession, rows: DataFrame) -> str:
    """Write (file, place, value) as one text file for each ``file``, its lines by ``place``; a glob of the files."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    rows.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    return f"{path}/*/*.txt"


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as CSV files, with their line breaks and quotes, and scanned again."""
    docs = workload.star(spark, sf_dir, "documents")
    n = max(4, -(-docs.count() // FILE_ROWS))
    body = docs.selectExpr(f"doc_id % {n} AS file", "doc_id AS place", f"concat_ws(',', {_quoted('lang')}, cast(doc_id AS string), {_quoted('text')}) AS value")
    # every other file has a line before its header, and a blank is allowed around the names
    head = spark.range(n).selectExpr("id AS file", "-1L AS place", "concat(if(id % 2 = 1, 'exported\\n', ''), 'Lang,\"Doc\",text') AS value")
    found = csv_scan.scan(spark, _files(spark, body.unionByName(head)), _mapping(LANG="first_name", doc="last_name", Text="title"))
    return found.select(F.col("fields")["last_name"].cast("long").alias("doc_id"), F.col("fields")["first_name"].alias("lang"), F.sha2(F.col("fields")["title"], 256).alias("text_sha256"), "preamble_lines", "row_digest", "error")


#: What is wrong with the file of each nation, by its key: nothing, or a mistake in its last line or its header.
_MISTAKES = {1: "'\"open'", 2: "'a,b,c'", 5: "'x\"y,b'", 6: "concat(repeat('long', 30), ',b')"}


def csv_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each nation's customers, some with a mistake: its rows, or the code that it is refused with."""
    nations, customers = (workload.star(spark, sf_dir, t) for t in ("nation", "customer"))
    head = nations.selectExpr("n_nationkey AS file", "-1L AS place", "case n_nationkey % 7 when 3 then 'One,Two' when 4 then 'Name,Segment,NAME' else 'Name,Segment' end AS value")
    body = customers.selectExpr("c_nationkey AS file", "cast(c_custkey AS long) AS place", f"concat({_quoted('c_name')}, ',', c_mktsegment) AS value")
    last = nations.where(F.expr("n_nationkey % 7").isin(*_MISTAKES)).selectExpr("n_nationkey AS file", "9223372036854775807L AS place", f"case n_nationkey % 7 {' '.join(f'when {k} then {v}' for k, v in _MISTAKES.items())} end AS value")
    path = _files(spark, head.unionByName(body).unionByName(last))
    found = csv_scan.scan(spark, path, _mapping({"maxFieldBytes": 100}, Name="full_name", Segment="title"))
    return found.groupBy(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("nation"), "error").agg(F.count("row_number").alias("n_rows"))


#: Customers of one import; a file may have 100,000 rows.
IMPORT_ROWS = 50_000


def import_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each table of a new store has after all customers were imported from CSV files."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:12]}")
    tables = workload.tables(spark, sf_dir)
    one = {k: tables[k].where(f"{key} = '{value}'") for k, key, value in (("workspace", "workspace_id", workload.WORKSPACE), ("contributor", "contributor_id", "s1"), ("consent", "consent_record_id", "k1"))}
    store.commit(one | {"consent": one["consent"].withColumn("source_classes", F.array(F.lit("connections_csv")))})
    rows = workload.star(spark, sf_dir, "customer").withColumn("file", F.floor(F.col("c_custkey") / IMPORT_ROWS))
    body = rows.selectExpr("file", "cast(c_custkey AS long) AS place", f"concat_ws(',', {_quoted('c_name')}, concat('P', c_custkey), concat('n', c_nationkey, '.example')) AS value")
    paths = _files(spark, body.unionByName(rows.select("file").distinct().selectExpr("file", "-1L AS place", "'Name,Id,Domain' AS value")))
    mapping = _mapping(Name="full_name", Id="provider_person_id", Domain="company_domain")
    # all files are scanned at once and imported as one commit, each resolved against those before it
    scan = operations.scan_together(store, paths, mapping, None)
    places = sorted((int(r["path"].split("/file=")[1].split("/")[0]), r["path"]) for r in scan.about.select("path").collect())
    operations.import_files(store, {p: Request(workload.WORKSPACE, "s1", "k1", "generic_contacts_csv", f"m{i}", "1", workload.CLOCK, "") for i, p in places}, scan)
    made = store.tables()
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in made.items()]).where("n > 0")


def adapter_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order, seen as an authorization, lets an adapter read at the clock; the first reason against it."""
    held = workload.star(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 11 = 0, 'v', 'w') AS workspace_id", "if(o_orderkey % 13 = 0, 'other', 'adapter') AS adapter_id", "'crm' AS provider", "if(o_orderkey % 17 = 0, 'other', 'coverage') AS purpose_id", "if(o_orderkey % 5 = 0, '1999-01-01T00:00:00.000Z', null) AS revoked_at", "if(o_orderkey % 7 = 0, 'paused', 'active') AS status",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS authorized_at", "if(o_orderkey % 3 = 0, '2001-08-02T00:00:00.000Z', '2002-01-01T00:00:00.000Z') AS expires_at", "if(o_orderkey % 2 = 0, array('read'), array('list', 'read')) AS capabilities",
    )
    return held.select("o_orderkey", adapters.refusal(workload.WORKSPACE, "adapter", "crm", workload.PURPOSE, "list", workload.clock()).alias("refusal"))


def consent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids each supplier's consent to become another one."""
    old = workload.tables(spark, sf_dir)["consent"].withColumn("k", F.substring("consent_record_id", 2, 20).cast("long"))
    new = {
        "contributor_id": "if(k % 4 = 0, 'someone', contributor_id)", "purpose_id": "purpose_id", "authorization_basis": "if(k % 5 = 0, 'other', authorization_basis)", "source_classes": "if(k % 3 = 0, array_append(source_classes, 'more'), source_classes)",
        "allowed_categories": "if(k % 2 = 0, slice(allowed_categories, 1, 1), allowed_categories)", "status": "'active'",
    }
    made = old.select("consent_record_id", F.struct(*new).alias("old"), F.struct(*[F.expr(e).alias(c) for c, e in new.items()]).alias("new"))
    return made.select("consent_record_id", F.array_join(governance.change_codes(F.col("old"), F.col("new")), "|").alias("errors"))


def alias_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which aliases hold that a configuration names: each nation's has another thing that may be wrong."""
    nation = workload.star(spark, sf_dir, "nation")
    keys = [r[0] for r in nation.select("n_nationkey").collect()]  # a configuration names them one by one
    config = {"approvedOrganizationAliases": [{"aliasId": f"a{k}", "organizationAliasCandidateId": f"z{k}", "organizationId": f"o{k}", "sourceOrganizationId": f"p{k}", "kind": "name", "value": f" N{k} ", "approvedReviewDecisionId": f"d{k}"} for k in keys]}
    table = lambda name, exprs: nation.select(*[F.expr(exprs.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in schemas.schema(name).fields])
    candidates = table("organization_alias_candidate", {"organization_alias_candidate_id": "concat('z', n_nationkey)", "proposed_organization_id": "concat('p', n_nationkey)", "alias_kind": "'name'", "alias_value": "if(n_nationkey % 8 = 1, 'else', concat('n', n_nationkey))", "conflict_organization_ids": "if(n_nationkey % 8 = 2, array('q'), array(concat('o', n_nationkey)))", "status": "if(n_nationkey % 8 = 3, 'pending', 'approved')", "approved_canonical_organization_id": "concat('o', n_nationkey)"})
    said = "named_struct('source_organization_id', concat('p', n_nationkey), 'canonical_organization_id', if(n_nationkey % 8 = 4, 'q', concat('o', n_nationkey)), 'alias_kind', 'name', 'alias_value', concat('N', n_nationkey))"
    yes = {"review_decision_id": "concat('d', n_nationkey)", "subject_type": "'organization_alias'", "subject_id": "concat('z', n_nationkey)", "actor_id": "'a'", "decision": "'approve'", "reason": "if(n_nationkey % 8 = 5, ' ', 'same')", "decided_at": "if(n_nationkey % 8 = 6, '2002-01-01T00:00:00.000Z', '2001-01-01T00:00:00.000Z')", "prior_state": "'pending'", "organization_alias_authorization": said}
    later = yes | {"review_decision_id": "concat('x', n_nationkey)", "decision": "if(n_nationkey % 8 = 7, 'reject', 'approve')", "decided_at": "'2001-02-01T00:00:00.000Z'"}
    decisions = table("review_decision", yes).unionByName(table("review_decision", later))
    return consent.authorized_aliases(candidates, decisions, config, workload.clock()).select("alias_id", "source_organization_id", "organization_id")


def withdrawal_dependants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the stored tables that rest on one consent, by the index of what rests on what."""
    tables = workload.tables(spark, sf_dir)
    found = governance.postings(tables)
    return found.where("consent_record_id = 'k2'").select("table_name", "row_id")


def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of all consents' grants, and the first event at which it breaks after one was changed."""
    events = workload.tables(spark, sf_dir)["consent"].selectExpr("workspace_id", "consent_record_id AS place", "'consent.granted' AS event_type", "'actor' AS actor_id", f"'{workload.CLOCK}' AS occurred_at", "'consent' AS subject_type", "consent_record_id AS subject_id", "concat('{\"id\":\"', consent_record_id, '\"}') AS payload")
    return governance.first_break(staged(governance.chained_frame(events), "chain").withColumn("actor_id", F.when(F.col("sequence") == 20, "someone").otherwise(F.col("actor_id"))))


def user_audit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of each user's events, its last hash, and where it breaks after every fifth user's third event was changed."""
    events = workload.star(spark, sf_dir, "events").selectExpr("concat('w', user_id) AS workspace_id", "event_id AS place", "event_type", "'actor' AS actor_id", f"'{workload.CLOCK}' AS occurred_at", "'event' AS subject_type", "cast(event_id AS string) AS subject_id", "'{}' AS payload")
    chain = staged(governance.chained_frame(events), "chain")  # made once, and read by all that follows
    head = chain.groupBy("workspace_id").agg(F.max_by("hash", "sequence").alias("head"))
    changed = chain.withColumn("actor_id", F.when((F.col("sequence") == 3) & (F.substring("workspace_id", 2, 20).cast("long") % 5 == 0), "someone").otherwise(F.col("actor_id")))
    return governance.first_break(changed).join(head, "workspace_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (csv_documents, csv_refusals, import_commit, adapter_authorizations, consent_changes, alias_authorizations, withdrawal_dependants, audit_chain_verify, user_audit_chains)
    return {f.__name__: f for f in made}


def _event(previous: str, kind: str, payload: str, subject: str, subject_type: str, workspace: str, actor: str = "'actor'") -> str:
    """The hash of an event in SQL; the arguments are SQL texts."""
    return f"""sha256('{{"actorId":"' || {actor} || '","eventType":"' || {kind} || '","occurredAt":"{workload.CLOCK}","payloadSha256":"' || sha256({payload}) || '","previousHash":' || {previous} || ',"sequence":' || e.n || ',"subjectId":"' || {subject} || '","subjectType":"{subject_type}","workspaceId":"' || {workspace} || '"}}')"""


def _of_user(previous: str) -> str:
    return _event(previous, "e.event_type", "'{}'", "e.event_id", "event", "'w' || e.u")


def _of_consent(previous: str, actor: str = "'actor'") -> str:
    return _event(previous, "'consent.granted'", """'{"id":"' || e.k || '"}'""", "e.k", "consent", f"'{workload.WORKSPACE}'", actor)


SQL = {
    "csv_documents": """WITH n AS (SELECT greatest(4, ceil(count(*) / 2000.0)::BIGINT) AS n FROM documents)
SELECT doc_id, lang, sha256(coalesce(text, '')) AS text_sha256, (doc_id % n % 2)::INT AS preamble_lines, sha256('{"Doc":"' || doc_id || '","Lang":' || to_json(coalesce(lang, '')) || ',"text":' || to_json(coalesce(text, '')) || '}') AS row_digest, NULL::VARCHAR AS error FROM documents, n""",
    "csv_refusals": """WITH e AS (SELECT n_nationkey::BIGINT AS nation, CASE n_nationkey % 7 WHEN 1 THEN 'MALFORMED_QUOTING' WHEN 2 THEN 'COLUMN_COUNT_MISMATCH' WHEN 3 THEN 'HEADER_NOT_FOUND' WHEN 4 THEN 'HEADER_COLLISION' WHEN 5 THEN 'MALFORMED_QUOTING' WHEN 6 THEN 'FIELD_TOO_LARGE' END AS error FROM nation)
SELECT nation, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM customer WHERE c_nationkey = nation) ELSE 0 END AS n_rows FROM e""",
    "import_commit": """WITH c AS (SELECT c_custkey // 50000 AS f, c_nationkey AS n FROM customer), a AS (SELECT count(*) AS rows, count(DISTINCT f) AS files, count(DISTINCT n) AS firms, count(DISTINCT (f, n)) AS claims FROM c)
SELECT unnest(['workspace', 'contributor', 'consent', 'person', 'identity_claim', 'organization', 'organization_claim', 'employment_claim', 'relationship_edge', 'evidence_ref', 'source_snapshot', 'import_transaction', 'audit_event']) AS table_name,
  unnest([1, 1, 1, rows, 2 * rows, firms, claims, rows, rows, 4 * rows, files, files, files]) AS n FROM a""",
    "adapter_authorizations": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'ADAPTER_AUTHORIZATION_WORKSPACE_MISMATCH' WHEN o_orderkey % 13 = 0 THEN 'ADAPTER_AUTHORIZATION_ADAPTER_MISMATCH' WHEN o_orderkey % 17 = 0 THEN 'ADAPTER_AUTHORIZATION_PURPOSE_MISMATCH'
  WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'ADAPTER_AUTHORIZATION_REVOKED' WHEN o_orderdate > TIMESTAMP '2001-08-02 00:00:00' OR o_orderkey % 3 = 0 THEN 'ADAPTER_AUTHORIZATION_NOT_ACTIVE' WHEN o_orderkey % 2 = 0 THEN 'ADAPTER_CAPABILITY_DENIED' END AS refusal FROM orders""",
    "consent_changes": """SELECT 'k' || s_suppkey AS consent_record_id, array_to_string(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'CONSENT_CONTRIBUTOR_ID_CHANGED' END, CASE WHEN s_suppkey % 5 = 0 THEN 'CONSENT_AUTHORIZATION_BASIS_CHANGED' END, CASE WHEN s_suppkey % 3 = 0 THEN 'CONSENT_SOURCE_CLASSES_WIDENED' END,
  CASE WHEN s_suppkey % 10 = 7 THEN 'CONSENT_REACTIVATED' END], lambda x: x IS NOT NULL), '|') AS errors FROM supplier""",
    "alias_authorizations": "SELECT 'a' || n_nationkey AS alias_id, 'p' || n_nationkey AS source_organization_id, 'o' || n_nationkey AS organization_id FROM nation WHERE n_nationkey % 8 = 0",
    "withdrawal_dependants": """WITH e AS (SELECT l_suppkey AS s, o_custkey AS c, max(l_shipdate) AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT DISTINCT month FROM (SELECT strftime(l_shipdate, '%Y%m') AS month FROM lineitem WHERE l_suppkey = 2 UNION ALL SELECT strftime(o_orderdate, '%Y%m') FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT '199501' FROM customer WHERE c_custkey % 10 = 2) WHERE (2 * 100 + month::INT) % 89 <> 0),
o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 = 2 AND strftime(o_orderdate, '%Y%m') IN (SELECT month FROM m)),
p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 2 AND '199501' IN (SELECT month FROM m))
SELECT 'source_snapshot' AS table_name, 'n2_' || month AS row_id FROM m UNION ALL SELECT 'relationship_edge', 'e2_' || c FROM e WHERE s = 2 UNION ALL SELECT 'evidence_ref', 'er2_' || c FROM e WHERE s = 2 AND strftime(seen, '%Y%m') IN (SELECT month FROM m)
UNION ALL SELECT 'evidence_ref', 'ee' || k FROM o WHERE k % 97 <> 0 UNION ALL SELECT 'evidence_ref', 'eo' || k FROM o WHERE k % 3 = 0 UNION ALL SELECT 'evidence_ref', 'ei' || k FROM p
UNION ALL SELECT 'employment_claim', 'm' || k FROM o WHERE k % 97 <> 0 UNION ALL SELECT 'organization_claim', 'g' || k FROM o WHERE k % 3 = 0 UNION ALL SELECT 'identity_claim', 'i' || k FROM p""",
    "audit_chain_verify": f"""WITH RECURSIVE e AS (SELECT 'k' || s_suppkey AS k, row_number() OVER (ORDER BY 'k' || s_suppkey) AS n FROM supplier),
c AS (SELECT n, k, 'null' AS prev, {_of_consent("'null'")} AS h FROM e WHERE n = 1 UNION ALL SELECT e.n, e.k, '"' || c.h || '"', {_of_consent("'\"' || c.h || '\"'")} FROM c JOIN e ON e.n = c.n + 1),
x AS (SELECT e.n, e.h <> {_of_consent("e.prev", "CASE WHEN e.n = 20 THEN 'someone' ELSE 'actor' END")} AS bad FROM c e)
SELECT '{workload.WORKSPACE}' AS workspace_id, count(*) AS events, min(n) FILTER (bad) - 1 AS first_index, CASE WHEN bool_or(bad) THEN 'event hash mismatch' END AS reason FROM x""",
    "user_audit_chains": f"""WITH RECURSIVE e AS (SELECT user_id AS u, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT u, n, {_of_user("'null'")} AS h FROM e WHERE n = 1 UNION ALL SELECT e.u, e.n, {_of_user("'\"' || c.h || '\"'")} FROM c JOIN e ON e.u = c.u AND e.n = c.n + 1)
SELECT 'w' || u AS workspace_id, max(n) AS events, arg_max(h, n) AS head, CASE WHEN u % 5 = 0 AND max(n) >= 3 THEN 2 END AS first_index, CASE WHEN u % 5 = 0 AND max(n) >= 3 THEN 'event hash mismatch' END AS reason FROM c GROUP BY u""",
}
