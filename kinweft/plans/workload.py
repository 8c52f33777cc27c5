"""The star-schema tables seen as a contact network, by arithmetic on their keys.

Suppliers are contributors with one consent each, customers are people, nations organizations, orders employment
claims, and each pair of supplier and customer that traded is a relationship edge.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import instant
from kinweft.session import staged

WORKSPACE, CLOCK, PURPOSE = "w", "2001-08-02T00:00:00.000Z", "coverage"
SEGMENTS = ("AUTOMOBILE", "BUILDING")


def clock() -> datetime:
    return instant(CLOCK)


POLICY: dict[str, Any] = {
    "workspaceId": WORKSPACE, "policyId": "p", "version": "1", "effectiveAt": "2000-01-01T00:00:00.000Z", "purposeId": PURPOSE, "allowedCategories": ["A", "B", "C", "D"],
    "directScope": "A_ICP_FIT_INCLUDING_TARGETS_B_TARGET_LIST_ONLY", "brokerScope": "C_D_TARGET_LIST_ONLY", "requireBrokerIndividualConsent": True, "networkMode": "disabled", "externalMutations": False,
}


def _rule(name: str, field: str, operator: str, value: Any, weight: int, required: bool = True) -> dict[str, Any]:
    return {"ruleId": name, "field": field, "operator": operator, "value": value, "required": required, "weight": weight}


def config(suppliers: int) -> dict[str, Any]:
    """Targets are the nations whose key divides by three; direct contributors the suppliers whose key divides by four.

    Inactive suppliers (keys ending in 7) never divide by four, so every direct contributor is active.
    """
    return {
        "workspaceId": WORKSPACE, "configId": "c", "version": "1", "directContributorIds": [f"s{k}" for k in range(0, suppliers + 1, 4)],
        "icpRuleSet": {"ruleSetId": "icp", "version": "1", "mode": "all", "rules": [_rule("r_region", "geography", "in", ["r0", "r1", "r2"], 60), _rule("r_size", "employee_count", "range", {"min": 5}, 40, False)]},
        "stakeholderPersonaRuleSet": {"ruleSetId": "persona", "version": "1", "mode": "any", "rules": [_rule("r_urgent", "title", "equals", "1-URGENT", 50), _rule("r_high", "title", "contains_token", ["high"], 50)]},
        "coachCandidateRuleSet": {"ruleSetId": "coach", "version": "1", "mode": "any", "rules": [_rule("r_medium", "title", "contains_token", ["medium"], 1)]},
        "targetAccounts": [{"targetAccountId": f"t{k}", "organizationId": f"o{k}", "priority": 1 + k % 5, "attributes": {}} for k in range(0, 25, 3)],
        "accountProfiles": [{"organizationId": f"o{k}", "attributes": {"geography": f"r{k % 5}", "employee_count": k}} for k in range(25)],
        "approvedOrganizationAliases": [],
        "scoring": {"weights": {"accountFit": 25, "personaFit": 20, "relationshipConfidence": 20, "employmentConfidence": 15, "pathConfidence": 10, "freshness": 10}, "personaMatchedThreshold": 50, "uncertainLowerBound": 25},
        "freshness": {"currentEmploymentMaxDays": 365, "reviewEmploymentMaxDays": 730, "relationshipMaxDays": 730},
        "suppressions": [
            {"suppressionId": "x1", "kind": "person", "value": "C17", "reasonCode": "PERSON_SUPPRESSED", "effectiveAt": "2001-08-02T00:00:00.000Z"},
            {"suppressionId": "x2", "kind": "organization", "value": "o6", "reasonCode": "ORGANIZATION_SUPPRESSED", "effectiveAt": "2000-01-01T00:00:00.000Z", "expiresAt": "2001-08-02T00:00:00.000Z"},
        ],
        "exclusions": [{"kind": "organization", "value": "O9", "reasonCode": "ORGANIZATION_EXCLUDED"}, {"kind": "domain", "value": "o12.example.com", "reasonCode": "DOMAIN_EXCLUDED"}],
        "reviewPolicy": {"uncertainPersona": "review_only_candidate", "staleEmployment": "review_only", "unresolvedIdentity": "block", "unresolvedOrganization": "block", "bAndDRequireReview": True, "reviewReasonCode": "HUMAN_REVIEW_REQUIRED"},
    }


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instant(ts: str) -> str:
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def _snapshot(supplier: str, ts: str) -> str:
    return f"concat('n', {supplier}, '_', date_format({ts}, 'yyyyMM'))"


def _table(df: DataFrame, name: str, **columns: str) -> DataFrame:
    """``df`` as a table of the workspace: each column an SQL expression, the others null."""
    kinds = schemas.schema(name)
    exprs = {"workspace_id": f"'{WORKSPACE}'", **columns}
    return df.select(*[F.expr(exprs[f.name]).cast(f.dataType).alias(f.name) if f.name in exprs else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])


def tables(spark: SparkSession, sf_dir: str, written: bool = False) -> dict[str, DataFrame]:
    """The workspace's tables.

    Edges and their evidence come from one aggregation of all line items; if ``written``, it is made once and stored.
    """
    supplier, customer, orders, lineitem, nation = (star(spark, sf_dir, n) for n in ("supplier", "customer", "orders", "lineitem", "nation"))
    s, k, o = "s_suppkey", "c_custkey", "o_orderkey"
    traded = lineitem.select("l_orderkey", "l_suppkey", "l_shipdate", "l_discount").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = traded.groupBy("l_suppkey", "o_custkey").agg(F.max("l_shipdate").alias("at"), F.max("l_discount").alias("discount"))
    # in order, neighbours share most of what their rows say, so the file and the shuffles of it take less room
    edges = staged(edges.sortWithinPartitions("l_suppkey", "at"), "edges") if written else edges
    months = lineitem.select(F.col("l_suppkey").alias("by"), F.expr("date_format(l_shipdate, 'yyyyMM')").alias("month")).unionByName(orders.select((F.col(o) % 10).alias("by"), F.expr("date_format(o_orderdate, 'yyyyMM')").alias("month")))
    months = months.unionByName(customer.select((F.col(k) % 10).alias("by"), F.lit("199501").alias("month"))).distinct()
    evidence = [
        _table(edges, "evidence_ref", evidence_ref_id="concat('er', l_suppkey, '_', o_custkey)", source_snapshot_id=_snapshot("l_suppkey", "at"), claim_type="'relationship'"),
        _table(orders.where(f"{o} % 97 <> 0"), "evidence_ref", evidence_ref_id=f"concat('ee', {o})", source_snapshot_id=_snapshot(f"{o} % 10", "o_orderdate"), claim_type="'employment'"),
        _table(orders.where(f"{o} % 3 = 0"), "evidence_ref", evidence_ref_id=f"concat('eo', {o})", source_snapshot_id=_snapshot(f"{o} % 10", "o_orderdate"), claim_type="'organization'"),
        _table(customer, "evidence_ref", evidence_ref_id=f"concat('ei', {k})", source_snapshot_id=f"concat('n', {k} % 10, '_199501')", claim_type="'identity'"),
    ]
    refs = evidence[0]
    for part in evidence[1:]:
        refs = refs.unionByName(part)
    return schemas.complete(
        {
            "workspace": _table(spark.range(1), "workspace", purpose_id=f"'{PURPOSE}'"),
            "contributor": _table(supplier, "contributor", contributor_id=f"concat('s', {s})", display_name="s_name", kind="'colleague'", status=f"if({s} % 10 = 7, 'withdrawn', 'active')"),
            "consent": _table(
                supplier, "consent", consent_record_id=f"concat('k', {s})", contributor_id=f"concat('s', {s})", authorization_basis=f"if({s} % 3 = 1, 'organization_notice', 'individual_consent')", purpose_id=f"if({s} % 11 = 5, 'other', '{PURPOSE}')",
                source_classes=f"if({s} % 7 = 3, array('orders'), array('lineitem', 'orders'))", allowed_categories=f"case {s} % 6 when 2 then array('A', 'C') when 3 then array('B', 'D') when 5 then array('A', 'B', 'C') else array('A', 'B', 'C', 'D') end",
                broker_disclosure=f"if({s} % 2 = 0, 'authorized_reviewers', 'redacted_in_exports')", sanitized_export_allowed=f"{s} % 9 <> 0", granted_at=f"if({s} % 19 = 8, '2002-01-01T00:00:00.000Z', '1995-01-01T00:00:00.000Z')",
                expires_at=f"case {s} % 5 when 3 then '2001-01-01T00:00:00.000Z' when 4 then if({s} % 2 = 0, '{CLOCK}', '2003-01-01T00:00:00.000Z') else '2003-01-01T00:00:00.000Z' end", withdrawn_at=f"if({s} % 13 = 6, '2000-06-01T00:00:00.000Z', null)", status=f"if({s} % 10 = 7, 'inactive', 'active')",
            ),
            "person": _table(customer, "person", person_id=f"concat('c', {k})", display_name="c_name"),
            "organization": _table(nation, "organization", organization_id="concat('o', n_nationkey)", canonical_name="n_name"),
            "identity_claim": _table(customer, "identity_claim", identity_claim_id=f"concat('i', {k})", person_id=f"concat('c', {k})", kind="'provider_id'", namespace="'star'", value="c_name", evidence_refs=f"array(concat('ei', {k}))", confidence=f"1 - ({k} % 7) / 20D", observed_at="'1995-01-15T00:00:00.000Z'", review_status=f"if({k} % 41 = 0, 'conflicted', 'approved')"),
            "organization_claim": _table(orders.where(f"{o} % 3 = 0"), "organization_claim", organization_claim_id=f"concat('g', {o})", organization_id=f"concat('o', {o} % 25)", kind="'domain'", namespace="'star'", value=f"concat('O', {o} % 25, '.example.com')", evidence_refs=f"array(concat('eo', {o}))", confidence="1D", observed_at=_instant("o_orderdate"), review_status=f"if({o} % 60 = 0, 'conflicted', 'approved')"),
            "employment_claim": _table(orders, "employment_claim", employment_claim_id=f"concat('m', {o})", person_id="concat('c', o_custkey)", organization_id=f"concat('o', {o} % 25)", title="o_orderpriority", state="case o_orderstatus when 'F' then 'ended' when 'O' then 'current' else 'unknown' end", evidence_refs=f"array(concat('ee', {o}))", confidence=f"1 - ({o} % 10) / 20D", observed_at=_instant("o_orderdate"), review_status=f"if({o} % 50 = 0, 'conflicted', 'approved')"),
            "relationship_edge": _table(edges, "relationship_edge", relationship_edge_id="concat('e', l_suppkey, '_', o_custkey)", contributor_id="concat('s', l_suppkey)", destination_person_id="concat('c', o_custkey)", consent_record_id="concat('k', l_suppkey)", source_snapshot_id=_snapshot("l_suppkey", "at"), assertion_kind="'traded'", observed_at=_instant("at"), confidence="1 - discount", evidence_refs="array(concat('er', l_suppkey, '_', o_custkey))", eligible="(l_suppkey + o_custkey) % 20 <> 0"),
            "evidence_ref": refs,
            "source_snapshot": _table(months.where("(by * 100 + cast(month as int)) % 89 <> 0"), "source_snapshot", source_snapshot_id="concat('n', by, '_', month)", contributor_id="concat('s', by)", consent_record_id="concat('k', by)", source_kind="if(cast(month as int) % 2 = 0, 'orders', 'lineitem')", imported_at="concat(substr(month, 1, 4), '-', substr(month, 5, 2), '-28T00:00:00.000Z')"),
            "person_resolution_candidate": _table(customer.where(f"{k} % 43 = 0"), "person_resolution_candidate", resolution_candidate_id=f"concat('q', {k})", subject_person_id=f"concat('c', {k})", status=f"if({k} % 2 = 0, 'approved', 'pending')"),
            "organization_alias_candidate": _table(nation.where("n_nationkey = 15"), "organization_alias_candidate", organization_alias_candidate_id="concat('z', n_nationkey)", proposed_organization_id="concat('o', n_nationkey)", status="'pending'"),
            "suppression_rule": _table(supplier.where(f"{s} in (3, 5)"), "suppression_rule", suppression_rule_id=f"concat('u', {s})", kind="'snapshot'", value=f"concat('N', {s}, '_200105')", reason_code="'SNAPSHOT_SUPPRESSED'", effective_at="'2001-01-01T00:00:00.000Z'", expires_at=f"if({s} = 5, '2001-07-01T00:00:00.000Z', null)"),
        },
        spark,
    )


def suppliers(spark: SparkSession, sf_dir: str) -> int:
    return star(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
