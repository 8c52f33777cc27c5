"""A synthetic workspace of six people: one finding of each class and two blocked near-misses."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kinweft import schemas
from kinweft.functions.digest import sha256_hex

WORKSPACE, CLOCK, PURPOSE = "workspace_demo", "2026-09-18T12:00:00.000Z", "purpose_network_coverage_audit"

# The demonstration policy and configuration, whose digests are part of the expected report.
POLICY: dict[str, Any] = {
    "workspaceId": WORKSPACE, "policyId": "policy_demo", "version": "1", "effectiveAt": CLOCK, "purposeId": PURPOSE, "allowedCategories": ["A", "B", "C", "D"],
    "directScope": "A_ICP_FIT_INCLUDING_TARGETS_B_TARGET_LIST_ONLY", "brokerScope": "C_D_TARGET_LIST_ONLY", "requireBrokerIndividualConsent": True, "networkMode": "disabled", "externalMutations": False,
}


def _rule(name: str, field: str, operator: str, value: Any, weight: int) -> dict[str, Any]:
    return {"ruleId": f"rule_{name}", "field": field, "operator": operator, "value": value, "required": True, "weight": weight}


def _rules(name: str, mode: str, *rules: dict[str, Any]) -> dict[str, Any]:
    return {"ruleSetId": f"rules_{name}", "version": "1", "mode": mode, "rules": list(rules)}


_ATTRIBUTES = {name: {"industry": "software", "domain": f"{name}.example.com"} for name in ("lantern", "northstar")}

CONFIG: dict[str, Any] = {
    "workspaceId": WORKSPACE, "configId": "config_demo", "version": "1", "directContributorIds": ["contributor_owner"],
    "icpRuleSet": _rules("icp", "all", _rule("industry", "industry", "in", ["software"], 100)),
    "stakeholderPersonaRuleSet": _rules("persona", "all", _rule("function", "function", "in", ["sales"], 50), _rule("seniority", "seniority", "in", ["vp"], 50)),
    "coachCandidateRuleSet": _rules("coach", "any", _rule("function_exists", "function", "exists", True, 100)),
    "targetAccounts": [{"targetAccountId": "target_northstar", "organizationId": "org_northstar", "priority": 1, "attributes": _ATTRIBUTES["northstar"]}],
    "accountProfiles": [{"organizationId": f"org_{name}", "attributes": _ATTRIBUTES[name]} for name in ("lantern", "northstar")],
    "approvedOrganizationAliases": [],
    "scoring": {"weights": {"accountFit": 25, "personaFit": 20, "relationshipConfidence": 20, "employmentConfidence": 15, "pathConfidence": 10, "freshness": 10}, "personaMatchedThreshold": 100, "uncertainLowerBound": 50},
    "freshness": {"currentEmploymentMaxDays": 365, "reviewEmploymentMaxDays": 730, "relationshipMaxDays": 365},
    "suppressions": [], "exclusions": [],
    "reviewPolicy": {"uncertainPersona": "review_only_candidate", "staleEmployment": "review_only", "unresolvedIdentity": "block", "unresolvedOrganization": "block", "bAndDRequireReview": True, "reviewReasonCode": "HUMAN_REVIEW_REQUIRED"},
}

_ORGANIZATIONS = {"lantern": "Lantern Labs", "northstar": "Northstar Systems"}
_OLD = "2024-01-01T00:00:00.000Z"
# name of the id, display name, organization, contributor, title, function, seniority, observed, identity status
PEOPLE = (
    ("alex", "Alex Example", "lantern", "owner", "VP Sales", "sales", "vp", CLOCK, "approved"),
    ("blair", "Blair Example", "northstar", "owner", "Operations Manager", "operations", "manager", CLOCK, "approved"),
    ("casey", "Casey Example", "northstar", "broker", "VP Sales", "sales", "vp", CLOCK, "approved"),
    ("devon", "Devon Example", "northstar", "broker", "Finance Director", "finance", "director", CLOCK, "approved"),
    ("stale", "Stale Example", "northstar", "broker", "VP Sales", "sales", "vp", _OLD, "approved"),
    ("conflicted", "Conflict Example", "northstar", "broker", "VP Sales", "sales", "vp", CLOCK, "conflicted"),
)


def frames(spark: SparkSession, rows: dict[str, list[dict[str, Any]]]) -> dict[str, DataFrame]:
    """DataFrames of rows given as dicts; what a dict leaves out is null."""
    made = {}
    for name in schemas.TABLES:
        kind = schemas.schema(name)
        made[name] = spark.createDataFrame([tuple(r.get(c) for c in kind.names) for r in rows.get(name, [])], kind)
    return made


def rows() -> dict[str, list[dict[str, Any]]]:
    """The rows of the demonstration workspace, by table."""
    # Ids, names, instants and texts that the published digests are of.
    ws = {"workspace_id": WORKSPACE}
    out: dict[str, list[dict[str, Any]]] = {name: [] for name in schemas.TABLES}
    out["workspace"].append(ws | {"name": "Demonstration workspace", "owner_actor_id": "actor_demo", "purpose_id": PURPOSE, "policy_version": "1", "created_at": CLOCK})
    for name, display, kind, disclosure in (("owner", "Demo Owner", "owner", "redacted_in_exports"), ("broker", "Demo Advisor", "advisor", "authorized_reviewers")):
        who = f"contributor_{name}"
        out["contributor"].append(ws | {"contributor_id": who, "display_name": display, "kind": kind, "status": "active", "created_at": CLOCK})
        out["consent"].append(
            ws | {"consent_record_id": f"consent_{who}", "contributor_id": who, "authorization_basis": "individual_consent", "purpose_id": PURPOSE, "notice_version": "1", "source_classes": ["synthetic_connections_csv"], "allowed_categories": ["A", "B", "C", "D"], "broker_disclosure": disclosure}
            | {"sanitized_export_allowed": True, "granted_at": "2026-01-01T00:00:00.000Z", "expires_at": "2027-01-01T00:00:00.000Z", "status": "active", "retention_policy_id": "retention_demo", "grant_method": "synthetic_demo", "notice_state": "acknowledged"}
        )
    for name, canonical in _ORGANIZATIONS.items():
        out["organization"].append(ws | {"organization_id": f"org_{name}", "canonical_name": canonical, "created_at": CLOCK})
    for name, display, org, by, title, function, seniority, seen, status in PEOPLE:
        person, who = f"person_{name}", f"contributor_{by}"
        snapshot, consent = f"snapshot_{person}", f"consent_{who}"
        out["source_snapshot"].append(
            ws | {"source_snapshot_id": snapshot, "contributor_id": who, "consent_record_id": consent, "source_kind": "synthetic_connections_csv", "raw_sha256": sha256_hex(f"raw:{person}"), "idempotency_key": sha256_hex(f"key:{person}"), "mapping_id": "mapping_demo", "mapping_version": "1"}
            | {"imported_at": CLOCK, "source_observed_at": seen, "byte_count": 100, "record_count": 1, "raw_retained": False, "network_accessed": False, "transform_version": "demo-v1"}
        )
        kinds = ("identity", "organization", "employment", "relationship")
        ref = {k: [f"evidence_{person}_{k}"] for k in kinds}
        out["evidence_ref"] += [ws | {"evidence_ref_id": ref[k][0], "source_snapshot_id": snapshot, "source_record_id": f"record_{person}", "claim_type": k, "row_digest_sha256": sha256_hex(f"row:{person}"), "transform_version": "demo-v1"} for k in kinds]
        claim = ws | {"confidence": 1.0, "observed_at": seen}
        out["person"].append(ws | {"person_id": person, "display_name": display, "created_at": CLOCK})
        out["identity_claim"].append(claim | {"identity_claim_id": f"identity_{person}", "person_id": person, "kind": "provider_id", "namespace": "synthetic", "value": person, "evidence_refs": ref["identity"], "review_status": status})
        out["organization_claim"].append(claim | {"organization_claim_id": f"orgclaim_{person}", "organization_id": f"org_{org}", "kind": "domain", "namespace": "synthetic", "value": f"{org}.example.com", "evidence_refs": ref["organization"], "review_status": "approved"})
        out["employment_claim"].append(claim | {"employment_claim_id": f"employment_{person}", "person_id": person, "organization_id": f"org_{org}", "title": title, "function": function, "seniority": seniority, "state": "current", "evidence_refs": ref["employment"], "review_status": "approved"})
        out["relationship_edge"].append(claim | {"relationship_edge_id": f"edge_{person}", "contributor_id": who, "destination_person_id": person, "consent_record_id": consent, "source_snapshot_id": snapshot, "assertion_kind": "contributed_direct_connection", "evidence_refs": ref["relationship"], "eligible": True})
    return out


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    return frames(spark, rows())
