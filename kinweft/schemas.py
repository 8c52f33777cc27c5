"""The tables of a workspace: one typed table for each kind of entity, and its quality gates.

Instants are kept as the ISO text they came as, since that text is hashed and orders claims; operators derive
timestamps where they compute with time.  An absent field is a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLAIM = "evidence_refs array<string>, confidence double, observed_at string, review_status string"

TABLES: dict[str, str] = {
    "workspace": "workspace_id string, name string, owner_actor_id string, purpose_id string, policy_version string, created_at string",
    "contributor": "workspace_id string, contributor_id string, display_name string, kind string, status string, created_at string",
    "consent": "workspace_id string, consent_record_id string, contributor_id string, authorization_basis string, purpose_id string, notice_version string, source_classes array<string>, allowed_categories array<string>, broker_disclosure string, sanitized_export_allowed boolean, granted_at string, expires_at string, withdrawn_at string, withdrawal_reason string, status string, retention_policy_id string, grant_method string, notice_state string",
    "person": "workspace_id string, person_id string, display_name string, created_at string",
    "identity_claim": f"workspace_id string, identity_claim_id string, person_id string, kind string, namespace string, value string, {_CLAIM}",
    "organization": "workspace_id string, organization_id string, canonical_name string, created_at string",
    "organization_claim": f"workspace_id string, organization_claim_id string, organization_id string, kind string, namespace string, value string, {_CLAIM}",
    "employment_claim": f"workspace_id string, employment_claim_id string, person_id string, organization_id string, title string, function string, seniority string, state string, ended_at string, {_CLAIM}",
    "relationship_edge": "workspace_id string, relationship_edge_id string, contributor_id string, destination_person_id string, consent_record_id string, source_snapshot_id string, assertion_kind string, observed_at string, confidence double, evidence_refs array<string>, eligible boolean",
    "evidence_ref": "workspace_id string, evidence_ref_id string, source_snapshot_id string, source_record_id string, claim_type string, row_digest_sha256 string, transform_version string",
    "source_snapshot": "workspace_id string, source_snapshot_id string, contributor_id string, consent_record_id string, source_kind string, raw_sha256 string, idempotency_key string, mapping_id string, mapping_version string, imported_at string, source_observed_at string, byte_count long, record_count long, raw_retained boolean, network_accessed boolean, transform_version string",
    "person_resolution_candidate": "workspace_id string, resolution_candidate_id string, subject_person_id string, candidate_person_ids array<string>, signals array<string>, confidence double, status string, automatic_merge_allowed boolean",
    "organization_alias_candidate": "workspace_id string, organization_alias_candidate_id string, proposed_organization_id string, alias_kind string, alias_value string, evidence_refs array<string>, conflict_organization_ids array<string>, consequences array<string>, status string, approved_canonical_organization_id string",
    "review_decision": "workspace_id string, review_decision_id string, subject_type string, subject_id string, actor_id string, decision string, reason string, decided_at string, prior_state string, organization_alias_authorization struct<source_organization_id:string,canonical_organization_id:string,alias_kind:string,alias_value:string>",
    "suppression_rule": "workspace_id string, suppression_rule_id string, kind string, value string, reason_code string, effective_at string, expires_at string",
    "adapter_metadata_record": "workspace_id string, adapter_metadata_record_id string, adapter_authorization_id string, contributor_id string, consent_record_id string, provider string, provider_tenant_id string, provider_record_id string, source_kind string, observed_at string, imported_at string, record_digest_sha256 string, fields string, network_accessed boolean, raw_retained boolean",
    "import_transaction": "workspace_id string, import_transaction_id string, source_snapshot_id string, contributor_id string, consent_record_id string, source_kind string, mapping_id string, mapping_version string, raw_sha256 string, idempotency_key string, status string, failure_codes array<string>, row_count long, created_at string, completed_at string",
    "audit_event": "workspace_id string, audit_event_id string, sequence long, event_type string, actor_id string, occurred_at string, subject_type string, subject_id string, payload_sha256 string, previous_hash string, hash string",
    "deletion_receipt": "workspace_id string, deletion_receipt_id string, consent_record_id string, actor_id string, requested_at string, completed_at string, counts map<string,long>, dependency_digest_sha256 string",
    "coverage_result": "workspace_id string, audit_run_id string, result_id string, category string, destination_person_id string, canonical_account_id string, persona_outcome string, candidate_label string, broker_contributor_id string, relationship_edge_id string, dependencies struct<contributor_ids:array<string>,consent_record_ids:array<string>,source_snapshot_ids:array<string>,evidence_ref_ids:array<string>,relationship_edge_ids:array<string>,mixed_source_rule:string>, scores struct<account_fit:int,persona_fit:int,relationship_confidence:int,employment_confidence:int,path_confidence:int,freshness:int,review_priority:int>, reason_codes array<string>, evidence_refs array<string>, consent_disposition string, suppression_status string",
}

#: Tables that a store derives when rows are committed: what rests on which consent.
INDEXES = {"dependency": "workspace_id string, consent_record_id string, table_name string, row_id string"}

#: The version of these schemas.  Tables whose columns were others before are listed under the version that had them.
VERSION = 2
OLDER: dict[int, dict[str, str]] = {1: {"import_transaction": "workspace_id string, import_transaction_id string, source_snapshot_id string, status string, error_code string, row_count long, created_at string"}}

#: The column that identifies a row of each table within its workspace.
KEYS: dict[str, str] = {
    "workspace": "workspace_id", "contributor": "contributor_id", "consent": "consent_record_id", "person": "person_id", "identity_claim": "identity_claim_id", "organization": "organization_id",
    "organization_claim": "organization_claim_id", "employment_claim": "employment_claim_id", "relationship_edge": "relationship_edge_id", "evidence_ref": "evidence_ref_id", "source_snapshot": "source_snapshot_id",
    "person_resolution_candidate": "resolution_candidate_id", "organization_alias_candidate": "organization_alias_candidate_id", "review_decision": "review_decision_id", "suppression_rule": "suppression_rule_id",
    "adapter_metadata_record": "adapter_metadata_record_id", "import_transaction": "import_transaction_id", "audit_event": "sequence", "deletion_receipt": "deletion_receipt_id", "coverage_result": "result_id",
}

#: Tables whose rows never change once written.
IMMUTABLE = ("evidence_ref", "review_decision", "source_snapshot", "adapter_metadata_record")

#: The entities that decide an evaluation, and so are part of its input digest.
INPUTS = ("contributor", "consent", "person", "identity_claim", "organization", "organization_claim", "employment_claim", "relationship_edge", "evidence_ref", "source_snapshot", "person_resolution_candidate", "organization_alias_candidate", "review_decision", "suppression_rule")

ID_PATTERN = r"\A[a-zA-Z0-9][a-zA-Z0-9._:-]{0,199}\z"


def schema(table: str, version: int = VERSION) -> T.StructType:
    """A table's columns in a version: the oldest listing from that version on, else the newest."""
    found = next((OLDER[v][table] for v in sorted(OLDER) if v >= version and table in OLDER[v]), TABLES.get(table) or INDEXES[table])
    return T.StructType.fromDDL(found)


def _with_bindings(df: DataFrame) -> DataFrame:
    """Imports tell what they were bound to, and may fail for several reasons."""
    names = ("contributor_id", "consent_record_id", "source_kind", "mapping_id", "mapping_version", "raw_sha256", "idempotency_key", "completed_at")
    return df.withColumns({c: F.lit(None).cast("string") for c in names} | {"failure_codes": F.when(F.col("error_code").isNotNull(), F.array("error_code")).otherwise(F.array().cast("array<string>"))})


#: (version, name, {table: upgrade of its rows from the version before}), in order.
UPGRADES = ((2, "import bindings", {"import_transaction": _with_bindings}),)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def complete(tables: dict[str, DataFrame], spark: SparkSession) -> dict[str, DataFrame]:
    """All tables of a workspace, the missing ones empty."""
    return {name: tables.get(name, empty(spark, name)) if tables.get(name) is not None else empty(spark, name) for name in TABLES}


def _sorted_unique(values: Column) -> Column:
    return F.size(values) == F.size(F.array_distinct(values))


def violations(table: str, df: DataFrame) -> DataFrame:
    """The rows that break a table's quality gates, with the codes of the gates in ``gate_codes``."""
    gates: dict[str, Column] = {"INVALID_ID": ~F.col(KEYS[table]).cast("string").rlike(ID_PATTERN)}
    columns = df.columns
    if "confidence" in columns:
        gates["CONFIDENCE_RANGE"] = ~F.col("confidence").between(0.0, 1.0)
    for c in ("observed_at", "granted_at", "expires_at", "withdrawn_at", "imported_at", "decided_at", "created_at"):
        if c in columns:
            gates[f"INVALID_{c.upper()}"] = F.col(c).isNotNull() & F.try_to_timestamp(c).isNull()
    if table == "consent":
        granted, expires, withdrawn = (F.try_to_timestamp(c) for c in ("granted_at", "expires_at", "withdrawn_at"))
        gates["CONSENT_CHRONOLOGY"] = F.coalesce(expires <= granted, F.lit(False)) | F.coalesce(withdrawn < granted, F.lit(False))
        gates["DUPLICATE_SCOPE"] = ~_sorted_unique(F.col("source_classes")) | ~_sorted_unique(F.col("allowed_categories"))
    if table == "organization_alias_candidate":
        gates["APPROVED_WITHOUT_CANONICAL"] = (F.col("status") == "approved") & F.col("approved_canonical_organization_id").isNull()
    if table == "relationship_edge":
        gates["EVIDENCE_REQUIRED"] = F.size("evidence_refs") < 1
    if table == "coverage_result":
        gates["PERSONA_CATEGORY"] = F.col("category").isin("A", "C") != (F.col("persona_outcome") == "matched")
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in gates.items()]))
    return df.withColumn("gate_codes", codes).where(F.size("gate_codes") > 0)
