"""Accepted provider records to claims: a snapshot, evidence, a person and what a record says of them.

A record makes no edge, and its employment is of unknown state: metadata says that somebody is listed somewhere,
not that they are known or work there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.functions import scalars
from kinweft.functions.digest import json_object, json_string, scoped_id_column, sha256

#: What a record can say, besides its key, kind, instant and digest.
FIELDS = ("person_name", "person_provider_id", "person_email", "organization_name", "organization_domain", "crm_contact_id", "crm_account_id")
TRANSFORM = "adapter-normalize-v1"


@dataclass(frozen=True)
class Source:
    """Who reads which provider for whom."""

    workspace: str
    authorization: str
    provider: str
    tenant: str
    contributor: str
    consent: str
    at: str

    def name(self, scope: str, /, **fields: Column) -> Column:
        return scoped_id_column(self.workspace, scope, json_object({k: json_string(v) for k, v in fields.items()}))


def normalize(records: DataFrame, source: Source) -> dict[str, DataFrame]:
    """The rows that records add to each table, each row once.

    ``records`` has (provider_record_id, kind, observed_at, record_digest_sha256, byte_count) and :data:`FIELDS`; a
    person is known by the provider's id, else a CRM contact, else the record; an organization by the CRM account,
    else the domain, else the name.  CRM fields count in records of kind ``crm`` only.  Records of one person give
    the name that comes first by (observed_at, provider_record_id); null or empty fields say nothing.
    """
    given = {c: F.when(F.col(c) != "", F.col(c)) for c in FIELDS}
    crm = {c: F.when(F.col("kind") == "crm", given[c]) for c in ("crm_contact_id", "crm_account_id")}
    ns = F.lit(f"{source.provider}:{source.tenant}")
    rows = records.withColumns(
        {
            **given, **crm, "person_label": scalars.trimmed(scalars.nfkc(given["person_name"])), "organization_label": scalars.trimmed(scalars.nfkc(given["organization_name"])), "email": scalars.normalize_email(given["person_email"]),
            "domain": scalars.normalize_domain(scalars.nfkc(given["organization_domain"])), "person_anchor": F.coalesce(given["person_provider_id"], crm["crm_contact_id"], "provider_record_id"),
            "organization_anchor": F.when(given["organization_name"].isNotNull(), F.coalesce(crm["crm_account_id"], given["organization_domain"], given["organization_name"])),
        }
    )
    binding = {"adapterAuthorizationId": F.lit(source.authorization), "providerTenantId": F.lit(source.tenant), "providerRecordId": F.col("provider_record_id"), "recordDigest": F.col("record_digest_sha256")}
    rows = rows.withColumns({"snapshot": source.name("adapter_snapshot", **binding), "record": source.name("adapter_record", **binding), "person_id": source.name("person", namespace=ns, personAnchor=F.col("person_anchor"))})
    rows = rows.withColumns({"evidence": source.name("adapter_evidence", snapshotId=F.col("snapshot"), recordId=F.col("record")), "organization_id": F.when(F.col("organization_anchor").isNotNull(), source.name("organization", namespace=ns, organizationAnchor=F.col("organization_anchor")))})
    kind = F.concat("kind", F.lit("_metadata"))
    key = sha256(json_object({k: json_string(v) for k, v in {"workspaceId": F.lit(source.workspace), **binding}.items()}))

    def table(df: DataFrame, name: str, **columns: Column) -> DataFrame:
        columns |= {"workspace_id": F.lit(source.workspace)}
        made = df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(name).fields])
        return made.dropDuplicates([schemas.KEYS[name]])

    def each(df: DataFrame, **values: str) -> DataFrame:
        said = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in values.items()])
        return df.select("snapshot", "person_id", "organization_id", "evidence", "observed_at", F.inline(said).alias("said", "value")).where("value is not null")

    def first(label: str) -> Column:
        return F.min_by(label, F.struct("observed_at", "provider_record_id"))

    claim = {"evidence_refs": F.array("evidence"), "observed_at": F.col("observed_at"), "review_status": F.lit("unreviewed")}
    sure = F.when(F.col("said") == "name", 0.6).otherwise(1.0)
    owner = {"contributor_id": F.lit(source.contributor), "consent_record_id": F.lit(source.consent), "source_kind": kind, "imported_at": F.lit(source.at), "raw_retained": F.lit(False), "network_accessed": F.lit(False)}
    people = each(rows, name="person_label", provider_id="person_anchor", email="email")
    works = rows.where("organization_id is not null")
    firms = each(works, name="organization_label", domain="domain", crm_id="crm_account_id")
    said = {"kind": F.col("said"), "namespace": F.concat(ns, F.lit(":"), "said"), "value": F.col("value"), "confidence": sure, **claim}
    of = lambda name, who: source.name(name, snapshotId=F.col("snapshot"), **{"personId" if who == "person_id" else "organizationId": F.col(who)}, kind=F.col("said"), value=F.col("value"))
    return {
        "source_snapshot": table(rows, "source_snapshot", **owner, source_snapshot_id=F.col("snapshot"), raw_sha256=F.col("record_digest_sha256"), idempotency_key=key, mapping_id=F.concat(F.lit("mapping_"), "kind", F.lit("_adapter_v1")), mapping_version=F.lit("1"), source_observed_at=F.col("observed_at"), byte_count=F.col("byte_count"), record_count=F.lit(1), transform_version=F.lit(TRANSFORM)),
        "adapter_metadata_record": table(rows, "adapter_metadata_record", **owner, adapter_metadata_record_id=F.col("record"), adapter_authorization_id=F.lit(source.authorization), provider=F.lit(source.provider), provider_tenant_id=F.lit(source.tenant), provider_record_id=F.col("provider_record_id"), observed_at=F.col("observed_at"), record_digest_sha256=F.col("record_digest_sha256")),
        "evidence_ref": table(rows, "evidence_ref", evidence_ref_id=F.col("evidence"), source_snapshot_id=F.col("snapshot"), source_record_id=F.col("record"), claim_type=F.lit("identity"), row_digest_sha256=F.col("record_digest_sha256"), transform_version=F.lit(TRANSFORM)),
        "person": table(rows.groupBy("person_id").agg(first("person_label").alias("label")), "person", person_id=F.col("person_id"), display_name=F.col("label"), created_at=F.lit(source.at)),
        "identity_claim": table(people, "identity_claim", identity_claim_id=of("adapter_identity", "person_id"), person_id=F.col("person_id"), **said),
        "organization": table(works.groupBy("organization_id").agg(first("organization_label").alias("label")), "organization", organization_id=F.col("organization_id"), canonical_name=F.col("label"), created_at=F.lit(source.at)),
        "organization_claim": table(firms, "organization_claim", organization_claim_id=of("adapter_org_claim", "organization_id"), organization_id=F.col("organization_id"), **said),
        "employment_claim": table(works, "employment_claim", employment_claim_id=source.name("adapter_employment", snapshotId=F.col("snapshot"), personId=F.col("person_id"), organizationId=F.col("organization_id")), person_id=F.col("person_id"), organization_id=F.col("organization_id"), state=F.lit("unknown"), confidence=F.lit(0.6), **claim),
    }
