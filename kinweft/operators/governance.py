"""Withdrawal, reviews and the audit chain."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import ConfigError
from kinweft.functions.digest import camel, canonical_json, json_object, json_value, scoped_id, sha256, sha256_hex
from kinweft.session import shared_dir

#: Immutable tables whose rows go when the consent they rest on is withdrawn.
CASCADED = ("evidence_ref", "source_snapshot", "adapter_metadata_record")
CLAIMS = {"identity_claim": "identity_claim_id", "organization_claim": "organization_claim_id", "employment_claim": "employment_claim_id"}


#: The tables that rows rest on a consent in.
DEPENDENT = ("source_snapshot", "evidence_ref", "relationship_edge", *CLAIMS, "coverage_result", "adapter_metadata_record")


def withdrawal_dependants(tables: dict[str, DataFrame], consent_id: str) -> dict[str, DataFrame]:
    """What rests on a consent, by table: its snapshots and edges, their evidence, claims on it, and results.

    A result goes as a whole if it rests on this consent among others.
    """
    snapshots = tables["source_snapshot"].where(F.col("consent_record_id") == consent_id)
    evidence = tables["evidence_ref"].join(snapshots.select("source_snapshot_id"), "source_snapshot_id", "left_semi")
    gone = evidence.select(F.col("evidence_ref_id").alias("ref"))
    found = {"source_snapshot": snapshots, "evidence_ref": evidence, "relationship_edge": tables["relationship_edge"].where(F.col("consent_record_id") == consent_id)}
    for name, key in CLAIMS.items():
        hit = tables[name].select(key, F.explode("evidence_refs").alias("ref")).join(gone, "ref", "left_semi").select(key).distinct()
        found[name] = tables[name].join(hit, key, "left_semi")
    found["coverage_result"] = tables["coverage_result"].where(F.array_contains("dependencies.consent_record_ids", consent_id))
    found["adapter_metadata_record"] = tables["adapter_metadata_record"].where(F.col("consent_record_id") == consent_id)
    return found


def latest_events(events: DataFrame) -> DataFrame:
    """The last audit event of every workspace, which the next one continues."""
    last = events.groupBy("workspace_id").agg(F.max("sequence").alias("sequence"))
    return events.join(last, ["workspace_id", "sequence"]).select("workspace_id", "sequence", "hash")


def withdraw(tables: dict[str, DataFrame], workspace: str, consent_id: str, reason: str, at: str, actor: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """The tables after a contributor's withdrawal, and the receipt, which has counts and digests only."""
    held = tables["consent"].where((F.col("workspace_id") == workspace) & (F.col("consent_record_id") == consent_id)).first()
    if held is None:
        raise ConfigError("CONSENT_NOT_FOUND")
    gone = withdrawal_dependants(tables, consent_id)
    made = receipt(held.asDict(), {k: v.count() for k, v in gone.items()}, reason, at, actor)
    after = dict(tables)
    for name, rows in gone.items():
        key = schemas.KEYS[name]
        after[name] = tables[name].join(rows.select(key), key, "left_anti").select(*tables[name].columns)
    mine = F.col("consent_record_id") == consent_id
    after["consent"] = tables["consent"].withColumns({"status": F.when(mine, "withdrawn").otherwise(F.col("status")), "withdrawn_at": F.when(mine, at).otherwise(F.col("withdrawn_at")), "withdrawal_reason": F.when(mine, reason).otherwise(F.col("withdrawal_reason"))})
    theirs = F.col("contributor_id") == held["contributor_id"]
    after["contributor"] = tables["contributor"].withColumn("status", F.when(theirs, "withdrawn").otherwise(F.col("status")))
    return after, made


def receipt(consent: dict[str, Any], n: dict[str, int], reason: str, at: str, actor: str) -> dict[str, Any]:
    """The receipt of a withdrawal that removed ``n`` rows of each table."""
    workspace, consent_id = consent["workspace_id"], consent["consent_record_id"]
    counts = {"snapshots": n["source_snapshot"], "evidence": n["evidence_ref"], "claims": sum(n[c] for c in CLAIMS), "edges": n["relationship_edge"], "results": n["coverage_result"], "adapter_records": n["adapter_metadata_record"]}
    scope = sha256_hex(canonical_json({"workspaceId": workspace, "contributorId": consent["contributor_id"], "consentRecordId": consent_id, "counts": counts}))
    return {
        "workspaceId": workspace, "receiptId": scoped_id(workspace, "receipt", {"consentRecordId": consent_id, "at": at}), "operation": "contributor_withdrawal", "subjectScopeDigest": scope, "requestedAt": at, "completedAt": at, "status": "completed_with_external_actions_required",
        "policyId": consent["retention_policy_id"], "policyVersion": "1", "counts": counts, "externalActionsRequired": ["operator_backups_and_copied_exports"], "personalValuesIncluded": False, "otherContributorIdsIncluded": False,
        "auditChainHash": sha256_hex(canonical_json({"actorId": actor, "reasonCode": sha256_hex(reason), "scopeDigest": scope, "at": at})),
    }


def _decision(workspace: str, subject_type: str, subject: str, decision: str, actor: str, reason: str, at: str) -> dict[str, Any]:
    name = scoped_id(workspace, "review", {"candidateId": subject, "decision": decision, "actorId": actor, "decidedAt": at})
    return {"workspace_id": workspace, "review_decision_id": name, "subject_type": subject_type, "subject_id": subject, "actor_id": actor, "decision": decision, "reason": reason, "decided_at": at, "prior_state": "pending", "organization_alias_authorization": None}


def decide_alias(candidate: dict[str, Any], decision: str, actor: str, reason: str, at: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """The candidate and the immutable decision after a review of an organization alias.

    An approval maps the proposed organization to its one conflicting organization, or to itself where there is none
    or more than one.
    """
    if candidate["status"] != "pending":
        raise ConfigError("ALIAS_DECISION_ALREADY_RECORDED")
    if not reason.strip() or decision not in ("approve", "reject"):
        raise ConfigError("REVIEW_DECISION_INVALID")
    conflicts = candidate.get("conflict_organization_ids") or []
    canonical = conflicts[0] if len(conflicts) == 1 else candidate["proposed_organization_id"]
    said = _decision(candidate["workspace_id"], "organization_alias", candidate["organization_alias_candidate_id"], decision, actor, reason, at)
    if decision == "reject":
        return candidate | {"status": "rejected"}, said
    said["organization_alias_authorization"] = {"source_organization_id": candidate["proposed_organization_id"], "canonical_organization_id": canonical, "alias_kind": candidate["alias_kind"], "alias_value": candidate["alias_value"]}
    return candidate | {"status": "approved", "approved_canonical_organization_id": canonical}, said


def alias_claim(candidate: dict[str, Any], decision: dict[str, Any]) -> dict[str, Any] | None:
    """The claim that an approved alias becomes: its value names the organization it stands for."""
    allowed = decision["organization_alias_authorization"]
    if allowed is None:
        return None
    name = scoped_id(candidate["workspace_id"], "organization_claim", {"candidateId": candidate["organization_alias_candidate_id"], "decisionId": decision["review_decision_id"]})
    return {"workspace_id": candidate["workspace_id"], "organization_claim_id": name, "organization_id": allowed["canonical_organization_id"], "kind": "alias", "namespace": "approved_alias", "value": candidate["alias_value"], "evidence_refs": candidate["evidence_refs"], "confidence": 1.0, "observed_at": decision["decided_at"], "review_status": "approved"}


def decide_person(candidate: dict[str, Any], decision: str, actor: str, reason: str, at: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """The candidate and the immutable decision after a review of a person; edge and claims stay as they are."""
    if candidate["status"] != "pending":
        raise ConfigError("PERSON_RESOLUTION_DECISION_ALREADY_RECORDED")
    if not reason.strip() or decision not in ("approve", "reject"):
        raise ConfigError("REVIEW_DECISION_INVALID")
    return candidate | {"status": "approved" if decision == "approve" else "rejected"}, _decision(candidate["workspace_id"], "person_resolution", candidate["resolution_candidate_id"], decision, actor, reason, at)


def consent_change_errors(old: dict[str, Any], new: dict[str, Any]) -> list[str]:
    """Why a stored consent may not become another: wider, active again, or bound otherwise."""
    bad = [f"CONSENT_{k.upper()}_CHANGED" for k in ("contributor_id", "purpose_id", "authorization_basis") if old[k] != new[k]]
    bad += [f"CONSENT_{k.upper()}_WIDENED" for k in ("source_classes", "allowed_categories") if set(new[k]) - set(old[k])]
    return bad + (["CONSENT_REACTIVATED"] if old["status"] != "active" and new["status"] == "active" else [])


def change_codes(old: Column, new: Column) -> Column:
    """:func:`consent_change_errors` of struct columns of a stored and a new consent."""
    codes = [F.when(~old[k].eqNullSafe(new[k]), f"CONSENT_{k.upper()}_CHANGED") for k in ("contributor_id", "purpose_id", "authorization_basis")]
    codes += [F.when(F.size(F.array_except(new[k], old[k])) > 0, f"CONSENT_{k.upper()}_WIDENED") for k in ("source_classes", "allowed_categories")]
    return F.array_compact(F.array(*codes, F.when((old["status"] != "active") & (new["status"] == "active"), "CONSENT_REACTIVATED")))


def postings(tables: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """(workspace_id, consent_record_id, table_name, row_id): what rests on each consent, every row once for a consent.

    Snapshots, edges and provider records name theirs; evidence rests on its snapshot's, a claim on that of each
    evidence it refers to, a result on all that it lists.  Evidence is joined by its id, so a claim's references are
    exploded once for all consents.  ``known`` are postings of rows that are stored already and not among ``tables``.
    """

    def shown(df: DataFrame, name: str) -> DataFrame:
        return df.select("workspace_id", "consent_record_id", F.lit(name).alias("table_name"), F.col(schemas.KEYS[name]).cast("string").alias("row_id"))

    def resting(name: str, own: DataFrame | None, ref: str) -> DataFrame | None:
        """(workspace_id, ref, consent_record_id) of the rows of a table, here and known."""
        parts = [] if own is None else [own.select("workspace_id", F.col("row_id").alias(ref), "consent_record_id")]
        if known is not None:
            parts.append(known.where(F.col("table_name") == name).select("workspace_id", F.col("row_id").alias(ref), "consent_record_id"))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else None

    there = {k: tables[k] for k in DEPENDENT if k in tables}
    made = {k: shown(there[k], k) for k in ("source_snapshot", "relationship_edge", "adapter_metadata_record") if k in there}
    snapshots = resting("source_snapshot", made.get("source_snapshot"), "source_snapshot_id")
    if "evidence_ref" in there and snapshots is not None:
        made["evidence_ref"] = shown(there["evidence_ref"].join(snapshots, ["workspace_id", "source_snapshot_id"]), "evidence_ref")
    rests = resting("evidence_ref", made.get("evidence_ref"), "ref")
    claims = [there[k].select("workspace_id", F.lit(k).alias("table_name"), F.col(schemas.KEYS[k]).alias("row_id"), F.explode(F.array_distinct("evidence_refs")).alias("ref")) for k in CLAIMS if k in there]
    if claims and rests is not None:
        made["claims"] = reduce(DataFrame.unionByName, claims).join(rests, ["workspace_id", "ref"]).select("workspace_id", "consent_record_id", "table_name", "row_id").distinct()
    if "coverage_result" in there:
        made["coverage_result"] = shown(there["coverage_result"].withColumn("consent_record_id", F.explode(F.array_distinct("dependencies.consent_record_ids"))), "coverage_result")
    return reduce(DataFrame.unionByName, made.values())


_BODY = ("workspace_id", "sequence", "event_type", "actor_id", "occurred_at", "subject_type", "subject_id", "payload_sha256", "previous_hash")


def _linked(body: dict[str, Any]) -> dict[str, Any]:
    """An event's body with its hash and id."""
    digest = sha256_hex(canonical_json({camel(k): v for k, v in body.items()}))
    return body | {"audit_event_id": scoped_id(body["workspace_id"], "audit_event", {"sequence": body["sequence"], "hash": digest}), "hash": digest}


def audit_event(workspace: str, sequence: int, previous: str | None, event: tuple) -> dict[str, Any]:
    """The next event of a chain; ``event`` is (type, actor, instant, subject type, subject id, payload)."""
    kind, actor, when, subject_type, subject, payload = event
    return _linked(dict(zip(_BODY, (workspace, sequence, kind, actor, when, subject_type, subject, sha256_hex(canonical_json(payload)), previous), strict=True)))


def chained(events: Iterable[tuple], workspace: str, after: dict[str, Any] | None = None) -> Iterator[dict[str, Any]]:
    """Events appended to a chain, one after another: a chain is serial by nature."""
    last = after
    for e in events:
        last = audit_event(workspace, (last["sequence"] if last else 0) + 1, last["hash"] if last else None, e)
        yield last


def chain(events: Iterable[tuple], workspace: str, after: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    return list(chained(events, workspace, after))


def audit_frame(spark: SparkSession, events: list[dict[str, Any]]) -> DataFrame:
    kind = schemas.schema("audit_event")
    return spark.createDataFrame([tuple(e[c] for c in kind.names) for e in events], kind)


def staged_audit_frame(spark: SparkSession, events: Iterable[dict[str, Any]], block: int = 10_000) -> DataFrame:
    """Any number of events, written to the shared folder in blocks: the driver holds one block at a time."""
    path, rest = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex[:12]}", iter(events)
    audit_frame(spark, []).write.parquet(path)
    while some := list(islice(rest, block)):
        audit_frame(spark, some).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schemas.schema("audit_event")).parquet(path)


def chained_frame(events: DataFrame) -> DataFrame:
    """The chains of all workspaces at once.

    ``events`` has (workspace_id, place, event_type, actor_id, occurred_at, subject_type, subject_id, payload: canonical
    JSON).  A workspace's events are chained by ``place``: its chain is serial by nature and made by one task, which
    streams them and holds one batch and the last hash.
    """
    kind = schemas.schema("audit_event")
    names = ("workspace_id", "event_type", "actor_id", "occurred_at", "subject_type", "subject_id", "payload_sha256")
    rows = events.withColumn("payload_sha256", F.sha2("payload", 256)).repartition("workspace_id").sortWithinPartitions("workspace_id", "place").select(*names)

    def run(batches):
        import pyarrow as pa

        last: dict[str, Any] | None = None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                goes_on = last is not None and last["workspace_id"] == row["workspace_id"]
                last = _linked(row | {"sequence": last["sequence"] + 1 if goes_on else 1, "previous_hash": last["hash"] if goes_on else None})
                made.append(last)
            yield pa.RecordBatch.from_pydict({f.name: pa.array([m[f.name] for m in made], pa.int64() if f.name == "sequence" else pa.string()) for f in kind.fields})

    return rows.mapInArrow(run, kind)


#: Events of a block whose number is known without looking into it.
BLOCK = 10_000


def first_break(events: DataFrame) -> DataFrame:
    """(workspace_id, events, first_index, reason): where each workspace's chain breaks first; null where it holds.

    An event meets its predecessor by a join on the number before its own, so a chain of any length is checked by all
    tasks; the place of the first break is the number of events before it, counted by blocks.
    """
    kinds = {f.name: f.dataType for f in schemas.schema("audit_event").fields}
    body = json_object({camel(c): F.coalesce(json_value(F.col(c), kinds[c]), F.lit("null")) for c in _BODY})
    before = events.select("workspace_id", (F.col("sequence") + 1).alias("sequence"), F.struct("hash").alias("before"))
    reason = (
        F.when(F.col("before").isNull() & (F.col("sequence") != 1), "sequence gap")
        .when(~F.col("previous_hash").eqNullSafe(F.col("before.hash")), "previous hash mismatch")
        .when(F.col("hash") != sha256(body), "event hash mismatch")
    )
    bad = events.join(before, ["workspace_id", "sequence"], "left").select("workspace_id", "sequence", reason.alias("reason")).where("reason is not null")
    first = bad.groupBy("workspace_id").agg(F.min(F.struct("sequence", "reason")).alias("first"))
    number = F.floor(F.col("sequence") / BLOCK)
    blocks = events.groupBy("workspace_id", number.alias("block")).agg(F.count("*").alias("n"))
    own = first.select("workspace_id", F.floor(F.col("first.sequence") / BLOCK).alias("block"), F.col("first.sequence").alias("upto"))
    inside = events.select("workspace_id", "sequence", number.alias("block")).join(own, ["workspace_id", "block"]).where("sequence < upto").groupBy("workspace_id").agg(F.count("*").alias("inside"))
    counted = blocks.join(own.select("workspace_id", F.col("block").alias("own_block")), "workspace_id", "left").groupBy("workspace_id").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("block") < F.col("own_block"), F.col("n")).otherwise(0)).alias("earlier"))
    made = counted.join(first, "workspace_id", "left").join(inside, "workspace_id", "left")
    return made.select("workspace_id", "events", F.when(F.col("first").isNotNull(), F.col("earlier") + F.coalesce("inside", F.lit(0))).alias("first_index"), F.col("first.reason").alias("reason"))
