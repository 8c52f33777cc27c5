"""What an operator does to a stored workspace, each as one commit with its audit event.

Every function reads one entry of the store's log, and what it changes becomes visible at once or not at all; if
somebody else changed what it read, it raises ``COMMIT_CONFLICT``.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.config import ConfigError, instant
from kinweft.functions.digest import canonical_json, scoped_id, sha256_hex
from kinweft.operators import adapters, governance, normalize
from kinweft.operators.materialize import ROW_BITS, Request, authorize, canonical_rows, materialize, stage_rows
from kinweft.session import staged
from kinweft.sources import csv_scan, paging, provider_source
from kinweft.sources.csv_scan import Mapping, ScanError
from kinweft.sources.provider_source import Read
from kinweft.sources.store import Store, Transaction

#: Tables that an import's rows are resolved against.
CLAIMS = ("identity_claim", "organization_claim", "employment_claim")
# The kinds of suppression rules.
SUPPRESSIONS = ("person", "organization", "domain", "source", "snapshot", "category", "crm_state")


def _found(tx: Transaction, name: str, workspace: str, row_id: str, code: str) -> dict[str, Any]:
    row = tx.get(name, workspace, row_id)
    if row is None:
        raise ConfigError(code)
    return row


def create_workspace(store: Store, workspace: str, name: str, owner: str, purpose: str, at: str) -> int:
    """A new, empty workspace; one that exists is an error."""
    instant(at)
    tx = store.begin()
    if tx.get("workspace", workspace, workspace) is not None:
        raise ConfigError("WORKSPACE_EXISTS")
    tx.put_row("workspace", {"workspace_id": workspace, "name": name, "owner_actor_id": owner, "purpose_id": purpose, "policy_version": "1", "created_at": at})
    return tx.commit()


def add_contributor(store: Store, workspace: str, row: dict[str, Any], actor: str, at: str) -> str:
    """Register a contributor."""
    if row.get("workspace_id") != workspace:
        raise ConfigError("CROSS_WORKSPACE_CONTRIBUTOR_DENIED")
    instant(at)
    tx = store.begin()
    _found(tx, "workspace", workspace, workspace, "WORKSPACE_NOT_FOUND")
    tx.put_row("contributor", row)
    tx.audit(workspace, "contributor.registered", actor, at, "contributor", row["contributor_id"], {"kind": row.get("kind")})
    tx.commit()
    return row["contributor_id"]


def add_consent(store: Store, workspace: str, row: dict[str, Any], actor: str, at: str) -> str:
    """Register a consent; a stored one may not become wider, active again, or bound otherwise."""
    if row.get("workspace_id") != workspace:
        raise ConfigError("CROSS_WORKSPACE_CONSENT_DENIED")
    instant(at)
    tx = store.begin()
    old = tx.get("consent", workspace, row.get("consent_record_id"))
    if old is not None and (bad := governance.consent_change_errors(old, row)):
        raise ConfigError(bad[0])
    tx.put_row("consent", row)
    tx.audit(workspace, "consent.registered", actor, at, "consent", row["consent_record_id"], {"contributorId": row["contributor_id"], "purposeId": row["purpose_id"], "sourceClasses": row["source_classes"], "allowedCategories": row["allowed_categories"]})
    tx.commit(references=True)
    return row["consent_record_id"]


def _of(tables: dict[str, DataFrame], workspace: str) -> dict[str, DataFrame]:
    return {k: df.where(F.col("workspace_id") == workspace) for k, df in tables.items()}


def withdraw_consent(store: Store, workspace: str, consent: str, actor: str, reason: str, at: str) -> dict[str, Any]:
    """Withdraw a consent with all that rests on it; the receipt has counts and digests only."""
    tx = store.begin()
    row = _found(tx, "consent", workspace, consent, "CONSENT_NOT_FOUND")
    contributor = _found(tx, "contributor", workspace, row["contributor_id"], "CONTRIBUTOR_NOT_FOUND")
    tx.read.update(governance.DEPENDENT)  # what rests on the consent must not change meanwhile
    gone = {k: staged(df, f"gone-{k}") for k, df in store.dependants(workspace, consent, tx.base).items()}
    receipt = governance.receipt(row, {k: df.count() for k, df in gone.items()}, reason, at, actor)
    for name, rows in gone.items():
        tx.delete(name, rows)
    tx.put_row("consent", row | {"status": "withdrawn", "withdrawn_at": at, "withdrawal_reason": reason})
    tx.put_row("contributor", contributor | {"status": "withdrawn"})
    tx.put_row("deletion_receipt", {"workspace_id": workspace, "deletion_receipt_id": receipt["receiptId"], "consent_record_id": consent, "actor_id": actor, "requested_at": at, "completed_at": at, "counts": receipt["counts"], "dependency_digest_sha256": receipt["subjectScopeDigest"]})
    tx.audit(workspace, "consent.withdrawn", actor, at, "deletion_receipt", receipt["receiptId"], {"receiptId": receipt["receiptId"], "counts": receipt["counts"]})
    tx.commit()
    return receipt


def add_suppression(store: Store, workspace: str, kind: str, value: str, reason: str, actor: str, at: str, expires: str | None = None) -> str:
    """Suppress what a rule names, from ``at`` on; the rule's id."""
    if kind not in SUPPRESSIONS or not value or not reason:
        raise ConfigError("SUPPRESSION_INVALID")
    if instant(at) >= (instant(expires) if expires else instant("9999-12-31T00:00:00.000Z")):
        raise ConfigError("SUPPRESSION_CHRONOLOGY")
    rule = scoped_id(workspace, "suppression", {"kind": kind, "value": value, "at": at})
    tx = store.begin()
    _found(tx, "workspace", workspace, workspace, "WORKSPACE_NOT_FOUND")
    tx.put_row("suppression_rule", {"workspace_id": workspace, "suppression_rule_id": rule, "kind": kind, "value": value, "reason_code": reason, "effective_at": at, "expires_at": expires})
    tx.audit(workspace, "suppression.added", actor, at, "suppression_rule", rule, {"kind": kind, "value": value, "reasonCode": reason})
    tx.commit()
    return rule


def remove_suppression(store: Store, workspace: str, rule: str, actor: str, reason: str, at: str) -> str:
    tx = store.begin()
    _found(tx, "suppression_rule", workspace, rule, "SUPPRESSION_NOT_FOUND")
    tx.delete("suppression_rule", store.spark.createDataFrame([(workspace, rule)], "workspace_id string, suppression_rule_id string"))
    tx.audit(workspace, "suppression.removed", actor, at, "suppression_rule", rule, {"reason": reason})
    tx.commit()
    return rule


def reviews(store: Store, workspace: str) -> dict[str, DataFrame]:
    """The candidates for review, of people and of organizations."""
    tables = _of({k: store.table(k) for k in ("person_resolution_candidate", "organization_alias_candidate")}, workspace)
    return {"person": tables["person_resolution_candidate"].orderBy("resolution_candidate_id"), "organization": tables["organization_alias_candidate"].orderBy("organization_alias_candidate_id")}


def decide(store: Store, workspace: str, candidate: str, decision: str, actor: str, reason: str, at: str) -> dict[str, Any]:
    """Approve or reject a candidate.  An approved alias becomes a claim of the organization it stands for."""
    if decision not in ("approve", "reject"):
        raise ConfigError("DECISION_MUST_BE_APPROVE_OR_REJECT")
    instant(at)
    tx = store.begin()
    person = tx.get("person_resolution_candidate", workspace, candidate)
    if person is not None:
        made, said = governance.decide_person(person, decision, actor, reason, at)
        tx.put_row("person_resolution_candidate", made)
    else:
        made, said = governance.decide_alias(_found(tx, "organization_alias_candidate", workspace, candidate, "ALIAS_CANDIDATE_NOT_FOUND"), decision, actor, reason, at)
        tx.put_row("organization_alias_candidate", made)
        if claim := governance.alias_claim(made, said):
            tx.put_row("organization_claim", claim)
    tx.put_row("review_decision", said)
    what = "person_resolution" if person is not None else "organization_alias"
    tx.audit(workspace, f"{what}.decided", actor, at, f"{what}_candidate", candidate, {"decision": decision, "reviewDecisionId": said["review_decision_id"]})
    tx.commit()
    return {"candidate": made, "decision": said}


def record_export(store: Store, workspace: str, run_id: str, file_format: str, view: str, path: str, actor: str, at: str) -> None:
    tx = store.begin()
    tx.audit(workspace, "report.exported", actor, at, "audit_run", run_id, {"format": file_format, "view": view, "outputPathDigest": scoped_id(workspace, "path", path)})
    tx.commit()


class Scanned(NamedTuple):
    """Files scanned at once: (path, raw_sha256, byte_count, error) of each, and their canonical rows with ``path``."""

    about: DataFrame
    rows: DataFrame


def scan_together(store: Store, paths: str, mapping: Mapping, roots: list[str] | None) -> Scanned:
    """Scan many files at once; for :func:`import_files`.  Whoever imports them has to be allowed to read them."""
    scanned = staged(csv_scan.scan(store.spark, paths, mapping, roots), "scan")
    rows = canonical_rows(csv_scan.as_rows(scanned, "path"), mapping.values)
    # files lie apart from one another, so that one file's rows are found without reading the others
    parts = 2 * store.spark.sparkContext.defaultParallelism
    canonical = staged(rows.repartition(parts, "path").sortWithinPartitions("path", "row_number"), "canonical")
    return Scanned(staged(scanned.select("path", "raw_sha256", "byte_count", "error").distinct(), "files"), canonical)


def scan_files(store: Store, paths: str, mapping: Mapping, roots: list[str] | None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(scan, canonical rows) of each of many files, by its path, scanned at once; for :func:`import_csv`."""
    found = scan_together(store, paths, mapping, roots)
    mine = lambda df, path: df.where(F.col("path") == path).drop("path")
    return {r["path"]: (mine(found.about, r["path"]), mine(found.rows, r["path"])) for r in found.about.select("path").distinct().collect()}


def import_csv(store: Store, request: Request, mapping: Any, file: str, roots: list[str] | None, actor: str = "actor_operator", scan: tuple[DataFrame, DataFrame] | None = None) -> dict[str, Any]:
    """Import a file: authorize, scan, canonicalize, resolve and commit, or leave nothing but the record of a failure.

    Returns ``status`` (``committed``, or ``idempotent`` where this import was committed before), the snapshot's id,
    the file's digest and its number of rows.  The same content under another contributor, consent or mapping is
    refused.  One bad row or value refuses the file.  ``request.raw_sha256`` is found here.  The file must be a plain
    one under one of ``roots``; without them it is what the caller's file system has.  ``scan`` is the file's part of
    :func:`scan_files`, if it was scanned with others.
    """
    tx = store.begin()
    workspace = request.workspace
    # what decides whether the file may be read at all is not recorded as an import
    authorize(request, _found(tx, "workspace", workspace, workspace, "CONSENT_BINDING_INVALID"), tx.get("consent", workspace, request.consent), tx.get("contributor", workspace, request.contributor))
    mapped = mapping if isinstance(mapping, Mapping) else Mapping.read(mapping)
    try:
        made = _import(store, tx, request, mapped, file, roots, scan)
    except (ConfigError, ScanError, OSError) as e:
        code = str(e) if not isinstance(e, OSError) else "FILE_OPEN_REJECTED"
        if code != "COMMIT_CONFLICT":
            _record_failure(store, request, code)
        raise ConfigError(code) from e
    if made["status"] == "committed":
        tx.audit(workspace, "csv.imported", actor, request.imported_at, "source_snapshot", made["source_snapshot_id"], {"recordCount": made["record_count"], "status": made["status"]})
        tx.commit(references=True)
    return made


def _import(store: Store, tx: Transaction, request: Request, mapping: Mapping, file: str, roots: list[str] | None, scan: tuple[DataFrame, DataFrame] | None) -> dict[str, Any]:
    scanned = scan[0] if scan else staged(csv_scan.scan(store.spark, file, mapping, roots), "scan")
    about = scanned.select("raw_sha256", "byte_count", "error").first()
    if about["error"] is not None:
        raise ConfigError(about["error"])
    canonical = scan[1] if scan else staged(canonical_rows(csv_scan.as_rows(scanned), mapping.values), "canonical")
    if bad := canonical.where("reject_code is not null").orderBy("row_number").head(1):
        raise ConfigError(bad[0]["reject_code"])
    request = replace(request, raw_sha256=about["raw_sha256"], byte_count=about["byte_count"], record_count=canonical.count())
    done = {"source_snapshot_id": request.snapshot(), "raw_sha256": request.raw_sha256, "record_count": request.record_count}
    same = tx.table("source_snapshot").where((F.col("workspace_id") == request.workspace) & ((F.col("idempotency_key") == request.key()) | (F.col("raw_sha256") == request.raw_sha256)))
    known = {r["idempotency_key"]: r for r in same.select("idempotency_key", "source_snapshot_id", "record_count").limit(1000).collect()}
    if request.key() in known:
        held = known[request.key()]
        return done | {"status": "idempotent", "source_snapshot_id": held["source_snapshot_id"], "record_count": held["record_count"]}
    if known:
        raise ConfigError("SNAPSHOT_REBINDING_REJECTED")
    rows = stage_rows(canonical, None, request)
    for name, df in materialize(rows, request, _of(tx.tables(CLAIMS), request.workspace)).items():
        tx.put(name, df)
    return done | {"status": "committed"}


def import_files(store: Store, requests: dict[str, Request], scan: Scanned, actor: str = "actor_operator") -> dict[str, dict[str, Any]]:
    """Import many files as one commit: the tables are those that :func:`import_csv` of one after another would leave.

    ``requests`` has the paths of the scan in the order that files come in; they differ in their mapping only.  Rows
    of all files are resolved at once, each against those before it, so an import reads what is stored once and not
    once for each file.  The result has what :func:`import_csv` returns of each file.  A file that is refused refuses
    all: nothing is left but the record of its failure.
    """
    tx, base = store.begin(), next(iter(requests.values()))
    bound = lambda r: replace(r, mapping="", mapping_version="", raw_sha256="", byte_count=None, record_count=None)
    if len({bound(r) for r in requests.values()}) > 1:
        raise ValueError("files of one import differ in their mapping only")
    workspace = base.workspace
    authorize(base, _found(tx, "workspace", workspace, workspace, "CONSENT_BINDING_INVALID"), tx.get("consent", workspace, base.consent), tx.get("contributor", workspace, base.contributor))
    about = {r["path"]: r for r in scan.about.collect()}
    bad = F.min(F.when(F.col("reject_code").isNotNull(), F.struct("row_number", "reject_code")))
    told = {r["path"]: r for r in scan.rows.groupBy("path").agg(F.count("*").alias("n"), bad.alias("bad")).collect()}
    full = {p: replace(r, raw_sha256=about[p]["raw_sha256"] or "", byte_count=about[p]["byte_count"], record_count=told[p]["n"] if p in told else 0) for p, r in requests.items()}
    same = tx.table("source_snapshot").where((F.col("workspace_id") == workspace) & (F.col("idempotency_key").isin(*[r.key() for r in full.values()]) | F.col("raw_sha256").isin(*[r.raw_sha256 for r in full.values()])))
    known = {r["idempotency_key"]: r.asDict() for r in same.select("idempotency_key", "raw_sha256", "source_snapshot_id", "record_count").collect()}
    contents = {r["raw_sha256"] for r in known.values()}
    made, new = {}, {}
    for path, request in full.items():
        held, refused = known.get(request.key()), told[path]["bad"] if path in told else None
        code = about[path]["error"] or (refused and refused["reject_code"]) or ("SNAPSHOT_REBINDING_REJECTED" if held is None and request.raw_sha256 in contents else None)
        if code:
            _record_failure(store, requests[path], code)
            raise ConfigError(code)
        if held is None:
            held = known[request.key()] = {"source_snapshot_id": request.snapshot(), "record_count": request.record_count}
            contents.add(request.raw_sha256)
            new[path] = request
        made[path] = {"source_snapshot_id": held["source_snapshot_id"], "raw_sha256": request.raw_sha256, "record_count": held["record_count"], "status": "committed" if path in new else "idempotent"}
    if new:
        places = store.spark.createDataFrame([(p, i, r.snapshot()) for i, (p, r) in enumerate(new.items())], "path string, file long, source_snapshot_id string")
        rows = stage_rows(scan.rows.join(F.broadcast(places), "path").drop("path"), None, base)
        rows = rows.withColumn("row_number", F.shiftleft("file", ROW_BITS) + F.col("row_number")).drop("file")
        for name, df in materialize(rows, base, _of(tx.tables(CLAIMS), workspace), list(new.values())).items():
            tx.put(name, df)
        for r in new.values():
            tx.audit(workspace, "csv.imported", actor, r.imported_at, "source_snapshot", r.snapshot(), {"recordCount": r.record_count, "status": "committed"})
        tx.commit(references=True)
    return made


def _record_failure(store: Store, request: Request, code: str) -> None:
    """Keep that an import failed and why; nothing of the file's content."""
    about = {k: v for k, v in request.binding().items() if k != "rawSha256"} | {"startedAt": request.imported_at}
    key = sha256_hex(canonical_json(about | {"code": code}))
    tx = store.begin()
    row = {"workspace_id": request.workspace, "import_transaction_id": scoped_id(request.workspace, "failed_import", key), "contributor_id": request.contributor, "consent_record_id": request.consent, "source_kind": request.source_kind, "mapping_id": request.mapping, "mapping_version": request.mapping_version}
    tx.put_row("import_transaction", row | {"idempotency_key": key, "status": "failed", "failure_codes": [code], "created_at": request.imported_at, "completed_at": request.imported_at})
    tx.commit()




def ingest_adapter(store: Store, authorization: dict[str, Any], read: Read, workspace: str, contributor: str, consent: str, at: str, since: str, until: str, allowed_fields: list[str], capability: str = "list", cursor: str | None = None, limit: int = 100, actor: str = "actor_operator") -> dict[str, Any]:
    """Read a provider from a cursor, and commit its new records with the claims they make.

    Returns ``status`` (``completed``, or ``rate_limited`` and ``temporary_error`` with the cursor to go on from),
    ``next_cursor``, and how many records were ``accepted`` or ``duplicates``.  A record that is not allowed, or that
    says otherwise what was accepted under its key, refuses all.  A reading holds at most 10,000 records.
    """
    tx = store.begin()
    held = _found(tx, "workspace", workspace, workspace, "WORKSPACE_NOT_FOUND")
    adapters.authorize(authorization, workspace, authorization["adapter_id"], authorization["provider"], held["purpose_id"], capability, instant(at))
    agreed = _found(tx, "consent", workspace, consent, "CONSENT_NOT_FOUND")
    if agreed["contributor_id"] != contributor or agreed["purpose_id"] != held["purpose_id"] or agreed["status"] != "active" or agreed["withdrawn_at"] or not instant(agreed["granted_at"]) <= instant(at) < instant(agreed["expires_at"]):
        raise ConfigError("CONSENT_BINDING_INVALID")
    progress, name = paging.Progress(cursor), authorization["adapter_authorization_id"]
    rows = [provider_source.row(r, name) for page in paging.pages(read, progress, limit) for r in page]
    records = store.spark.createDataFrame(rows, provider_source.RECORD)
    judged = staged(adapters.accept(records, tx.table("adapter_metadata_record").where(F.col("workspace_id") == workspace), allowed_fields, since, until), "judged")
    counts = {r["verdict"]: r["n"] for r in judged.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if bad := sorted(set(counts) - {"accepted", "duplicate"}):
        raise ConfigError(bad[0])
    made = {"status": progress.status, "next_cursor": None if progress.status == "completed" else progress.cursor, "retry_after": progress.retry_after, "accepted": counts.get("accepted", 0), "duplicates": counts.get("duplicate", 0)}
    if made["accepted"]:
        said = judged.where("verdict = 'accepted'").select("*", *[F.get_json_object("fields", f"$.{c}").alias(c) for c in normalize.FIELDS])
        source = normalize.Source(workspace, name, authorization["provider"], authorization["provider_tenant_id"], contributor, consent, at)
        for table, df in normalize.normalize(said, source).items():
            tx.put(table, df)
    event = "adapter_ingest" if progress.status == "completed" else "adapter_checkpointed_error"
    tx.audit(workspace, event, actor, at, "adapter_authorization", name, {k: v for k, v in made.items() if v is not None})
    tx.commit()
    return made
