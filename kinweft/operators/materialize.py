"""From scanned rows to claims: canonical rows, groups, who and which organization a row is, and all tables of an import.

Rows are resolved in their order, but no row waits for another task: a row asks with one identifier, so rows fall
into groups by it, and only rows that ask with a stronger kind of identifier can have carried it before.  Kinds are
taken from strong to weak; within a group, whether no, one or several subjects carried the identifier before a row is
a running minimum and maximum.

Several files are imported together as if one after another: their rows have one order (:func:`in_file`), and the ids
of what a row becomes are of its own file's snapshot, which it then names as ``source_snapshot_id``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import ConfigError, instant
from kinweft.functions import scalars
from kinweft.functions.digest import canonical_json, json_object, json_string, scoped_id, scoped_id_column, sha256, sha256_hex
from kinweft.operators import employment
from kinweft.operators.claims import EVIDENCE_KINDS
from kinweft.session import staged

#: The fields that a mapping can fill.
FIELDS = ("full_name", "first_name", "last_name", "email", "profile_url", "provider_person_id", "crm_contact_id", "title", "company_name", "company_domain", "crm_account_id", "provider_organization_id", "connected_on", "source_observed_at")
TRANSFORM = "csv-v2"
#: Bits of a row's number within its file; the bits above are the file's place among those imported with it.
ROW_BITS = 32
#: Identifiers of people from strong to weak: field, kind of claim, and what its namespace ends with.
PERSON_KEYS = (("provider_person_id", "provider_id", "provider_person"), ("crm_contact_id", "provider_id", "crm_contact"), ("profile_url", "profile_url", "profile"), ("email", "email", "email"))


@dataclass(frozen=True)
class Request:
    """What an import is bound to."""

    workspace: str
    contributor: str
    consent: str
    source_kind: str
    mapping: str
    mapping_version: str
    imported_at: str
    raw_sha256: str
    byte_count: int | None = None
    record_count: int | None = None

    def binding(self) -> dict[str, str]:
        return {"workspaceId": self.workspace, "contributorId": self.contributor, "consentRecordId": self.consent, "sourceKind": self.source_kind, "mappingId": self.mapping, "mappingVersion": self.mapping_version, "rawSha256": self.raw_sha256}

    def key(self) -> str:
        return sha256_hex(canonical_json(self.binding()))

    def snapshot(self) -> str:
        return scoped_id(self.workspace, "snapshot", self.binding())


def authorize(request: Request, workspace: dict[str, Any], consent: dict[str, Any] | None, contributor: dict[str, Any] | None) -> None:
    """Raise unless the consent lets this contributor's source of this kind be imported now."""
    if consent is None or consent["contributor_id"] != request.contributor or consent["purpose_id"] != workspace["purpose_id"]:
        raise ConfigError("CONSENT_BINDING_INVALID")
    at: datetime = instant(request.imported_at)
    kind = request.source_kind.strip().lower()
    classes = [c.strip().lower() for c in consent["source_classes"]]
    covered = kind in classes or "connections_csv" in classes and (kind.endswith("connections_export") or kind == "generic_contacts_csv")
    checks = {
        "CONSENT_WITHDRAWN": consent["status"] != "withdrawn" and not consent.get("withdrawn_at"), "CONSENT_INACTIVE": consent["status"] == "active", "CONSENT_NOT_YET_ACTIVE": at >= instant(consent["granted_at"]),
        "CONSENT_EXPIRED": at < instant(consent["expires_at"]), "CONTRIBUTOR_INACTIVE": contributor is not None and contributor["status"] == "active", "CONSENT_SOURCE_SCOPE_DENIED": covered,
    }
    for code, ok in checks.items():
        if not ok:
            raise ConfigError(code)


def idempotency(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``requests`` (raw_sha256, idempotency_key, ...) with ``status``: ``committed``, ``idempotent`` or ``rebinding``.

    An import with the key of a snapshot is that snapshot; the same content under another key is refused.
    """
    known = snapshots.groupBy("idempotency_key").agg(F.min("source_snapshot_id").alias("same_snapshot"))
    bound = snapshots.select("raw_sha256").distinct().withColumn("bound", F.lit(True))
    made = requests.join(known, "idempotency_key", "left").join(bound, "raw_sha256", "left")
    return made.withColumn("status", F.when(F.col("same_snapshot").isNotNull(), "idempotent").when(F.col("bound"), "rebinding").otherwise("committed")).drop("bound")


def canonical_rows(rows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with every field of :data:`FIELDS` in canonical form, and ``reject_code`` where a value is not usable.

    Fields that are not there are null; blank values are absent.  Other columns stay.  Rows are dealt out first: a
    small file is one task's, and its values cost more than its bytes tell.
    """
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "row_number")
    there = [f for f in FIELDS if f in rows.columns]
    clean = {f: F.when(scalars.trimmed(F.col(f)) != "", scalars.trimmed(scalars.nfkc(F.col(f)))) for f in there}
    made = rows.select(*[c for c in rows.columns if c not in FIELDS], *[clean.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS])
    control = reduce(lambda a, b: a | b, [F.coalesce(scalars.has_control(F.col(f)), F.lit(False)) for f in FIELDS])
    missing = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in required], F.lit(False))
    email, domain, url = scalars.folded(F.col("email")), scalars.normalize_domain(F.col("company_domain")), scalars.normalize_profile_url(F.col("profile_url"))
    dates = {f: scalars.iso_millis(scalars.observed_ts(F.col(f))) for f in ("connected_on", "source_observed_at")}
    joined = F.concat_ws(" ", "first_name", "last_name")
    name = F.coalesce("full_name", F.when(joined != "", joined))
    code = (
        F.when(missing, "REQUIRED_MAPPED_VALUE_MISSING").when(control, "CONTROL_CHARACTER_REJECTED").when(F.col("email").isNotNull() & ~scalars.is_email(email), "INVALID_EMAIL")
        .when(F.col("profile_url").isNotNull() & url.isNull(), "INVALID_PROFILE_URL").when(F.col("company_domain").isNotNull() & domain.isNull(), "INVALID_COMPANY_DOMAIN")
        .when(reduce(lambda a, b: a | b, [F.col(f).isNotNull() & v.isNull() for f, v in dates.items()]), "INVALID_OBSERVED_AT").when(name.isNull(), "PERSON_NAME_REQUIRED")
    )
    return made.withColumns({"reject_code": code, "full_name": name, "email": email, "company_domain": domain, "profile_url": url, **dates})


def _files(df: DataFrame) -> list[str]:
    """The column that tells the files of rows apart, if rows of several are imported together."""
    return [c for c in ("source_snapshot_id",) if c in df.columns]


def _snapshot(df: DataFrame, request: Request) -> Column:
    return F.col("source_snapshot_id") if _files(df) else F.lit(request.snapshot())


def in_file(row_number: str) -> Column:
    """The place of a row's file among those imported with it."""
    return F.shiftright(F.col(row_number).cast("long"), ROW_BITS)


def stage_rows(canonical: DataFrame, raw: list[str] | None, request: Request) -> DataFrame:
    """Rows with ``row_digest``, ``group_digest`` (of the canonical fields), and ``record_id``.

    The row's digest is that of its ``raw`` columns; without ``raw`` the rows bring it.
    """
    json = lambda names: json_object({n: json_string(F.col(n).cast("string")) for n in names})
    made = canonical.withColumns({"row_digest": F.col("row_digest") if raw is None else sha256(json(raw)), "group_digest": sha256(json(FIELDS))})
    record = json_object({"sourceSnapshotId": json_string(_snapshot(made, request)), "rowNumber": F.col("row_number").cast("string"), "rowDigest": json_string(F.col("row_digest"))})
    return made.withColumn("record_id", scoped_id_column(request.workspace, "record", record))


def evidence_id(request: Request, record: Column, claim_type: Column, snapshot: Column) -> Column:
    return scoped_id_column(request.workspace, "evidence", json_object({"sourceSnapshotId": json_string(snapshot), "sourceRecordId": json_string(record), "claimType": json_string(claim_type)}))


def groups(rows: DataFrame) -> DataFrame:
    """The first row of every group of equal canonical rows of a file, with all the group's ``records``, in order.

    Rows are written before they are grouped, and groups before they are resolved, which reads them several times:
    canonical values are worked out once for each row.
    """
    rows = staged(rows, "rows")
    by = ["group_digest", *_files(rows)]
    first = rows.groupBy(*by).agg(F.min("row_number").alias("row_number"), F.array_sort(F.collect_list(F.struct("row_number", "record_id"))).alias("records"))
    return staged(rows.join(first.withColumn("records", F.col("records.record_id")), [*by, "row_number"]), "groups")


def carried_before(own: DataFrame, carriers: DataFrame, subject: str) -> DataFrame:
    """``own`` (value, row_number, provisional, ...) with ``outcome`` and ``subject``: ``new``, ``exact`` or ``review``.

    ``carriers`` (value, row_number, subject) are the subjects that carry a value, from their row on; what was stored
    before has a negative row number.  A value that no subject carried before is new, and its first row's provisional
    subject carries it from then on.
    """
    extra = [c for c in own.columns if c not in ("value", "row_number")]
    both = own.withColumn("own", F.lit(True)).withColumn("carrier", F.lit(None).cast("string")).select("value", "row_number", "own", "carrier", *extra)
    both = both.unionByName(carriers.select("value", "row_number", F.lit(False).alias("own"), F.col(subject).alias("carrier")), allowMissingColumns=True)
    # a row's own values do not count before it
    before = Window.partitionBy("value").orderBy("row_number").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"lo": F.min("carrier").over(before), "hi": F.max("carrier").over(before)}).where("own")
    upto = Window.partitionBy("value").orderBy("row_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"head": F.first(F.struct(F.col("lo").isNull().alias("new"), "provisional", "row_number")).over(upto)})
    mine = F.when(F.col("head.new") & (F.col("head.row_number") < F.col("row_number")), F.col("head.provisional"))
    lo, hi = F.least(F.col("lo"), mine), F.greatest(F.col("hi"), mine)
    outcome = F.when(lo.isNull(), "new").when(lo == hi, "exact").otherwise("review")
    made = seen.withColumns({"outcome": outcome, subject: F.when(outcome == "exact", lo).otherwise(F.col("provisional")), "rivals": F.when(outcome == "review", F.array_distinct(F.array(lo, hi)))})
    return made.drop("own", "carrier", "lo", "hi", "head")


def resolve_people(first: DataFrame, claims: DataFrame, request: Request) -> DataFrame:
    """``first`` (one row for each group) with ``person_outcome``, ``person_id`` and ``person_rivals``.

    ``claims`` are the identity claims stored before.  ``person_rivals`` has two of the people that an identifier
    collides between.
    """
    ws, ns = request.workspace, request.source_kind
    norm = lambda c: scalars.folded(scalars.nfkc(c))
    unique = F.col("email").isNotNull() & (scalars.email_risk(F.col("email")) == "unique_candidate")
    kinds = [F.when(unique if f == "email" else F.col(f).isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), F.col(f).alias("value"))) for i, (f, kind, _) in enumerate(PERSON_KEYS)]
    rows = first.withColumn("anchor", F.coalesce(*kinds, F.struct(F.lit(len(PERSON_KEYS)).alias("rank"), F.lit("row_group").alias("kind"), F.col("group_digest").alias("value"))))
    pair = F.concat(F.lit("["), json_string(F.col("anchor.kind")), F.lit(","), json_string(F.col("anchor.value")), F.lit("]"))
    unresolved = scoped_id_column(ws, "unresolved_person", json_object({"sourceSnapshotId": json_string(_snapshot(rows, request)), "group": json_string(F.col("group_digest"))}))
    rows = staged(rows.select("row_number", "group_digest", "full_name", *[f for f, _, _ in PERSON_KEYS], "anchor", scoped_id_column(ws, "person", json_object({"namespace": json_string(F.lit(ns)), "anchor": pair})).alias("provisional"), unresolved.alias("unresolved")), "people")
    asked = {r[0] for r in rows.select("anchor.rank").distinct().collect()}
    done = None
    for rank, (field, kind, qualifier) in enumerate(PERSON_KEYS):
        if rank not in asked:
            continue
        seeds = claims.where((F.col("workspace_id") == ws) & (F.col("kind") == kind) & (F.col("namespace") == f"{ns}:{qualifier}")).select(norm(F.col("value")).alias("value"), F.lit(-1).cast("long").alias("row_number"), "person_id")
        if done is not None:
            seeds = seeds.unionByName(done.where(F.col(field).isNotNull()).select(norm(F.col(field)).alias("value"), F.col("row_number").cast("long"), "person_id"))
        own = rows.where(F.col("anchor.rank") == rank).withColumns({"value": norm(F.col(field)), "row_number": F.col("row_number").cast("long")})
        made = carried_before(own, seeds, "person_id")
        made = made.withColumn("person_id", F.when(F.col("outcome") == "review", F.col("unresolved")).otherwise(F.col("person_id")))
        if _files(first):  # who was left for review in a file carries its identifier for the files after it
            earlier = Window.partitionBy("value").orderBy(in_file("row_number")).rangeBetween(Window.unboundedPreceding, -1)
            left = F.when(F.col("outcome") == "review", F.col("person_id"))
            rivals = F.array(F.least(F.col("rivals")[0], F.min(left).over(earlier)), F.greatest(F.col("rivals")[1], F.max(left).over(earlier)))
            made = made.withColumn("rivals", F.when(F.col("outcome") == "review", rivals))
        made = made.drop("value")
        done = staged(made if done is None else done.unionByName(made), "people")
    # names never decide: a row known by its name only is for review, and apart from whoever has the name
    names = claims.where((F.col("workspace_id") == ws) & (F.col("kind") == "name") & (F.col("namespace") == f"{ns}:name")).select(norm(F.col("value")).alias("value"), F.lit(-1).cast("long").alias("row_number"), F.lit(False).alias("own"))
    all_rows = rows.withColumns({"value": norm(F.col("full_name")), "row_number": F.col("row_number").cast("long"), "own": F.lit(True)})
    before = Window.partitionBy("value").orderBy("row_number").rangeBetween(Window.unboundedPreceding, -1)
    named = all_rows.unionByName(names, allowMissingColumns=True).withColumn("earlier", F.count("*").over(before)).where(F.col("own") & (F.col("anchor.rank") == len(PERSON_KEYS)))
    known = F.col("email").isNull() & (F.col("earlier") > 0)
    last = named.withColumns({"outcome": F.lit("review"), "person_id": F.when(known, F.col("unresolved")).otherwise(F.col("provisional")), "rivals": F.array().cast("array<string>")}).drop("value", "own", "earlier")
    found = (last if done is None else done.unionByName(last)).select("row_number", F.col("outcome").alias("person_outcome"), "person_id", F.col("rivals").alias("person_rivals"))
    return first.join(found, "row_number")


def resolve_organizations(first: DataFrame, claims: DataFrame, request: Request) -> DataFrame:
    """``first`` with ``organization_outcome``, ``organization_id``, ``organization_kind`` and ``organization_value``; null where a row names none."""
    ws, ns = request.workspace, request.source_kind
    norm = lambda c: scalars.folded(scalars.nfkc(c))
    crm = F.coalesce("crm_account_id", "provider_organization_id")
    kind = F.when(crm.isNotNull(), "crm_id").when(F.col("company_domain").isNotNull(), "domain").when(F.col("company_name").isNotNull(), "name")
    value = F.coalesce(crm, "company_domain", "company_name")
    rows = first.withColumns({"organization_kind": kind, "organization_value": value}).where("organization_kind is not null")
    named = json_object({"namespace": json_string(F.lit(ns)), "orgKind": json_string(F.col("organization_kind")), "orgValue": json_string(F.col("organization_value"))})
    rows = staged(rows.select(F.col("row_number").cast("long"), "organization_kind", "organization_value", "company_domain", "crm_account_id", "provider_organization_id", scoped_id_column(ws, "organization", named).alias("provisional")), "organizations")

    def stored(kind: str) -> DataFrame:
        return claims.where((F.col("workspace_id") == ws) & (F.col("kind") == kind) & (F.col("namespace") == ns)).select(norm(F.col("value")).alias("value"), F.lit(-1).cast("long").alias("row_number"), "organization_id")

    own = rows.where("organization_kind = 'crm_id'").withColumn("value", norm(F.col("organization_value")))
    made = own.withColumn("organization_id", F.col("provisional"))
    while True:  # a row with two ids carries the second one too; what it is may hang on rows before it
        second = made.where("crm_account_id is not null and provider_organization_id is not null").select(norm(F.col("provider_organization_id")).alias("value"), "row_number", "organization_id")
        now = staged(carried_before(own, stored("crm_id").unionByName(second), "organization_id"), "organizations")
        same = now.join(made.select("row_number", F.col("organization_id").alias("was")), "row_number").where("organization_id <> was").isEmpty()
        made = now
        if same or second.isEmpty():
            break
    free = F.col("value").isin(*scalars.FREE_MAIL_DOMAINS)
    domains = rows.where("organization_kind = 'domain'").withColumn("value", norm(F.col("company_domain")))
    carriers = stored("domain").unionByName(made.where("company_domain is not null").select(norm(F.col("company_domain")).alias("value"), "row_number", "organization_id"))
    by_domain = carried_before(domains, carriers, "organization_id")
    by_domain = by_domain.withColumns({"organization_id": F.when(free, F.col("provisional")).otherwise(F.col("organization_id")), "outcome": F.when(free, "review").otherwise(F.col("outcome"))})
    by_name = rows.where("organization_kind = 'name'").withColumns({"outcome": F.lit("review"), "organization_id": F.col("provisional")})
    keep = ["row_number", "organization_kind", "organization_value", F.col("outcome").alias("organization_outcome"), "organization_id"]
    found = made.select(*keep).unionByName(by_domain.select(*keep)).unionByName(by_name.select(*keep))
    return first.join(found, "row_number", "left")


def employment_status(claims: DataFrame, order: str, imported_at: str) -> DataFrame:
    """``claims`` with the ``review_status`` that an import gives them, in the order they came.

    A claim against an earlier one is conflicted, one of more than a year before the import not reviewed.  Claims may
    tell by ``file`` and ``kept`` which came together, and which of them those after them met (:func:`employment.conflicts`).
    """
    clash = employment.conflicts(claims, order).select("employment_claim_id", order).distinct().withColumn("clash", F.lit(True))
    late = (F.unix_millis(F.try_to_timestamp(F.lit(imported_at))) - F.unix_millis(F.try_to_timestamp("observed_at"))) > employment.YEAR_MS
    status = F.when(F.col("clash"), "conflicted").when(F.coalesce(late, F.lit(True)), "unreviewed").otherwise("approved")
    return claims.join(clash, ["employment_claim_id", order], "left").withColumn("review_status", status).drop("clash")


def _as_table(df: DataFrame, name: str, request: Request, **columns: Column) -> DataFrame:
    exprs = {"workspace_id": F.lit(request.workspace), "source_snapshot_id": _snapshot(df, request), **columns}
    return df.select(*[exprs.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(name).fields])


def materialize(rows: DataFrame, request: Request, tables: dict[str, DataFrame], files: list[Request] | None = None) -> dict[str, DataFrame]:
    """The rows that an import adds to each table.

    ``rows`` are staged rows (:func:`stage_rows`) without reject codes; ``tables`` are those stored before.  Equal
    canonical rows make one person, one employment and one edge, with the evidence of all.  Of several ``files``,
    whose requests differ in mapping and content only, rows name their snapshot, and their numbers are in the files'
    order; the tables are those that one import after another would leave.
    """
    ws, ns = request.workspace, request.source_kind
    snapshot, by = _snapshot(rows, request), _files(rows)
    text = lambda c: json_string(c)
    name = lambda scope, /, **fields: scoped_id_column(ws, scope, json_object({k: text(v) for k, v in fields.items()}))
    found = resolve_organizations(resolve_people(groups(rows), tables["identity_claim"], request), tables["organization_claim"], request)
    observed = F.coalesce("source_observed_at", "connected_on", F.lit(request.imported_at))
    found = staged(found.withColumns({"observed": observed, **{f"{k}_evidence": F.array(evidence_id(request, F.col("record_id"), F.lit(k), snapshot)) for k in EVIDENCE_KINDS[:3]}}), "import")
    review = F.col("person_outcome") == "review"
    evidence = rows.withColumn("claim_type", F.explode(F.array(*[F.lit(k) for k in EVIDENCE_KINDS])))
    made = {"evidence_ref": _as_table(evidence, "evidence_ref", request, evidence_ref_id=evidence_id(request, F.col("record_id"), F.col("claim_type"), snapshot), source_record_id=F.col("record_id"), claim_type=F.col("claim_type"), row_digest_sha256=F.col("row_digest"), transform_version=F.lit(TRANSFORM))}
    made["person"] = _as_table(found.groupBy("person_id").agg(F.max_by("full_name", "row_number").alias("full_name")), "person", request, person_id=F.col("person_id"), display_name=F.col("full_name"), created_at=F.lit(request.imported_at))
    candidate = name("person_review", sourceSnapshotId=snapshot, group=F.col("group_digest"))
    rivals = F.when(F.size("person_rivals") > 0, F.col("person_rivals")).otherwise(F.array("person_id"))
    signal = F.when(F.size("person_rivals") > 1, "identifier_collision").otherwise("ambiguous_name")
    made["person_resolution_candidate"] = _as_table(found.where(review), "person_resolution_candidate", request, resolution_candidate_id=candidate, subject_person_id=F.col("person_id"), candidate_person_ids=rivals, signals=F.array(signal), confidence=F.lit(0.0), status=F.lit("pending"), automatic_merge_allowed=F.lit(False))

    def each(df: DataFrame, values: list[tuple[str, str, str]]) -> DataFrame:
        c = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f).alias("value"), F.lit(q).alias("qualifier")) for f, k, q in values])
        return df.select("*", F.explode(c).alias("c")).where("c.value is not null")

    people = each(found, [("full_name", "name", "name"), ("email", "email", "email"), ("profile_url", "profile_url", "profile"), *PERSON_KEYS[:2]])
    claim = name("identity_claim", personId=F.col("person_id"), namespace=F.lit(ns), kind=F.col("c.kind"), value=F.col("c.value"), sourceSnapshotId=snapshot)
    identity = _as_table(people, "identity_claim", request, identity_claim_id=claim, person_id=F.col("person_id"), kind=F.col("c.kind"), namespace=F.concat(F.lit(f"{ns}:"), "c.qualifier"), value=F.col("c.value"), evidence_refs=F.col("identity_evidence"), confidence=F.when(F.col("c.kind") == "name", 0.6).otherwise(1.0), observed_at=F.col("observed"), review_status=F.when(review, "conflicted").otherwise("unreviewed"))
    made["identity_claim"] = identity.dropDuplicates(["identity_claim_id"])
    works = found.where("organization_id is not null")
    made["organization"] = _as_table(works.groupBy("organization_id").agg(F.max_by(F.coalesce("company_name", "company_domain", F.lit("Unreviewed organization")), "row_number").alias("label")), "organization", request, organization_id=F.col("organization_id"), canonical_name=F.col("label"), created_at=F.lit(request.imported_at))
    orgs = each(works, [("company_name", "name", ""), ("company_domain", "domain", ""), ("crm_account_id", "crm_id", ""), ("provider_organization_id", "crm_id", "")])
    open_ = F.col("organization_outcome") == "review"
    claim = name("organization_claim", organizationId=F.col("organization_id"), namespace=F.lit(ns), kind=F.col("c.kind"), value=F.col("c.value"), sourceSnapshotId=snapshot)
    made["organization_claim"] = _as_table(orgs, "organization_claim", request, organization_claim_id=claim, organization_id=F.col("organization_id"), kind=F.col("c.kind"), namespace=F.lit(ns), value=F.col("c.value"), evidence_refs=F.col("organization_evidence"), confidence=F.when(F.col("c.kind") == "name", 0.5).otherwise(1.0), observed_at=F.col("observed"), review_status=F.when(open_, "unreviewed").otherwise("approved")).dropDuplicates(["organization_claim_id"])
    made["organization_alias_candidate"] = _as_table(works.where(open_), "organization_alias_candidate", request, organization_alias_candidate_id=name("organization_review", sourceSnapshotId=snapshot, group=F.col("group_digest")), proposed_organization_id=F.col("organization_id"), alias_kind=F.col("organization_kind"), alias_value=F.col("organization_value"), evidence_refs=F.col("organization_evidence"), consequences=F.array(F.lit("employment_and_account_matching_ineligible_until_review")), status=F.lit("pending"))
    job = name("employment", personId=F.col("person_id"), organizationId=F.col("organization_id"), title=F.coalesce("title", F.lit("")), sourceSnapshotId=snapshot)
    jobs = _as_table(works, "employment_claim", request, employment_claim_id=job, person_id=F.col("person_id"), organization_id=F.col("organization_id"), title=F.col("title"), state=F.lit("current"), evidence_refs=F.col("employment_evidence"), confidence=F.lit(0.7), observed_at=F.col("observed"), review_status=F.col("row_number").cast("string"))
    jobs = jobs.withColumn("position", F.col("review_status").cast("long"))
    before = tables["employment_claim"].withColumn("position", F.lit(-1).cast("long"))
    if by:  # of a file's claims with one id the last is stored, and files after it meet that one only
        jobs = jobs.withColumns({"file": in_file("position"), "kept": F.col("position") == F.max("position").over(Window.partitionBy("employment_claim_id"))})
        before = before.withColumns({"file": F.lit(-1).cast("long"), "kept": F.lit(True)})
    jobs = employment_status(staged(before.unionByName(jobs), "employments"), "position", request.imported_at).where("position >= 0")
    last = jobs.groupBy("employment_claim_id").agg(F.max("position").alias("position"))
    made["employment_claim"] = jobs.join(last, ["employment_claim_id", "position"]).select(*tables["employment_claim"].columns)
    edges = found.withColumn("refs", F.transform("records", lambda r: evidence_id(request, r, F.lit("relationship"), snapshot)))
    last = edges.groupBy(*by, "person_id").agg(F.max("row_number").alias("row_number"))
    edge = name("edge", contributorId=F.lit(request.contributor), sourceSnapshotId=snapshot, personId=F.col("person_id"))
    made["relationship_edge"] = _as_table(edges.join(last, [*by, "person_id", "row_number"]), "relationship_edge", request, relationship_edge_id=edge, contributor_id=F.lit(request.contributor), destination_person_id=F.col("person_id"), consent_record_id=F.lit(request.consent), assertion_kind=F.lit("contributed_direct_connection"), observed_at=F.col("observed"), confidence=F.lit(1.0), evidence_refs=F.col("refs"), eligible=~review)
    shared = {"workspace_id": ws, "contributor_id": request.contributor, "consent_record_id": request.consent, "source_kind": ns, "transform_version": TRANSFORM, "raw_retained": False, "network_accessed": False, "status": "committed", "failure_codes": [], "imported_at": request.imported_at, "created_at": request.imported_at, "completed_at": request.imported_at}
    own = [shared | {"source_snapshot_id": r.snapshot(), "import_transaction_id": scoped_id(ws, "import", r.key()), "raw_sha256": r.raw_sha256, "idempotency_key": r.key(), "mapping_id": r.mapping, "mapping_version": r.mapping_version, "byte_count": r.byte_count, "record_count": r.record_count, "row_count": r.record_count} for r in files or [request]]
    for table in ("source_snapshot", "import_transaction"):
        made[table] = rows.sparkSession.createDataFrame([tuple(r.get(c) for c in schemas.schema(table).names) for r in own], schemas.schema(table))
    return made


#: Which columns of a table name rows of another one.
REFERENCES = {
    "consent": {"contributor_id": "contributor"}, "source_snapshot": {"contributor_id": "contributor", "consent_record_id": "consent"}, "adapter_metadata_record": {"contributor_id": "contributor", "consent_record_id": "consent"},
    "identity_claim": {"person_id": "person"}, "organization_claim": {"organization_id": "organization"}, "employment_claim": {"person_id": "person", "organization_id": "organization"}, "evidence_ref": {"source_snapshot_id": "source_snapshot"},
    "relationship_edge": {"contributor_id": "contributor", "destination_person_id": "person", "consent_record_id": "consent", "source_snapshot_id": "source_snapshot"}, "coverage_result": {"destination_person_id": "person"},
}


def dangling(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(id, reference, missing): the rows of a table that name a row which is not there."""
    parts = []
    for column, other in REFERENCES[name].items():
        there = tables[other].select("workspace_id", F.col(schemas.KEYS[other]).alias("missing")).distinct()
        parts.append(tables[name].select("workspace_id", F.col(schemas.KEYS[name]).alias("id"), F.lit(column).alias("reference"), F.col(column).alias("missing")).join(there, ["workspace_id", "missing"], "left_anti"))
    return reduce(DataFrame.unionByName, parts).select("id", "reference", "missing")
