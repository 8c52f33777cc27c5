"""Import to claims, held against a row-by-row evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import ConfigError
from kinweft.functions.digest import canonical_json, scoped_id
from kinweft.functions.scalars import FREE_MAIL_DOMAINS, SHARED_MAILBOXES
from kinweft.operators import employment, materialize

REQUEST = materialize.Request("w", "s1", "k1", "generic_contacts_csv", "m", "1", "2026-01-01T00:00:00.000Z", "ab" * 32)
NS, SNAP = REQUEST.source_kind, REQUEST.snapshot()
DDL = "row_number int, " + ", ".join(f"{f} string" for f in materialize.FIELDS)


def some_rows(seed, n=120):
    r = random.Random(seed)
    pick = lambda p, *v: r.choice(v) if r.random() < p else None
    out = []
    for i in range(1, n + 1):
        row = dict.fromkeys(materialize.FIELDS)
        row |= {"full_name": f"Person {r.randrange(25)}", "provider_person_id": pick(0.3, *"ABCDE", "a"), "crm_contact_id": pick(0.4, *"PQRST"), "profile_url": pick(0.3, *(f"https://x.example/{k}" for k in range(6))), "email": pick(0.5, *(f"u{k}@corp.example" for k in range(8)), "info@corp.example", "z@gmail.com")}
        row |= {"company_name": pick(0.6, "One", "Two"), "company_domain": pick(0.4, "one.example", "two.example", "gmail.com"), "crm_account_id": pick(0.3, *"123"), "provider_organization_id": pick(0.3, *"1234"), "title": pick(0.5, "Head", "Aide"), "source_observed_at": pick(0.8, "2025-11-01", "2024-06-01", "2023-01-01")}
        out.append((i, *row.values()))
    return out


def row_by_row(rows, people, organizations, jobs):
    """(row number, person outcome, person, organization outcome, organization, employment status) of every first row, in order."""
    out, known, firms, held, done = [], list(people), list(organizations), list(jobs), set()
    for r in rows:
        if r["group_digest"] in done:
            continue
        done.add(r["group_digest"])
        mail = r["email"]
        alone = mail and mail.split("@")[0] not in SHARED_MAILBOXES and mail.split("@")[1] not in FREE_MAIL_DOMAINS
        anchor = next(([k, r[f]] for f, k, _ in materialize.PERSON_KEYS if r[f] and (f != "email" or alone)), ["row_group", r["group_digest"]])
        own = scoped_id("w", "person", {"namespace": NS, "anchor": anchor})
        named = anchor[0] == "row_group"
        qualifier = next((q for f, _, q in materialize.PERSON_KEYS if r[f]), "name")
        probe = ("name", qualifier, r["full_name"].lower()) if named else (anchor[0], qualifier, anchor[1].lower())
        hits = list(dict.fromkeys(p for k, p in known if k == probe))
        outcome = "exact" if len(hits) == 1 and not named else "review" if hits or named else "new"
        who = hits[0] if outcome == "exact" else scoped_id("w", "unresolved_person", {"sourceSnapshotId": SNAP, "group": r["group_digest"]}) if hits else own
        known += [((k, q, r[f].lower()), who) for f, k, q in (("full_name", "name", "name"), *materialize.PERSON_KEYS) if r[f]]
        crm = r["crm_account_id"] or r["provider_organization_id"]
        kind = "crm_id" if crm else "domain" if r["company_domain"] else "name" if r["company_name"] else None
        firm = said = status = None
        if kind:
            value = crm or r["company_domain"] or r["company_name"]
            firm = scoped_id("w", "organization", {"namespace": NS, "orgKind": kind, "orgValue": value})
            hits = list(dict.fromkeys(o for k, o in firms if k == (kind, value.lower())))
            safe = kind == "crm_id" or kind == "domain" and value not in FREE_MAIL_DOMAINS
            said = "exact" if len(hits) == 1 and safe else "review" if hits or not safe else "new"
            firm = hits[0] if said == "exact" else firm
            firms += [((k, r[f].lower()), firm) for f, k in (("company_name", "name"), ("company_domain", "domain"), ("crm_account_id", "crm_id"), ("provider_organization_id", "crm_id")) if r[f]]
            day = r["source_observed_at"] or REQUEST.imported_at
            clash = any(p == who and o != firm and abs(int(d[:4]) * 372 + int(d[5:7]) * 31 - int(day[:4]) * 372 - int(day[5:7]) * 31) <= 372 for p, o, d in held)
            held.append((who, firm, day))
            status = "conflicted" if clash else "unreviewed" if day < "2025-01-01" else "approved"
        out.append((r["row_number"], outcome, who, said, firm, status))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_import_row_by_row(spark, seed):
    rows = materialize.canonical_rows(spark.createDataFrame(some_rows(seed), DDL))
    assert rows.where("reject_code is not null").isEmpty()
    rows = materialize.stage_rows(rows, list(materialize.FIELDS), REQUEST).drop("reject_code")
    seeds = [(("provider_id", "provider_person", "a"), "old1"), (("email", "email", "u1@corp.example"), "old2"), (("email", "email", "u1@corp.example"), "old3"), (("name", "name", "person 3"), "old1")]
    firms = [(("crm_id", "3"), "firm1"), (("domain", "two.example"), "firm1")]
    tables = schemas.complete({}, spark)
    claim = lambda name, **c: dict.fromkeys(schemas.schema(name).names) | {"workspace_id": "w", **c}
    tables["identity_claim"] = spark.createDataFrame([claim("identity_claim", identity_claim_id=f"i{i}", person_id=p, kind=k, namespace=f"{NS}:{q}", value=v) for i, ((k, q, v), p) in enumerate(seeds)], schemas.schema("identity_claim"))
    tables["organization_claim"] = spark.createDataFrame([claim("organization_claim", organization_claim_id=f"g{i}", organization_id=o, kind=k, namespace=NS, value=v) for i, ((k, v), o) in enumerate(firms)], schemas.schema("organization_claim"))
    tables["employment_claim"] = spark.createDataFrame([claim("employment_claim", employment_claim_id="m1", person_id="old1", organization_id="elsewhere", state="current", observed_at="2025-11-01T00:00:00.000Z")], schemas.schema("employment_claim"))
    held = [r.asDict() for r in rows.orderBy("row_number").collect()]
    want = row_by_row(held, seeds, firms, [("old1", "elsewhere", "2025-11-01T00:00:00.000Z")])
    found = materialize.resolve_organizations(materialize.resolve_people(materialize.groups(rows), tables["identity_claim"], REQUEST), tables["organization_claim"], REQUEST)
    got = {r.row_number: (r.person_outcome, r.person_id, r.organization_outcome, r.organization_id) for r in found.collect()}
    assert got == {n: (a, b, c, d) for n, a, b, c, d, _ in want} and {x for x, *_ in got.values()} == {"new", "exact", "review"}
    made = materialize.materialize(rows, REQUEST, tables)
    jobs = {(r.person_id, r.organization_id, r.title): r.review_status for r in made["employment_claim"].collect()}
    title = {r["row_number"]: r["title"] for r in held}
    assert jobs == {(b, d, title[n]): e for n, _, b, _, d, e in want if d}
    assert made["evidence_ref"].count() == 4 * len(held)
    edges = made["relationship_edge"].collect()
    assert {r.destination_person_id for r in edges} == {w[2] for w in want} and all(r.evidence_refs for r in edges)
    everything = tables | {k: tables[k].unionByName(v) for k, v in made.items()}
    assert materialize.dangling(everything, "identity_claim").where("not startswith(missing, 'old')").isEmpty()
    assert {r.reference for r in materialize.dangling(everything, "relationship_edge").collect()} == {"contributor_id", "consent_record_id"}
    for name, df in made.items():
        key = schemas.KEYS[name]
        assert df.count() == df.select(key).distinct().count(), name


def test_rejected_rows_and_bindings(spark):
    bad = [{"email": "no address"}, {"company_domain": "???"}, {"profile_url": "ftp://x"}, {"connected_on": "someday"}, {"full_name": None}, {"title": "a\x07b"}, {}]
    rows = [(i, *(dict.fromkeys(materialize.FIELDS) | {"full_name": "A B"} | b).values()) for i, b in enumerate(bad)]
    got = [r.reject_code for r in materialize.canonical_rows(spark.createDataFrame(rows, DDL)).orderBy("row_number").collect()]
    assert got == ["INVALID_EMAIL", "INVALID_COMPANY_DOMAIN", "INVALID_PROFILE_URL", "INVALID_OBSERVED_AT", "PERSON_NAME_REQUIRED", "CONTROL_CHARACTER_REJECTED", None]
    snapshots = spark.createDataFrame([("n1", "raw1", "key1")], "source_snapshot_id string, raw_sha256 string, idempotency_key string")
    requests = spark.createDataFrame([(1, "raw1", "key1"), (2, "raw1", "key2"), (3, "raw3", "key3")], "i int, raw_sha256 string, idempotency_key string")
    assert {r.i: r.status for r in materialize.idempotency(requests, snapshots).collect()} == {1: "idempotent", 2: "rebinding", 3: "committed"}
    consent = {"contributor_id": "s1", "purpose_id": "p", "status": "active", "granted_at": "2025-01-01T00:00:00.000Z", "expires_at": "2027-01-01T00:00:00.000Z", "source_classes": ["connections_csv"]}
    active = {"status": "active"}
    materialize.authorize(REQUEST, {"purpose_id": "p"}, consent, active)
    for change, code in (({"purpose_id": "q"}, "CONSENT_BINDING_INVALID"), ({"withdrawn_at": "x"}, "CONSENT_WITHDRAWN"), ({"status": "inactive"}, "CONSENT_INACTIVE"), ({"granted_at": "2026-06-01T00:00:00.000Z"}, "CONSENT_NOT_YET_ACTIVE"), ({"expires_at": "2026-01-01T00:00:00.000Z"}, "CONSENT_EXPIRED"), ({"source_classes": ["crm"]}, "CONSENT_SOURCE_SCOPE_DENIED")):
        with pytest.raises(ConfigError, match=code):
            materialize.authorize(REQUEST, {"purpose_id": "p"}, consent | change, active)
    with pytest.raises(ConfigError, match="CONTRIBUTOR_INACTIVE"):
        materialize.authorize(REQUEST, {"purpose_id": "p"}, consent, None)
    assert canonical_json(REQUEST.binding()).startswith('{"consentRecordId":"k1"')


def test_employment_conflicts_only_with_earlier_claims(spark):
    claims = spark.createDataFrame([(1, "p", "a", "2025-01-01T00:00:00Z"), (2, "p", "b", "2025-06-01T00:00:00Z"), (3, "p", "b", "2027-01-01T00:00:00Z"), (4, "q", "a", "2025-01-01T00:00:00Z")], "n int, person_id string, organization_id string, observed_at string")
    claims = claims.withColumns({"workspace_id": F.lit("w"), "state": F.lit("current")})
    assert [r.n for r in employment.conflicts(claims, "n").collect()] == [2]
