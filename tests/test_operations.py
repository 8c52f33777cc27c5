"""A workspace from its first consent to an exported report and a withdrawal, and commits that meet."""

import json

import pytest
from pyspark.sql import functions as F

from kinweft import cli, schemas
from kinweft.config import ConfigError
from kinweft.operators import governance, operations
from kinweft.operators.materialize import Request
from kinweft.sources import demo
from kinweft.sources.store import Store

AT = "2026-06-01T00:00:00.000Z"
WS = "workspace_one"
MAPPING = {
    "delimiter": ",", "header": {"mode": "detect_required_headers", "requiredSourceHeaders": ["First Name", "Last Name"], "maxPreambleLines": 100},
    "columns": [{"sourceHeader": h, "targetField": t, "required": r} for h, t, r in (("First Name", "first_name", True), ("Last Name", "last_name", True), ("Email", "email", False), ("URL", "profile_url", False), ("Company", "company_name", False), ("Domain", "company_domain", False), ("Title", "title", False), ("Connected On", "connected_on", False))],
}
HEAD = "First Name,Last Name,Email,URL,Company,Domain,Title,Connected On\n"
BODY = "Notes:\nexported list\n" + HEAD + 'Ann,Lee,ann@firm.example,,Firm,firm.example,"VP, Sales",2026-05-01\nAnn,Lee,ann@firm.example,,Firm,firm.example,"VP, Sales",2026-05-01\nBo,Ray,,https://people.example/in/bo,Other,,CTO,2026-05-02\nBo,Ray,,,Other,,CTO,2026-05-02\n'


def consent(ws=WS, who="contributor_one", name="consent_one", purpose="purpose_one"):
    return {
        "workspaceId": ws, "consentRecordId": name, "contributorId": who, "authorizationBasis": "explicit_consent", "purposeId": purpose, "noticeVersion": "1", "sourceClasses": ["connections_csv"], "allowedCategories": ["A", "B"], "brokerDisclosure": "redacted_in_exports", "sanitizedExportAllowed": True,
        "grantedAt": "2026-01-01T00:00:00.000Z", "expiresAt": "2027-01-01T00:00:00.000Z", "status": "active", "retentionPolicyId": "retention_one",
    }


def snake(row):
    import re

    return {re.sub("[A-Z]", lambda m: "_" + m[0].lower(), k): v for k, v in row.items()}


def seeded(spark, root):
    store = Store(spark, f"file://{root}/store")
    operations.create_workspace(store, WS, "One", "actor", "purpose_one", AT)
    operations.add_contributor(store, WS, {"workspace_id": WS, "contributor_id": "contributor_one", "display_name": "One", "kind": "owner", "status": "active", "created_at": AT}, "actor", AT)
    operations.add_consent(store, WS, snake(consent()), "actor", AT)
    return store


def request(**change):
    return Request(**{"workspace": WS, "contributor": "contributor_one", "consent": "consent_one", "source_kind": "linkedin_connections_export", "mapping": "m", "mapping_version": "1", "imported_at": AT, "raw_sha256": ""} | change)


def test_an_import_is_whole_or_leaves_its_failure_only(spark, tmp_path):
    store, file = seeded(spark, tmp_path), tmp_path / "in" / "a.csv"
    file.parent.mkdir()
    file.write_text(BODY)
    run = lambda **change: operations.import_csv(store, request(**change), MAPPING, str(file), [str(file.parent)])
    before = store.state()["number"]
    file.write_text(BODY + "Cy,Day,c@x.example,,Firm\n")
    with pytest.raises(ConfigError, match="COLUMN_COUNT_MISMATCH"):
        run()
    file.write_text(BODY + "Cy,Day,secret-not-mail,,Firm,,,\n")
    with pytest.raises(ConfigError, match="INVALID_EMAIL"):
        run()
    assert store.state()["number"] == before + 2 and store.table("person").isEmpty() and store.table("source_snapshot").isEmpty() and store.table("audit_event").count() == 2
    failed = store.table("import_transaction").collect()
    assert sorted(r.failure_codes[0] for r in failed) == ["COLUMN_COUNT_MISMATCH", "INVALID_EMAIL"] and {r.status for r in failed} == {"failed"} and "secret" not in str(failed)
    with pytest.raises(ConfigError, match="CONSENT_SOURCE_SCOPE_DENIED"):
        run(source_kind="crm")
    file.write_text(BODY)
    made = run()
    assert made["status"] == "committed" and made["record_count"] == 4
    tables = store.tables()
    count = {k: df.count() for k, df in tables.items()}
    # two equal rows are one group; the row known by its name only is another person, for review
    assert {k: count[k] for k in ("person", "relationship_edge", "evidence_ref", "source_snapshot", "person_resolution_candidate", "organization", "employment_claim")} == {"person": 3, "relationship_edge": 3, "evidence_ref": 16, "source_snapshot": 1, "person_resolution_candidate": 1, "organization": 2, "employment_claim": 3}
    snapshot = tables["source_snapshot"].first()
    assert (snapshot.record_count, snapshot.byte_count, snapshot.raw_retained) == (4, len(BODY), False)
    assert run()["status"] == "idempotent" and store.state()["number"] == before + 3
    with pytest.raises(ConfigError, match="SNAPSHOT_REBINDING_REJECTED"):
        run(mapping_version="2")
    assert all(r["first_index"] is None and r["events"] == 3 for r in governance.first_break(store.table("audit_event")).collect())
    # the postings tell what a scan of all tables tells
    for state in (store.state(), store.state() | {"indexed": False}):
        rests = {k: {r[1] for r in df.collect()} for k, df in store.dependants(WS, "consent_one", state).items()}
        assert {k: len(v) for k, v in rests.items()} == {k: count[k] for k in governance.DEPENDENT}
    # the withdrawal takes all of it away again
    receipt = operations.withdraw_consent(store, WS, "consent_one", "actor", "asked", "2026-07-01T00:00:00.000Z")
    assert receipt["counts"] == {"snapshots": 1, "evidence": 16, "claims": count["identity_claim"] + count["organization_claim"] + count["employment_claim"], "edges": 3, "results": 0, "adapter_records": 0}
    assert all(store.table(k).isEmpty() for k in governance.DEPENDENT) and store.get("consent", WS, "consent_one")["status"] == "withdrawn"
    with pytest.raises(ConfigError, match="CONSENT_WITHDRAWN"):
        run()


def test_commits_that_meet(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/store"), demo.seed(spark)
    person = lambda i: spark.createDataFrame([("w", f"p{i}", f"P {i}", AT)], schemas.schema("person"))
    first, second = store.begin(), store.begin()
    first.put("person", person(1))
    second.put("contributor", rows["contributor"])
    second.audit("w", "x", "a", AT, "s", "i", {})
    first.audit("w", "y", "a", AT, "s", "i", {})
    assert (first.commit(), second.commit()) == (1, 2)  # of other tables: both are there, and one chain
    assert store.table("person").count() == 1 and store.table("contributor").count() == 2
    assert [r.events for r in governance.first_break(store.table("audit_event")).where("first_index is null").collect()] == [2]
    third, fourth, fifth = store.begin(), store.begin(), store.begin()
    third.put("person", person(2))
    fourth.put("person", person(3))
    fifth.table("person")
    fifth.put("organization", rows["organization"])
    third.commit()
    for late in (fourth, fifth):  # what was written, or only read, has changed
        with pytest.raises(ConfigError, match="COMMIT_CONFLICT"):
            late.commit()
    assert {r.person_id for r in store.table("person").collect()} == {"p1", "p2"} and store.table("organization").isEmpty()
    assert not store.put_if_absent(f"{store.root}/_log/{1:012d}.json", "{}")
    # rows are replaced, deleted and put again by key; a look-up sees what a scan sees
    store.commit({"person": person(1).withColumn("display_name", F.lit("new"))})
    gone = store.begin()
    gone.delete("person", person(2))
    gone.commit()
    shown = lambda: {r.person_id: r.display_name for r in store.table("person").collect()}
    assert shown() == {"p1": "new"} and store.get("person", "w", "p1")["display_name"] == "new" and store.get("person", "w", "p2") is None and store.get("person", "v", "p1") is None
    store.commit({"person": person(2)})
    assert shown() == {"p1": "new", "p2": "P 2"}
    store.compact()
    assert shown() == {"p1": "new", "p2": "P 2"} and len(store.state()["tables"]["person"]) == 1 and store.vacuum() > 0
    assert shown() == {"p1": "new", "p2": "P 2"} and store.get("person", "w", "p2")["display_name"] == "P 2"
    with pytest.raises(ConfigError, match="DANGLING_REFERENCE:consent:contributor_id"):
        tx = store.begin()
        tx.put("consent", rows["consent"].withColumn("contributor_id", F.lit("nobody")))
        tx.commit(references=True)
    with pytest.raises(ConfigError, match="IMMUTABLE_ENTITY"):
        store.begin().delete("review_decision", person(1))


def test_postings_equal_a_scan_where_rows_were_replaced(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/store"), demo.seed(spark)
    ws, names = demo.WORKSPACE, ("source_snapshot", "evidence_ref", "relationship_edge", *governance.CLAIMS)
    store.commit({k: rows[k] for k in ("workspace", "contributor", "consent", "source_snapshot")})
    store.commit({k: rows[k] for k in names if k not in ("source_snapshot", "identity_claim")})
    store.commit({"identity_claim": rows["identity_claim"]})  # on evidence of an earlier commit
    other = rows["identity_claim"].select("evidence_refs").first()[0]
    store.commit({"identity_claim": rows["identity_claim"].limit(4).withColumn("evidence_refs", F.array(*map(F.lit, other)))})
    for k in [r[0] for r in rows["consent"].select("consent_record_id").collect()]:
        by_posting = {n: {r[1] for r in df.collect()} for n, df in store.dependants(ws, k).items()}
        by_scan = {n: {r[1] for r in df.collect()} for n, df in store.dependants(ws, k, store.state() | {"indexed": False}).items()}
        assert by_posting == by_scan and by_scan["evidence_ref"]


def test_a_store_of_the_first_layout_opens_under_the_second(spark, tmp_path):
    root = tmp_path / "store"
    old = spark.createDataFrame([("w", "i1", "s1", "failed", "BAD", 3, AT), ("w", "i2", "s2", "committed", None, 4, AT)], schemas.schema("import_transaction", 1))
    old.write.parquet(f"{root}/import_transaction/a")
    (root / "_manifests").mkdir()
    (root / "_manifests" / "000000000001.json").write_text(json.dumps({"import_transaction": [f"file://{root}/import_transaction/a"]}))
    store = Store(spark, f"file://{root}")
    read = lambda: {r.import_transaction_id: (r.status, r.failure_codes, r.row_count, r.contributor_id) for r in store.table("import_transaction").collect()}
    assert store.schema_version() == 1 and read() == {"i1": ("failed", ["BAD"], 3, None), "i2": ("committed", [], 4, None)}
    with pytest.raises(ConfigError, match="MIGRATION_REQUIRED"):
        store.commit({"person": schemas.empty(spark, "person")})
    assert store.migrate() == [[2, "import bindings"]] and store.migrate() == [[2, "import bindings"]] and store.schema_version() == schemas.VERSION
    tx = store.begin()
    tx.put_row("import_transaction", {"workspace_id": "w", "import_transaction_id": "i3", "status": "failed", "failure_codes": ["X"], "contributor_id": "c", "created_at": AT})
    tx.commit()
    assert read() == {"i1": ("failed", ["BAD"], 3, None), "i2": ("committed", [], 4, None), "i3": ("failed", ["X"], None, "c")}


def test_reviews_and_suppressions(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/store"), demo.seed(spark)
    ws = demo.WORKSPACE
    store.commit({k: rows[k] for k in ("workspace", "contributor", "consent")})
    tx = store.begin()
    alias = {"workspace_id": ws, "alias_kind": "name", "evidence_refs": ["e"], "consequences": ["c"], "status": "pending"}
    for name, conflicts in (("one", ["org_a"]), ("two", ["org_a", "org_b"]), ("none", None)):
        tx.put_row("organization_alias_candidate", alias | {"organization_alias_candidate_id": f"alias_{name}", "proposed_organization_id": f"org_{name}", "alias_value": name, "conflict_organization_ids": conflicts})
    tx.put_row("person_resolution_candidate", {"workspace_id": ws, "resolution_candidate_id": "cand", "subject_person_id": "p", "candidate_person_ids": ["p"], "signals": ["ambiguous_name"], "confidence": 0.0, "status": "pending", "automatic_merge_allowed": False})
    tx.commit()
    assert {k: df.count() for k, df in operations.reviews(store, ws).items()} == {"person": 1, "organization": 3}
    do = lambda c, d="approve": operations.decide(store, ws, c, d, "actor", "seen", AT)
    assert do("alias_one")["candidate"]["approved_canonical_organization_id"] == "org_a" and do("alias_two")["candidate"]["approved_canonical_organization_id"] == "org_two" and do("alias_none", "reject")["candidate"]["status"] == "rejected"
    assert {(r.organization_id, r.kind, r.namespace, r.value, r.review_status) for r in store.table("organization_claim").collect()} == {("org_a", "alias", "approved_alias", "one", "approved"), ("org_two", "alias", "approved_alias", "two", "approved")}
    assert do("cand")["decision"]["subject_type"] == "person_resolution"
    for what, code in (("cand", "PERSON_RESOLUTION_DECISION_ALREADY_RECORDED"), ("alias_one", "ALIAS_DECISION_ALREADY_RECORDED"), ("missing", "ALIAS_CANDIDATE_NOT_FOUND")):
        with pytest.raises(ConfigError, match=code):
            do(what)
    rule = operations.add_suppression(store, ws, "domain", "firm.example", "asked", "actor", AT)
    assert store.get("suppression_rule", ws, rule)["value"] == "firm.example"
    assert operations.remove_suppression(store, ws, rule, "actor", "over", AT) == rule and store.table("suppression_rule").isEmpty()
    for run, code in ((lambda: operations.remove_suppression(store, ws, rule, "actor", "over", AT), "SUPPRESSION_NOT_FOUND"), (lambda: operations.add_suppression(store, ws, "mood", "x", "r", "actor", AT), "SUPPRESSION_INVALID"), (lambda: operations.add_suppression(store, ws, "domain", "x", "r", "actor", AT, AT), "SUPPRESSION_CHRONOLOGY")):
        with pytest.raises(ConfigError, match=code):
            run()
    wider = {k: v for k, v in store.get("consent", ws, "consent_contributor_broker").items()}
    with pytest.raises(ConfigError, match="CONSENT_SOURCE_CLASSES_WIDENED"):
        operations.add_consent(store, ws, wider | {"source_classes": [*wider["source_classes"], "more"]}, "actor", AT)
    assert [r.events for r in governance.first_break(store.table("audit_event")).where("first_index is null").collect()] == [6]


def test_commands_lead_from_a_file_to_a_report(spark, tmp_path, capsys):
    data, root = tmp_path / "in", str(tmp_path / "store")
    data.mkdir()
    (data / "a.csv").write_text(BODY)
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name)

    def run(*words, fails=None):
        code = cli.main([*words, "--store", root, "--json"])
        out = capsys.readouterr()
        assert (code, out.err.strip()) == ((1, fails) if fails else (0, "")), out
        return None if fails else json.loads(out.out)

    own = ("--workspace", WS, "--at", AT)
    run("init", *own, "--name", "One", "--owner", "actor", "--purpose", demo.PURPOSE)
    run("init", *own, "--name", "One", "--owner", "actor", "--purpose", demo.PURPOSE, fails="WORKSPACE_EXISTS")
    run("contributor", "add", *own, "--actor", "actor", "--file", write("who.json", {"workspaceId": WS, "contributorId": "contributor_one", "displayName": "One", "kind": "owner", "status": "active", "createdAt": AT}))
    run("contributor", "add", *own, "--actor", "actor", "--file", write("who.json", {"workspaceId": "other", "contributorId": "x"}), fails="CROSS_WORKSPACE_CONTRIBUTOR_DENIED")
    run("consent", "add", *own, "--actor", "actor", "--file", write("consent.json", consent(purpose=demo.PURPOSE)))
    words = ("import", "csv", *own, "--contributor", "contributor_one", "--consent", "consent_one", "--source-kind", "linkedin_connections_export", "--mapping", write("mapping.json", MAPPING), "--import-root", str(data))
    run(*words, "--file", str(tmp_path / "mapping.json"), fails="OUTSIDE_IMPORT_ROOT")
    assert run(*words, "--file", str(data / "a.csv"))["record_count"] == 4
    found = run("review", "list", "--workspace", WS)
    assert len(found["person"]) == 1 and len(found["organization"]) == 2
    run("review", "decide", *own, "--candidate", found["organization"][0]["organization_alias_candidate_id"], "--decision", "approve", "--actor", "actor", "--reason", "known")
    run("suppress", "add", *own, "--kind", "domain", "--value", "other.example", "--reason", "asked", "--actor", "actor")
    config = demo.CONFIG | {"workspaceId": WS, "directContributorIds": ["contributor_one"], "targetAccounts": [], "accountProfiles": []}
    args = ("--config", write("config.json", config), "--at", demo.CLOCK)
    done = run("run", *args, "--policy", write("policy.json", demo.POLICY | {"workspaceId": WS}))
    assert run("run", *args, "--policy", str(tmp_path / "policy.json")) == done | {"stored_before": True}
    for kind in ("json", "csv", "terminal"):
        run("export", *args, "--run", done["audit_run_id"], "--format", kind, "--out", str(tmp_path / "out" / kind))
    run("export", *args, "--run", done["audit_run_id"], "--out", str(tmp_path / "out" / "json"), fails="OUTPUT_EXISTS")
    assert json.loads((tmp_path / "out" / "json").read_text())["workspace_id"] == WS
    assert run("consent", "withdraw", *own, "--consent", "consent_one", "--actor", "actor", "--reason", "asked")["counts"]["snapshots"] == 1
    seen = run("inspect")
    assert seen["source_snapshot"] == 0 and seen["audit_breaks"] == [] and seen["audit_event"] == 9 and seen["runs"] == [done["audit_run_id"]]
