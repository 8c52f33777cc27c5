import pytest

from kinweft.config import ConfigError
from kinweft.operators import display, evaluate, governance
from kinweft.plans import catalog, workload
from kinweft.sources import demo

RUN = "audit_run_5357dc8b84bf9d34cb9df2f1e3b945a8"
RESULTS = {
    "A": "coverage_result_8bf2a02e61982aae41570fb7c1dd93d2", "B": "coverage_result_911d7dd04059f565e2bbfe1ac9529dc7", "C": "coverage_result_e16e30030b8322317547e3db25046597", "D": "coverage_result_6c9eef43583e87da9a80f137cfa25e7b",
}


@pytest.fixture(scope="module")
def run(spark):
    tables = demo.seed(spark)
    return evaluate.evaluate(tables, demo.CONFIG, demo.POLICY, demo.CLOCK), tables


def test_demo_findings_are_the_published_ones(run):
    found, _ = run
    rows = found.results.collect()
    assert found.audit_run_id == RUN
    assert {r["category"]: r["result_id"] for r in rows} == RESULTS
    assert [r["category"] for r in rows] == ["A", "B", "C", "D"]
    assert [r["scores"]["review_priority"] for r in rows] == [100, 80, 100, 80]


def test_near_misses_are_blocked_with_all_their_reasons(run):
    rows = {r["destination_person_id"]: r for r in run[0].blocked.collect()}
    assert rows["person_stale"]["reason_codes"] == ["EMPLOYMENT_STALE", "RELATIONSHIP_STALE"]
    assert rows["person_conflicted"]["reason_codes"] == ["IDENTITY_UNRESOLVED_OR_CONFLICTED"]
    assert run[0].review_only.count() == 0


def test_report_redacts_brokers_and_hides_what_is_suppressed_since(run):
    found, tables = run
    safe = display.report(found, tables, demo.CONFIG, demo.CLOCK)
    assert safe["summary"]["categories"] == {"A": 1, "B": 1, "C": 1, "D": 1}
    assert all(f["broker"] == {"redacted": True, "disclosure": display.WITHHELD} for f in safe["findings"] if f["category"] in "CD")
    reviewer = display.report(found, tables, demo.CONFIG, demo.CLOCK, "reviewer")
    assert [f["broker"]["contributor_id"] for f in reviewer["findings"] if "broker" in f] == ["contributor_broker"] * 2
    hidden = demo.CONFIG | {"suppressions": [{"suppressionId": "s1", "kind": "person", "value": "PERSON_alex", "reasonCode": "PERSON_SUPPRESSED", "effectiveAt": demo.CLOCK}]}
    assert display.report(found, tables, hidden, demo.CLOCK)["summary"]["display_invalidated_total"] == 1
    assert "Eligible: 4  A:1 B:1 C:1 D:1" in display.to_terminal(safe)


def test_withdrawal_takes_what_rests_on_the_consent(run):
    found, tables = run
    after, receipt = governance.withdraw(tables | {"coverage_result": found.results}, demo.WORKSPACE, "consent_contributor_broker", "asked", demo.CLOCK, "actor")
    assert receipt["counts"] == {"snapshots": 4, "evidence": 16, "claims": 12, "edges": 4, "results": 2, "adapter_records": 0}
    assert {r["category"] for r in after["coverage_result"].collect()} == {"A", "B"}


def test_wrong_purpose_and_unknown_contributor_stop_a_run(spark):
    tables = demo.seed(spark)
    with pytest.raises(ConfigError, match="PURPOSE"):
        evaluate.evaluate(tables, demo.CONFIG, demo.POLICY | {"purposeId": "other"}, demo.CLOCK)
    with pytest.raises(ConfigError, match="DIRECT_CONTRIBUTOR_NOT_FOUND"):
        evaluate.evaluate(tables, demo.CONFIG | {"directContributorIds": ["nobody"]}, demo.POLICY, demo.CLOCK)


def test_audit_chain_breaks_where_it_was_changed(spark):
    events = governance.chain([("kind", "actor", demo.CLOCK, "thing", str(i), {"i": i}) for i in range(4)], "w")
    assert governance.first_break(governance.audit_frame(spark, events)).first()["first_index"] is None
    changed = [e | ({"actor_id": "x"} if e["sequence"] == 3 else {}) for e in events]
    broken = governance.first_break(governance.audit_frame(spark, changed)).first()
    assert (broken["first_index"], broken["reason"]) == (2, "event hash mismatch")
    assert governance.first_break(governance.audit_frame(spark, events[1:])).first()["reason"] == "sequence gap"


def test_chains_of_several_workspaces_and_mistakes(spark):
    rows = [(f"w{i % 3}", i, "kind", "actor", demo.CLOCK, "thing", str(i), "{}") for i in range(31)]
    made = governance.chained_frame(spark.createDataFrame(rows, "workspace_id string, place int, event_type string, actor_id string, occurred_at string, subject_type string, subject_id string, payload string"))
    events = [r.asDict() for r in made.collect()]
    for w in range(3):
        want = governance.chain([("kind", "actor", demo.CLOCK, "thing", str(i), {}) for i in range(w, 31, 3)], f"w{w}")
        assert sorted((e for e in events if e["workspace_id"] == f"w{w}"), key=lambda e: e["sequence"]) == want
    changes = {"w0": ("sequence gap", lambda e: [x for x in e if x["sequence"] != 4], 3), "w1": ("previous hash mismatch", lambda e: [x | ({"previous_hash": "0"} if x["sequence"] == 7 else {}) for x in e], 6), "w2": ("event hash mismatch", lambda e: [x | ({"actor_id": "y"} if x["sequence"] in (1, 5) else {}) for x in e], 0)}
    rows = [x for w, (_, change, _) in changes.items() for x in change([e for e in events if e["workspace_id"] == w])]
    for block in (10_000, 2):
        governance.BLOCK, kept = block, governance.BLOCK
        try:
            got = {r["workspace_id"]: (r["reason"], r["first_index"], r["events"]) for r in governance.first_break(governance.audit_frame(spark, rows)).collect()}
        finally:
            governance.BLOCK = kept
        assert got == {"w0": ("sequence gap", 3, 10), "w1": ("previous hash mismatch", 6, 10), "w2": ("event hash mismatch", 0, 10)}


def test_audit_chain_verify_has_all_consents(spark):
    found = catalog.queries()["audit_chain_verify"](spark, "/root/testdata/sf0.01").collect()
    assert [(r["events"], r["first_index"], r["reason"]) for r in found] == [(workload.tables(spark, "/root/testdata/sf0.01")["consent"].count(), 19, "event hash mismatch")]
    assert found[0]["events"] == 100
    events = governance.chain([("kind", "actor", demo.CLOCK, "thing", str(i), {"i": i}) for i in range(7)], "w")
    staged = governance.staged_audit_frame(spark, iter(events), block=3)
    assert staged.count() == 7 and governance.first_break(staged).first()["first_index"] is None
