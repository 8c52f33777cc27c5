"""Providers as data sources, their records as keyed state, and a reading that ends as a commit."""

import json

import pytest

from kinweft.config import ConfigError
from kinweft.operators import operations
from kinweft.sources import demo, provider_source
from kinweft.sources.store import Store
from kinweft.streaming import adapter_stream

SINCE, UNTIL = "2026-01-01T00:00:00Z", "2026-12-31T00:00:00Z"


def record(i, **more):
    return {"provider_record_id": f"p{i}", "kind": "crm", "observed_at": "2026-03-01T00:00:00.000Z", "person_name": f"Person {i}"} | more


def put(path, name, records, cursor=None, error=None):
    (path / f"{name}.json").write_text(json.dumps({"records": records, "next_cursor": cursor, "error": error}))


def test_pages_are_batches_and_cursors_are_offsets(spark, tmp_path):
    pages, out, cp = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "cp")
    pages.mkdir()
    put(pages, "first", [record(1), record(2)], "b")
    put(pages, "b", [], error="RATE_LIMITED")
    spark.dataSource.register(provider_source.provider_source("crm_pages", provider_source.folder(str(pages)), "auth"))

    def run():
        query = adapter_stream.ingest_provider(spark, "crm_pages", out, cp, ["person_name"], SINCE, UNTIL)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.provider_record_id, r.verdict) for r in spark.read.parquet(out).collect())

    # the provider asks for a pause: what came is kept, and the same cursor is asked again after a restart
    first = [("p1", "accepted"), ("p2", "accepted")]
    assert run() == first
    with pytest.raises(Exception, match="PROVIDER_RATE_LIMITED"):
        spark.read.format("crm_pages").load().collect()
    put(pages, "b", [record(2), record(1, person_name="Other"), record(3, secret="x"), record(4)], "c")
    put(pages, "c", [record(4), record(3)])
    whole = sorted([*first, ("p2", "duplicate"), ("p1", "PROVIDER_RECORD_REBINDING_REJECTED"), ("p3", "FIELD_NOT_AUTHORIZED"), ("p4", "accepted"), ("p4", "duplicate"), ("p3", "accepted")])
    assert run() == whole and run() == whole
    assert spark.read.format("crm_pages").load().count() == 8


def test_a_cursor_that_comes_again_fails():
    pages = {None: ("a", 1), "a": ("b", 1), "b": ("a", 1)}
    reader = provider_source._Stream(lambda c, n: provider_source.Page([record(1)], pages[c][0]), 10, None, "auth")
    at = reader.initialOffset()
    for _ in range(2):
        _, at = reader.read(at)
    with pytest.raises(ConfigError, match="CURSOR_REPLAY_LOOP"):
        reader.read(at)
    many = provider_source._Stream(lambda c, n: provider_source.Page([], str(int(c or 0) + 1)), 10, None, "auth")
    at = many.initialOffset()
    with pytest.raises(ConfigError, match="INVOCATION_BOUND_EXCEEDED"):
        for _ in range(101):
            _, at = many.read(at)
    again = many.readBetweenOffsets(many.initialOffset(), at)
    assert list(again) == [] and at["pages"] == 100
    wide = provider_source._Stream(lambda c, n: provider_source.Page([record(1)] * 11), 10, None, "auth")
    with pytest.raises(ConfigError, match="ADAPTER_PAGE_LIMIT_EXCEEDED"):
        wide.read(wide.initialOffset())


def test_a_reading_ends_as_one_commit(spark, tmp_path):
    store, rows, ws = Store(spark, f"file://{tmp_path}/store"), demo.seed(spark), demo.WORKSPACE
    store.commit({k: rows[k] for k in ("workspace", "contributor", "consent")})
    pages = tmp_path / "pages"
    pages.mkdir()
    put(pages, "first", [record(1, person_email="ann@firm.example", organization_name="Firm"), record(2)], "b")
    put(pages, "b", [], error="TEMPORARY")
    auth = {"adapter_authorization_id": "auth", "adapter_id": "a", "provider": "crm", "provider_tenant_id": "t", "workspace_id": ws, "purpose_id": demo.PURPOSE, "status": "active", "authorized_at": "2026-01-01T00:00:00.000Z", "expires_at": "2027-01-01T00:00:00.000Z", "capabilities": ["list"]}
    consent = rows["consent"].where("contributor_id = 'contributor_owner'").first()

    def run(cursor=None, **change):
        return operations.ingest_adapter(store, auth | change, provider_source.folder(str(pages)), ws, "contributor_owner", consent["consent_record_id"], demo.CLOCK, SINCE, UNTIL, ["person_name", "person_email", "organization_name"], cursor=cursor)

    assert run() == {"status": "temporary_error", "next_cursor": "b", "retry_after": None, "accepted": 2, "duplicates": 0}
    assert store.table("adapter_metadata_record").count() == 2 and store.table("relationship_edge").isEmpty() and store.table("organization").count() == 1
    put(pages, "b", [record(2), record(3)])
    assert run("b") == {"status": "completed", "next_cursor": None, "retry_after": None, "accepted": 1, "duplicates": 1}
    number = store.state()["number"]
    put(pages, "b", [record(4), record(3, person_name="Other")])
    for cursor, change, code in (("b", {}, "PROVIDER_RECORD_REBINDING_REJECTED"), (None, {"status": "paused"}, "ADAPTER_AUTHORIZATION_REVOKED"), (None, {"capabilities": []}, "ADAPTER_CAPABILITY_DENIED"), ("none", {}, "PROVIDER_INVALID_CURSOR")):
        with pytest.raises(ConfigError, match=code):
            run(cursor, **change)
    assert store.state()["number"] == number and store.table("audit_event").count() == 2
