"""Files imported as one commit leave the tables that one import after another leaves, and the work does not grow with their number."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import ConfigError
from kinweft.operators import operations
from kinweft.operators.materialize import Request
from kinweft.plans import scans
from kinweft.sources import demo
from kinweft.sources.csv_scan import Mapping
from kinweft.sources.store import Store

AT = "2026-06-01T00:00:00.000Z"
HEADERS = {
    "Name": "full_name", "Mail": "email", "Url": "profile_url", "Id": "provider_person_id", "Contact": "crm_contact_id", "Title": "title", "Firm": "company_name",
    "Domain": "company_domain", "Account": "crm_account_id", "Org": "provider_organization_id", "On": "connected_on",
}
MAPPING = Mapping.read({"delimiter": ",", "header": {"mode": "detect_required_headers", "maxPreambleLines": 2}, "columns": [{"sourceHeader": h, "targetField": t, "required": False} for h, t in HEADERS.items()], "limits": {}})
#: What differs from run to run already: which of several equal claims of a file is kept.
LOOSE = {"identity_claim": ("evidence_refs", "observed_at"), "organization_claim": ("evidence_refs", "observed_at", "review_status")}


def _row(r: random.Random) -> str:
    some = lambda p, *xs: r.choice(xs) if r.random() < p else ""
    return ",".join([
        f"N{r.randrange(8)}", some(0.5, "a@x.example", "A@x.example", "b@x.example", "c@x.example", "info@x.example"), some(0.3, "https://s.example/a", "https://s.example/b"), some(0.4, "P1", "p1", "P2", "P3"), some(0.3, "C1", "C2"), some(0.3, "t"),
        some(0.3, "f", "g"), some(0.5, "d.example", "e.example", "gmail.com"), some(0.3, "K1", "K2", "k2"), some(0.3, "K1", "O1", "O2"), some(0.6, "2026-01-01", "2025-03-01", "2024-01-01"),
    ])


def _store(spark, path: str, rows) -> Store:
    store = Store(spark, path)
    store.commit({k: rows[k] for k in ("workspace", "contributor")} | {"consent": rows["consent"].selectExpr(*[f"array('connections_csv') AS {c}" if c == "source_classes" else c for c in rows["consent"].columns])})
    return store


def _shown(store: Store) -> dict[str, list[str]]:
    return {k: sorted(map(str, store.table(k).drop(*LOOSE.get(k, ())).collect())) for k in (*schemas.TABLES, *schemas.INDEXES)}


def _base(rows) -> Request:
    consent = rows["consent"].first()
    return Request(demo.WORKSPACE, consent["contributor_id"], consent["consent_record_id"], "generic_contacts_csv", "m", "1", AT, "")


def test_equals_one_after_another(spark, tmp_path, seed=5):
    r, rows = random.Random(seed), demo.seed(spark)
    for i in range(4):
        (tmp_path / f"f{i}.csv").write_text(",".join(HEADERS) + "\n" + "".join(_row(r) + "\n" for _ in range((40, 30, 0, 30)[i])))
    stores = {k: _store(spark, f"file://{tmp_path}/{k}", rows) for k in ("one", "all")}
    made = {k: [] for k in stores}
    requests = [replace(_base(rows), mapping=f"m{i}") for i in range(4)]
    for k, store in stores.items():  # the first file is stored before the others come
        paths = [f"file://{tmp_path}/f{i}.csv" for i in range(4)]
        for path, request in list(zip(paths, requests, strict=True))[: 1 if k == "all" else 4]:
            made[k].append(operations.import_csv(store, request, MAPPING, path, None))
    scan = operations.scan_together(stores["all"], f"file://{tmp_path}/f[0-3].csv", MAPPING, None)
    of = {p[-5]: p for p in (x["path"] for x in scan.about.collect())}
    found = operations.import_files(stores["all"], {of[str(i)]: requests[i] for i in range(4)}, scan)
    made["all"] += [found[of[str(i)]] for i in range(1, 4)]
    assert found[of["0"]] == made["all"][0] | {"status": "idempotent"}
    assert made["one"] == made["all"]
    one, together = _shown(stores["one"]), _shown(stores["all"])
    assert {k for k in one if one[k] != together[k]} == set()
    assert len(together["person_resolution_candidate"]) > 5 and len(together["organization_alias_candidate"]) > 5 and "conflicted" in str(together["employment_claim"]) and len(together["import_transaction"]) == 4
    assert stores["all"].state()["number"] == 3 and stores["one"].state()["number"] == 5


def test_a_refused_file_refuses_all(spark, tmp_path):
    rows = demo.seed(spark)
    store = _store(spark, f"file://{tmp_path}/store", rows)
    (tmp_path / "f0.csv").write_text("Name,Mail,Id\nN,,P\n")
    (tmp_path / "f1.csv").write_text("Name,Mail,Id\nN,nobody,\n")
    (tmp_path / "f2.csv").write_text("Name,Mail,Id\nN,,P\n")
    mapping = Mapping.read({"delimiter": ",", "header": {"mode": "detect_required_headers", "maxPreambleLines": 2}, "columns": [{"sourceHeader": h, "targetField": HEADERS[h], "required": False} for h in ("Name", "Mail", "Id")], "limits": {}})
    for names, code in (("01", "INVALID_EMAIL"), ("02", "SNAPSHOT_REBINDING_REJECTED")):
        scan = operations.scan_together(store, f"file://{tmp_path}/f[{names}].csv", mapping, None)
        paths = sorted(x["path"] for x in scan.about.collect())
        with pytest.raises(ConfigError, match=code):
            operations.import_files(store, {p: replace(_base(rows), mapping=f"m{i}") for i, p in enumerate(paths)}, scan)
    assert store.table("source_snapshot").isEmpty() and store.table("person").isEmpty()
    assert sorted(x["failure_codes"] for x in store.table("import_transaction").collect()) == [["INVALID_EMAIL"], ["SNAPSHOT_REBINDING_REJECTED"]]
    scan = operations.scan_together(store, f"file://{tmp_path}/f[02].csv", mapping, None)
    paths = sorted(x["path"] for x in scan.about.collect())
    made = operations.import_files(store, dict.fromkeys(paths, _base(rows)), scan)  # the same content twice, for the same mapping
    assert [made[p]["status"] for p in paths] == ["committed", "idempotent"] and store.table("source_snapshot").count() == 1


def test_customers_far_apart(spark, tmp_path, monkeypatch):
    """Only files that have rows are imported, and all in one commit."""
    customers = spark.createDataFrame([(k, f"c{k}", k % 3) for k in (0, 1, 2, 70_000, 9_000_000_000)], "c_custkey long, c_name string, c_nationkey int")
    named = {"workspace": {"workspace_id": scans.workload.WORKSPACE}, "contributor": {"contributor_id": "s1"}, "consent": {"contributor_id": "s1", "consent_record_id": "k1", "granted_at": "2000-01-01T00:00:00.000Z", "expires_at": "2999-01-01T00:00:00.000Z"}}
    held = {k: df.limit(1).withColumns({c: F.lit(v) for c, v in (named["workspace"] | named[k]).items()}) for k, df in demo.seed(spark).items() if k in named}
    monkeypatch.setattr(scans.workload, "star", lambda s, d, t: customers)
    monkeypatch.setattr(scans.workload, "tables", lambda s, d: held)
    commits = []
    monkeypatch.setattr(scans, "Store", lambda *a: commits.append(Store(*a)) or commits[-1])
    made = dict(scans.import_commit(spark, "").collect())
    assert (made["source_snapshot"], made["import_transaction"], made["audit_event"], made["person"], made["organization_claim"]) == (3, 3, 3, 5, 5)
    assert commits[0].state()["number"] == 2
