import json
import os

import pytest
from pyspark.sql import functions as F

from kinweft import cli, schemas
from kinweft.config import ConfigError
from kinweft.operators import evaluate, normalize
from kinweft.operators.runs import Runs
from kinweft.sources import artifacts, demo, paging


def _ddl(columns):
    return ", ".join(f"{c} {'long' if c == 'byte_count' else 'string'}" for c in columns)


def test_a_run_is_done_once_and_read_after_that(spark, tmp_path, monkeypatch):
    runs, tables = Runs(spark, f"file://{tmp_path}/runs"), demo.seed(spark)
    first, before = runs.once(tables, demo.CONFIG, demo.POLICY, demo.CLOCK)
    assert not before and runs.listed() == [first.audit_run_id]
    monkeypatch.setattr(evaluate, "verdicts", None)  # nothing is computed again
    second, before = runs.once(tables, demo.CONFIG, demo.POLICY, demo.CLOCK)
    assert before and second.clock == first.clock
    assert [r["category"] for r in second.results.collect()] == ["A", "B", "C", "D"]
    assert second.blocked.collect() == first.blocked.collect() and second.input_set_sha256 == first.input_set_sha256
    assert runs.results(demo.WORKSPACE).count() == 4 and runs.results("other").count() == 0
    with pytest.raises(ConfigError, match="RUN_NOT_FOUND"):
        runs.read("audit_run_0")
    with pytest.raises(ConfigError, match="RUN_ID_INVALID"):
        runs.read("../elsewhere")


def test_pages_move_the_cursor_and_stop_at_bounds():
    done = paging.Progress(None)
    assert [len(p) for p in paging.pages(paging.listed([{}] * 7), done, 3)] == [3, 3, 1]
    assert (done.status, done.pages, done.records) == ("completed", 3, 7)
    again = paging.Progress("6")
    assert [len(p) for p in paging.pages(paging.listed([{}] * 7), again, 3)] == [1]
    slow = paging.Progress("4")
    assert list(paging.pages(lambda c, n: paging.Page(error="RATE_LIMITED", retry_after=9), slow)) == []
    assert (slow.status, slow.cursor, slow.retry_after) == ("rate_limited", "4", 9)
    for read, code in (
        (lambda c, n: paging.Page([{}], "same"), "CURSOR_REPLAY_LOOP"), (lambda c, n: paging.Page([{}] * (n + 1)), "ADAPTER_PAGE_LIMIT_EXCEEDED"), (lambda c, n: paging.Page(error="REVOKED"), "PROVIDER_REVOKED"),
        (lambda c, n: paging.Page([{}] * n, str(int(c or 0) + 1)), "INVOCATION_BOUND_EXCEEDED"), (paging.listed([{}]), "PROVIDER_INVALID_CURSOR"),
    ):
        with pytest.raises(ConfigError, match=code):
            list(paging.pages(read, paging.Progress("x" if code == "PROVIDER_INVALID_CURSOR" else None), 2))
    failing = paging.Progress(None)
    for _ in paging.pages(paging.listed([{}] * 4), failing, 2):
        break
    assert failing.cursor is None  # the page was not finished


def test_private_files_and_reset_are_guarded(tmp_path):
    root, out = tmp_path / "root", tmp_path / "root" / "a" / "f.json"
    artifacts.write_private(str(out), "x", str(root))
    assert out.read_text() == "x" and out.stat().st_mode & 0o777 == 0o600 and out.parent.stat().st_mode & 0o777 == 0o700
    with pytest.raises(ConfigError, match="OUTPUT_EXISTS"):
        artifacts.write_private(str(out), "y", str(root))
    artifacts.write_private(str(out), "y", str(root), overwrite=True)
    assert out.read_text() == "y" and os.listdir(out.parent) == ["f.json"]
    (root / "link").symlink_to(tmp_path)
    (out.parent / "l").symlink_to(out)
    for path, code in (("f", "OUTPUT_PATH_NOT_ABSOLUTE"), (f"{root}/../f", "OUTPUT_OUTSIDE_ROOT"), (f"{root}/link/b/f", "OUTPUT_OUTSIDE_ROOT"), (f"{out.parent}/l", "OUTPUT_NOT_A_PLAIN_FILE"), (str(out.parent), "OUTPUT_NOT_A_PLAIN_FILE")):
        with pytest.raises(ConfigError, match=code):
            artifacts.write_private(path, "z", str(root), overwrite=True)
    os.link(out, out.parent / "second")
    with pytest.raises(ConfigError, match="OUTPUT_NOT_A_PLAIN_FILE"):
        artifacts.write_private(str(out), "z", str(root), overwrite=True)
    store = root / "store"
    (store / "_manifests").mkdir(parents=True)
    with pytest.raises(ConfigError, match="RESET_OUTSIDE_ROOT"):
        artifacts.reset_store(str(store), str(store))
    with pytest.raises(ConfigError, match="RESET_NOT_A_PLAIN_STORE"):
        artifacts.reset_store(str(out.parent), str(root))
    (store / "l").symlink_to(out)
    with pytest.raises(ConfigError, match="RESET_NOT_A_PLAIN_STORE"):
        artifacts.reset_store(str(store), str(root))
    (store / "l").unlink()
    assert artifacts.reset_store(str(store), str(root)) and not store.exists() and not artifacts.reset_store(str(store), str(root))


def test_commands(tmp_path, capsys):
    config, policy = tmp_path / "c.json", tmp_path / "p.json"
    config.write_text(json.dumps(demo.CONFIG))
    policy.write_text(json.dumps(demo.POLICY))
    assert cli.main(["validate", "--config", str(config), "--policy", str(policy), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["workspace_id"] == demo.WORKSPACE
    policy.write_text(json.dumps(demo.POLICY | {"workspaceId": "other"}))
    assert cli.main(["validate", "--config", str(config), "--policy", str(policy)]) == 1
    config.write_text("secret")
    assert cli.main(["validate", "--config", str(config), "--policy", str(policy)]) == 1
    assert "secret" not in capsys.readouterr().err
    assert cli.main(["reset", "--store", str(tmp_path / "s"), "--allowed-root", str(tmp_path)]) == 1
    assert cli.main(["reset", "--store", str(tmp_path / "s"), "--allowed-root", str(tmp_path), "--yes"]) == 0
    assert cli.main(["export", "--store", str(tmp_path / "s"), "--config", "c", "--run", "r", "--at", demo.CLOCK, "--out", "o", "--view", "reviewer"]) == 1
    assert "REVIEWER_VIEW_NOT_AUTHORIZED" in capsys.readouterr().err


def test_records_become_claims_without_an_edge(spark):
    columns = ["provider_record_id", "kind", "observed_at", "record_digest_sha256", "byte_count", *normalize.FIELDS]
    rows = [("1", "crm", "t1", "d1", 9, " Ａnn ", None, "Ann@X.example", "Firm", "firm.example", "c1", "a1"), ("2", "email", "t2", "d2", 9, "Ann", None, None, None, None, "c1", None), ("1", "crm", "t1", "d1", 9, " Ａnn ", None, "Ann@X.example", "Firm", "firm.example", "c1", "a1")]
    made = normalize.normalize(spark.createDataFrame(rows, _ddl(columns)), normalize.Source("w", "auth", "prov", "ten", "who", "consent", "t0"))
    got = {k: df.collect() for k, df in made.items()}
    assert {k: len(v) for k, v in got.items()} == {"source_snapshot": 2, "adapter_metadata_record": 2, "evidence_ref": 2, "person": 2, "identity_claim": 5, "organization": 1, "organization_claim": 3, "employment_claim": 1}
    assert sorted((r.kind, r.value, r.confidence) for r in got["identity_claim"]) == [("email", "ann@x.example", 1.0), ("name", "Ann", 0.6), ("name", "Ann", 0.6), ("provider_id", "2", 1.0), ("provider_id", "c1", 1.0)]
    assert {(r.kind, r.value) for r in got["organization_claim"]} == {("name", "Firm"), ("domain", "firm.example"), ("crm_id", "a1")}
    assert got["employment_claim"][0].state == "unknown" and got["employment_claim"][0].evidence_refs[0] in {r.evidence_ref_id for r in got["evidence_ref"]}
    empty = normalize.normalize(spark.createDataFrame([], _ddl(columns)), normalize.Source("w", "a", "p", "t", "c", "k", "t0"))
    assert all(df.isEmpty() for df in empty.values())


def test_a_consent_without_withdrawal_is_sound(spark):
    consents = demo.seed(spark)["consent"]
    assert schemas.violations("consent", consents).isEmpty()
    early = consents.withColumn("withdrawn_at", F.lit("2020-01-01T00:00:00.000Z"))
    assert {tuple(r["gate_codes"]) for r in schemas.violations("consent", early).collect()} == {("CONSENT_CHRONOLOGY",)}
