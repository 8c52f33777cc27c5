"""Files that are scanned together become the same commits as files scanned one by one."""

from dataclasses import replace

from kinweft.operators import operations
from kinweft.operators.materialize import Request
from kinweft.sources import demo
from kinweft.sources.csv_scan import Mapping
from kinweft.sources.store import Store

AT = "2026-06-01T00:00:00.000Z"


def test_files_scanned_together(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"f{i}.csv").write_text("Name,Id\n" + "".join(f"N{k},P{k}\n" for k in range(2 * i, 2 * i + 3)))
    mapping = Mapping.read({"delimiter": ",", "header": {"mode": "detect_required_headers", "maxPreambleLines": 2}, "columns": [{"sourceHeader": h, "targetField": t, "required": False} for h, t in (("Name", "full_name"), ("Id", "provider_person_id"))], "limits": {}})
    rows, counts = demo.seed(spark), []
    consent = rows["consent"].first()
    base = Request(demo.WORKSPACE, consent["contributor_id"], consent["consent_record_id"], "generic_contacts_csv", "m", "1", AT, "")
    made = []
    for together in (True, False):
        store = Store(spark, f"file://{tmp_path}/store{together}")
        store.commit({k: rows[k] for k in ("workspace", "contributor")} | {"consent": rows["consent"].selectExpr(*[f"array('connections_csv') AS {c}" if c == "source_classes" else c for c in rows["consent"].columns])})
        held = operations.scan_files(store, f"file://{tmp_path}/*.csv", mapping, None) if together else {}
        for i in range(2):
            path = next((p for p in held if p.endswith(f"f{i}.csv")), f"file://{tmp_path}/f{i}.csv")
            made.append(operations.import_csv(store, replace(base, mapping=f"m{i}"), mapping, path, None, scan=held.get(path)))
        counts.append({k: sorted(map(str, df.collect())) for k, df in store.tables().items()})
    assert counts[0] == counts[1] and made[:2] == made[2:] and len(counts[0]["person"]) == 5 and len(counts[0]["import_transaction"]) == 2
