import json

import pytest

from kinweft.config import ConfigError
from kinweft.operators import claims, employment, resolution
from kinweft.operators.adapters import deduplicate
from kinweft.sources import csv_scan, demo
from kinweft.sources.csv_scan import Mapping, ScanError, parse
from kinweft.sources.store import Store
from kinweft.streaming import adapter_stream

MAPPING = {"columns": [{"sourceHeader": "First", "targetField": "first_name", "required": True}, {"source_header": "Last", "target_field": "last_name", "required": True}], "headerMode": "detect_required_headers", "maxPreambleLines": 3}


def test_preamble_is_skipped_and_quotes_are_undone():
    header, skipped, rows = parse(b'\xef\xbb\xbfnote\n"x,y"\nFIRST ,Last\r\n"A ""q"" B",C\r\nD,"E\nF"\n', Mapping.read(MAPPING))
    assert (header, skipped, rows) == (["first", "last"], 2, [['A "q" B', "C"], ["D", "E\nF"]])


@pytest.mark.parametrize(
    "raw,code",
    [
        (b'First,Last\nA"b,c\n', "MALFORMED_QUOTING"), (b'First,Last\n"a"b,c\n', "MALFORMED_QUOTING"), (b'First,Last\n"a,c\n', "MALFORMED_QUOTING"), (b"First,Last\n\x00,c\n", "NUL_BYTE_REJECTED"), (b"First,Last,first\na,b,c\n", "HEADER_COLLISION"),
        (b"\xff\xfeF", "UNSUPPORTED_BOM"), (b"First,Last\n\xff,b\n", "INVALID_UTF8"), (b"First,Last\na,b,c\n", "COLUMN_COUNT_MISMATCH"), (b"First,Last\n\na,b\n", "COLUMN_COUNT_MISMATCH"), (b"a\nb\nc\nd\n", "HEADER_NOT_FOUND"), (b"", "HEADER_NOT_FOUND"),
    ],
)
def test_bad_files_are_refused(raw, code):
    with pytest.raises(ScanError, match=code):
        parse(raw, Mapping.read(MAPPING))


@pytest.mark.parametrize("limits,code", [({"field_bytes": 3}, "FIELD_TOO_LARGE"), ({"row_bytes": 5}, "ROW_TOO_LARGE"), ({"columns": 1}, "TOO_MANY_COLUMNS"), ({"file_bytes": 10}, "FILE_TOO_LARGE"), ({"rows": 1}, "TOO_MANY_ROWS")])
def test_limits_can_be_lowered(limits, code):
    with pytest.raises(ScanError, match=code):
        parse(b"First,Last\na,b\nc,d\n", Mapping.read(MAPPING | {"limits": limits}))


def test_scan_gives_rows_or_one_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("First,Last\na,b\nc,d\n")
    (tmp_path / "b.csv").write_text("First,Last\na\n")
    rows = csv_scan.scan(spark, str(tmp_path), Mapping.read(MAPPING))
    good = rows.where("error is null").orderBy("row_number").collect()
    assert [r.fields for r in good] == [{"first_name": "a", "last_name": "b"}, {"first_name": "c", "last_name": "d"}]
    assert [r.error for r in csv_scan.failures(rows).collect()] == ["COLUMN_COUNT_MISMATCH"]
    assert csv_scan.guard(str(tmp_path / "a.csv"), [str(tmp_path)])
    for bad, code in (("http://x/a", "URL"), ("a.csv", "ABSOLUTE"), ("/etc/passwd", "OUTSIDE"), (str(tmp_path), "REGULAR")):
        with pytest.raises(ConfigError, match=code):
            csv_scan.guard(bad, [str(tmp_path)])


def test_mapping_errors():
    for change, code in (({"columns": []}, "INVALID_MAPPING"), ({"columns": MAPPING["columns"][:1]}, "PERSON_NAME"), ({"delimiter": "x"}, "INVALID_MAPPING"), ({"limits": {"rows": 10**9}}, "INVALID_MAPPING")):
        with pytest.raises(ConfigError, match=code):
            Mapping.read(MAPPING | change)


def test_store_commits_whole_and_keeps_immutable_rows(spark, tmp_path):
    store, tables = Store(spark, f"file://{tmp_path}/store"), demo.seed(spark)
    store.commit({k: tables[k] for k in ("contributor", "evidence_ref")})
    assert store.table("evidence_ref").count() == 24
    store.commit({"contributor": tables["contributor"].limit(1).withColumn("status", tables["contributor"].status)})
    assert store.table("contributor").count() == 2
    store.commit({"evidence_ref": tables["evidence_ref"]})
    from pyspark.sql import functions as F

    with pytest.raises(ConfigError, match="IMMUTABLE"):
        store.commit({"evidence_ref": tables["evidence_ref"].withColumn("transform_version", F.lit("x"))})
    assert store.table("person").count() == 0


def test_resolution(spark):
    key = "workspace_id string, namespace string, kind string, normalized string"
    known = spark.createDataFrame([("w", "n", "email", "a@x.io", "p1"), ("w", "n", "email", "b@x.io", "p1"), ("w", "n", "email", "b@x.io", "p2"), ("v", "n", "email", "c@x.io", "p3")], key + ", person_id string")
    rows = spark.createDataFrame([("w", "n", "email", "a@x.io", False), ("w", "n", "email", "b@x.io", False), ("w", "n", "email", "c@x.io", False), ("w", "n", "email", "a@x.io", True), ("w", "n", "name", "q", False)], key + ", risky boolean")
    got = sorted((r.normalized, r.outcome, r.signals[:1]) for r in resolution.probe(rows, known).collect())
    assert got == [("a@x.io", "exact", ["exact_email"]), ("a@x.io", "review", ["ambiguous_email"]), ("b@x.io", "review", ["identifier_collision"]), ("c@x.io", "new", []), ("q", "review", ["ambiguous_name"])]
    many = spark.createDataFrame([("w", "n", "email", v, i, f"p{i}", s) for i, (v, s) in enumerate([("a", True), ("b", True), ("a", True), ("c", False), ("a", True), ("c", False)])], key + ", row_number int, own_id string, safe boolean")
    assert [(r.outcome, r.subject_id) for r in resolution.fold(many).orderBy("row_number").collect()] == [("new", "p0"), ("new", "p1"), ("exact", "p0"), ("review", "p3"), ("exact", "p0"), ("review", "p5")]


def test_groups_fan_out_and_employment(spark):
    rows = spark.createDataFrame([("g", 3), ("g", 1), ("h", 2)], "g string, n int")
    assert sorted((r.g, r.n) for r in claims.first_of_group(rows, "g", "n").collect()) == [("g", 1), ("h", 2)]
    assert sorted(map(tuple, deduplicate(rows, ["g"], "n").collect())) == [("g", 1, 1), ("h", 2, 0)]
    at = demo.CLOCK[:4]
    people = spark.createDataFrame([("w", "p", "m1", "o1", "current", f"{at}-01-01T00:00:00Z"), ("w", "p", "m2", "o2", "current", f"{at}-06-01T00:00:00Z"), ("w", "q", "m3", "o1", "unknown", f"{at}-06-01T00:00:00Z"), ("w", "r", "m4", "o1", "current", "2025-01-01T00:00:00Z"), ("w", "s", "m5", "o1", "ended", f"{at}-01-01T00:00:00Z")], "workspace_id string, person_id string, employment_claim_id string, organization_id string, state string, observed_at string")
    from kinweft.config import instant

    got = {r.employment_claim_id: r.disposition for r in employment.disposition(people, instant(demo.CLOCK)).collect()}
    assert got == {"m1": "blocked_conflict", "m2": "blocked_conflict", "m3": "stale", "m4": "review_only", "m5": "blocked_ended"}


def test_adapter_stream_takes_each_record_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    record = {"adapter_authorization_id": "a", "provider_record_id": "1", "observed_at": "2026-01-02T00:00:00Z", "record_digest_sha256": "x", "fields": '{"title":"t"}'}

    def send(name, *records):
        (source / name).write_text("\n".join(json.dumps(record | r) for r in records))
        adapter_stream.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), ["title"], "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z").awaitTermination(120)
        return sorted(r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert send("1.json", {}, {"provider_record_id": "2", "fields": '{"body":"b"}'}, {"provider_record_id": "3", "observed_at": "2027-01-01T00:00:00Z"}) == ["FIELD_NOT_AUTHORIZED", "RECORD_OUTSIDE_TIME_WINDOW", "accepted"]
    assert send("2.json", {}, {"provider_record_id": "4"}).count("duplicate") == 1
    assert send("3.json", {"record_digest_sha256": "y"}).count("PROVIDER_RECORD_REBINDING_REJECTED") == 1
