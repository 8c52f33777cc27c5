"""The split scan against one that goes through a file character by character."""

import random

import pytest

from kinweft.config import ConfigError
from kinweft.sources import csv_scan
from kinweft.sources.csv_scan import Mapping, ScanError, parse

COLUMNS = [{"sourceHeader": "First", "targetField": "first_name", "required": True}, {"sourceHeader": "Last", "targetField": "last_name", "required": False}]
MAPPING = {"delimiter": ",", "header": {"mode": "detect_required_headers", "requiredSourceHeaders": ["First", "Last"], "maxPreambleLines": 2}, "columns": COLUMNS}


def by_character(raw, mapping):
    """(preamble lines, rows) or a code, by one state machine over the whole file."""
    if len(raw) > mapping.limits["file_bytes"]:
        return "FILE_TOO_LARGE"
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UNSUPPORTED_BOM"
    if b"\0" in raw:
        return "NUL_BYTE_REJECTED"
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "INVALID_UTF8"
    header, skipped, rows, row, value, size, wide = None, 0, [], [], "", 0, 0
    quoted = closed = False

    def end_field():
        nonlocal value, wide, closed
        if len(row) >= mapping.limits["columns"]:
            raise ScanError("TOO_MANY_COLUMNS")
        row.append(value)
        value, wide, closed = "", 0, False

    def end_record():
        nonlocal header, skipped, row, size
        end_field()
        if header is None:
            keys = [csv_scan.header_key(x) for x in row]
            is_header = mapping.header == "first_record" or all(k in keys for k in mapping.required)
            if len(set(keys)) != len(keys) and (is_header or any(k in mapping.required for k in keys)):
                raise ScanError("HEADER_COLLISION")
            if not is_header:
                skipped += 1
                if skipped > mapping.max_preamble:
                    raise ScanError("HEADER_NOT_FOUND")
            else:
                if not all(keys):
                    raise ScanError("HEADER_COLLISION")
                if any(k not in keys for k in mapping.required):
                    raise ScanError("REQUIRED_HEADER_MISSING")
                header = keys
        else:
            if len(row) != len(header):
                raise ScanError("COLUMN_COUNT_MISMATCH")
            if len(rows) >= mapping.limits["rows"]:
                raise ScanError("TOO_MANY_ROWS")
            rows.append(row)
        row, size = [], 0

    try:
        for c in text:
            width = len(c.encode())
            size += width
            if size > mapping.limits["row_bytes"]:
                return "ROW_TOO_LARGE"
            if quoted:
                if c == '"':
                    quoted, closed = False, True
                else:
                    value, wide = value + c, wide + width
            elif closed and c == '"':
                quoted, closed, value, wide = True, False, value + c, wide + 1
            elif closed and c not in (mapping.delimiter, "\r", "\n"):
                return "MALFORMED_QUOTING"
            elif c == '"':
                if value:
                    return "MALFORMED_QUOTING"
                quoted = True
            elif c == mapping.delimiter:
                end_field()
            elif c == "\n":
                end_record()
            elif c != "\r":
                value, wide = value + c, wide + width
            if wide > mapping.limits["field_bytes"]:
                return "FIELD_TOO_LARGE"
        if quoted:
            return "MALFORMED_QUOTING"
        if row or value or closed:
            end_record()
    except ScanError as e:
        return str(e)
    return (skipped, rows) if header else "HEADER_NOT_FOUND"


def files(seed, n, records=12):
    """Files that are often right, with quotes, breaks and mistakes in odd places."""
    r = random.Random(seed)
    parts = ["a", "é", "日本", ",", ",", "\n", "\n", "\r\n", "\r", '"', '""', '"x"', '"x,y"', '"l\nm"', '"q""r"', "\x85", " "]
    good = ["a,b\n", '"a","b"\n', '"a\n\n,""b",c\r\n', "é,\r\n", ',""\n', '"x"\r,y\n']
    out = []
    for _ in range(n):
        body = "".join(r.choice(good) for _ in range(r.randint(0, records)))
        if r.random() < 0.5:
            at = r.randint(0, len(body))
            body = body[:at] + "".join(r.choices(parts, k=r.randint(1, 4))) + body[at:]
        raw = (r.choice(["", "", "note\n", '"n\no"\nx,y\n', "a\nb\nc\n", "\n"]) + r.choice(["First,Last\n", '"First","Last"\r\n', " first ,LAST\n", "First,Last", "First\n"]) + body).encode()
        if r.random() < 0.1:
            raw = r.choice([b"\xff\xfe" + raw, raw + b"\0", raw + b"\xc3", b"\xef\xbb\xbf" + raw, b"", b"\xef\xbb\xbf"])
        out.append(raw.rstrip(b"\n") if r.random() < 0.3 else raw)
    return out


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"maxRowBytes": 14, "maxFieldBytes": 9}), (3, {"maxColumns": 2, "maxDataRows": 6}), (4, {"maxFileBytes": 60})])
def test_records_equal_a_scan_by_character(seed, limits):
    mapping = Mapping.read(MAPPING | {"limits": limits})
    for raw in files(seed, 3000):
        want = by_character(raw, mapping)
        try:
            got = parse(raw, mapping)[1:]
        except ScanError as e:
            got = str(e)
        assert got == want, raw


@pytest.mark.parametrize(("seed", "limits"), [(11, {}), (12, {"maxRowBytes": 14, "maxFieldBytes": 9, "maxColumns": 2, "maxDataRows": 500})])
def test_split_scan_equals_a_scan_by_character(spark, tmp_path, seed, limits):
    mapping, all_files = Mapping.read(MAPPING | {"limits": limits}), [*files(seed, 8, 1500), *files(seed + 5, 25)]
    for i, raw in enumerate(all_files):
        (tmp_path / f"{i}.csv").write_bytes(raw)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        rows = csv_scan.scan(spark, str(tmp_path), mapping).orderBy("row_number").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        name = int(r.path.rpartition("/")[2].removesuffix(".csv"))
        if r.error is not None:
            got[name] = r.error
        else:
            skipped, made = got.setdefault(name, (r.preamble_lines, []))
            if r.row_number is not None:
                made.append([r.fields["first_name"], r.fields["last_name"]])
    for i, raw in enumerate(all_files):
        want = by_character(raw, mapping)
        if not isinstance(want, str):
            order = [k for k in parse(raw, mapping)[0]]
            want = (want[0], [[row[order.index("first")], row[order.index("last")]] for row in want[1]])
        assert got[i] == want, raw


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    n = 60_000
    (tmp_path / "big.csv").write_text("First,Last\n" + "".join(f'"name {i}\nof two lines",{i}\n' for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        rows = csv_scan.scan(spark, str(tmp_path / "big.csv"), Mapping.read(MAPPING)).selectExpr("row_number", "fields['first_name'] as a", "fields['last_name'] as b", "row_digest")
        assert rows.count() == n and rows.where("b = string(row_number - 1) and a = concat('name ', b, '\\nof two lines')").count() == n and rows.select("row_digest").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_mappings_are_strict():
    assert Mapping.read(MAPPING).required == ("first", "last") and Mapping.read(MAPPING).values == ("first_name",)
    assert Mapping.read({"columns": COLUMNS, "header": {"mode": "first_record", "maxPreambleLines": 0}}).required == ("first", "last")
    for change in ({"other": 1}, {"header": {"mode": "guess", "maxPreambleLines": 0}}, {"header": {"mode": "first_record", "maxPreambleLines": 101}}, {"limits": {"maxColumns": 257}}, {"limits": {"max": 1}}, {"columns": [*COLUMNS, {"sourceHeader": "X", "targetField": "secret", "required": False}]}, {"columns": [COLUMNS[0] | {"transforms": ["run"]}]}, {"columns": "x"}):
        with pytest.raises(ConfigError, match="INVALID_MAPPING"):
            Mapping.read(MAPPING | change)
    for change, code in (([*COLUMNS, COLUMNS[0]], "DUPLICATE_SOURCE_MAPPING"), ([*COLUMNS, COLUMNS[0] | {"sourceHeader": "Z"}], "DUPLICATE_TARGET_FIELD"), (COLUMNS[:1], "PERSON_NAME_MAPPING_REQUIRED")):
        with pytest.raises(ConfigError, match=code):
            Mapping.read(MAPPING | {"columns": change})
