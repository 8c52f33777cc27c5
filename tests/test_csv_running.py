"""The sums of a scan are made while lines are read, and are the same wherever batches of lines are cut."""

import random

import pyarrow as pa

from kinweft.sources import csv_scan


def test_running_sums_of_lines(spark):
    r = random.Random(11)
    for _ in range(60):
        rows = []
        for file in ("a", "b", "c")[: r.randint(1, 3)]:
            for block in range(r.randint(1, 3)):
                rows += [(file, block * 100, r.choice((0, 0, 1, 2, 3)), r.randint(0, 9)) for _ in range(r.randint(1, 12))]
        want, key = [], None
        for file, block, quotes, size in rows:
            if key != (file, block):
                key, line, before, k, sofar = (file, block), 0, 0, [0, 0], [0, 0]
            line += 1
            for p in (0, 1):
                if before % 2 == p:
                    k[p], sofar[p] = k[p] + 1, 0
            want.append((line, before, *k, *sofar))
            before, sofar = before + quotes, [s + size + 1 for s in sofar]
        columns = list(zip(*rows, strict=True))
        whole = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], "int64"), pa.array(columns[2], "int32"), pa.array(columns[3], "int64")], names=["file", "block", "quotes", "size"])
        cuts = sorted({0, len(rows), *(r.randint(0, len(rows)) for _ in range(4))})
        parts = [whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = pa.Table.from_batches(list(csv_scan._running(parts))).select(csv_scan._RUNNING).to_pylist()
        assert [tuple(x.values()) for x in found] == want


def test_lines_are_shuffled_once_to_become_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('First,Last\n"x\ny",z\n')
    made, _ = csv_scan._records_of(spark, str(tmp_path / "a.csv"), csv_scan.Mapping.read({"columns": [{"sourceHeader": "First", "targetField": "first_name"}, {"sourceHeader": "Last", "targetField": "last_name"}]}))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert [(x.record, [bytes(p) for p in x.pieces]) for x in made.orderBy("record").collect()] == [(1, [b"First,Last"]), (2, [b'"x', b'y",z'])]
