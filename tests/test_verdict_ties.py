"""adapter_verdicts is its SQL with the tie that the SQL's ORDER BY leaves open decided by the order in which records came."""

import datetime as dt

import duckdb

from kinweft.plans import ingest


def test_only_open_ties_differ(spark, monkeypatch):
    # of 72 and 73, equal in record, instant and digest, 72 has a field that is not allowed: the first of them decides
    rows = [(k, dt.datetime(1995, 1, 1 + (k // 2) % 3), "OF"[k % 2]) for k in [*range(72, 76), *range(400, 800)]]
    monkeypatch.setattr(ingest.workload, "star", lambda s, d, t: spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_orderstatus string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_orderdate TIMESTAMP, o_orderstatus VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", rows)
    by = lambda more: dict(con.execute(ingest.SQL["adapter_verdicts"].replace("ORDER BY seen, d)", f"ORDER BY seen, d{more})")).fetchall())
    assert by(", o") != by(", o DESC")
    assert dict(ingest.adapter_verdicts(spark, "").collect()) == by(", o")
