"""Cuckoo filters in several shards."""

from kinweft.llm import line_dedup


def test_keys_ask_their_own_shard(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 50)
    keys = [line_dedup.key_digest(b"line %d" % i) for i in range(1000)]
    table = spark.createDataFrame([(bytearray(k), 10 if i < 600 else 3) for i, k in enumerate(keys)], "key binary, refs long")
    rows = [tuple(r) for r in line_dedup.shard_filters(table).select("shard", "shards", "filter").collect()]
    found = line_dedup.Shards(rows)
    assert found.shards == len(rows) == 16 and found.contains(keys[:600]).all() and found.contains(keys[600:]).sum() < 5
    assert not line_dedup.Shards([]).contains(keys).any()
    docs = spark.createDataFrame([(i, "\n".join([f"line {k}" for k in range(20)] + [f"own {i}"])) for i in range(12)], "doc_id long, text string")
    left = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_common_lines(docs).collect()}
    assert left == {i: (f"own {i}", 20) for i in range(12)}


def test_lines_go_to_large_filters_with_the_same_result(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(["hot", *(f"line {k}" for k in range(i % 7, 200, 3)), f"own {i}", ""])) for i in range(40)] + [(40, None), (41, "hot"), (42, "hot")], "doc_id long, text string")
    want = {r.doc_id: tuple(r) for r in line_dedup.drop_common_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 20)
    monkeypatch.setattr(line_dedup, "LINES_PER_TASK", 30)  # shards of several tasks
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert {r.doc_id: tuple(r) for r in line_dedup.drop_common_lines(docs).collect()} == want
    assert want[41] == (41, "", 1, 1) and want[40] == (40, "", 1, 0) and want[0][1] == "line 0\nown 0\n"


def test_false_positives_of_a_filter_are_put_right(spark):
    keys = [line_dedup.key_digest(b"%d" % i) for i in range(30)]
    raw = line_dedup.CuckooFilter.build(keys[:20]).buckets.tobytes()  # of which ten are common
    filters = spark.createDataFrame([(0, 1, bytearray(raw), 3)], "shard int, shards int, filter binary, tasks long")
    asked = spark.createDataFrame([(t, bytearray(k)) for t in range(4) for k in keys], "text_key long, key binary")
    wrong = spark.createDataFrame([(bytearray(k),) for k in keys[10:20]], "key binary")
    for no, n in ((None, 20), (wrong, 10)):
        got = {(r.text_key, bytes(r.key)) for r in line_dedup._found_in_shards(asked, filters, no).collect()}
        assert got == {(t, k) for t in range(4) for k in keys[:n]}
