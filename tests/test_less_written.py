"""What an evaluation writes and shuffles: no more than who reads it asks for, and nothing longer than it is read."""

import os
import time

from pyspark.sql import functions as F

from kinweft.config import read_config, read_policy
from kinweft.operators import evaluate
from kinweft.plans import catalog, workload
from kinweft.session import staged

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {os.path.basename(files.apply(i).getPath()) for i in range(files.size())}


def test_shuffles_of_a_staged_frame_go_when_it_is_written(spark):
    before = _shuffle_files(spark)
    held = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count("*").alias("n"))
    assert staged(held, "counts").count() == 50_000
    until = time.time() + 20

    # counting makes a shuffle of its own, of a few rows; that of 50,000 groups is gone
    def left():
        size = 0
        for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
            for top, _, names in os.walk(d.getPath()):
                size += sum(os.path.getsize(f"{top}/{n}") for n in names if n.startswith("shuffle_") and n not in before and os.path.exists(f"{top}/{n}"))
        return size

    while left() > 50_000 and time.time() < until:
        time.sleep(0.2)
    assert left() <= 50_000


def test_only_snapshots_that_references_name_are_looked_up(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "snapshot string, dep int")
    references = spark.createDataFrame([("b",), ("b",), (None,), ("x",)], "snapshot string")
    assert [tuple(r) for r in evaluate.named_snapshots(references, known).collect()] == [("b", 2)]


def test_reasons_carry_no_arrays_of_dependencies(spark):
    config = read_config(workload.config(workload.suppliers(spark, SF)))
    found = evaluate.verdicts(workload.tables(spark, SF), config, read_policy(workload.POLICY), workload.clock())
    # what is read of the files, not what they hold
    plan = lambda *c: "\n".join(x for x in found.select(*c)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" not in x)
    assert "_deps" in plan("snapshot_ids") and "edge_refs" in plan("own_refs")
    short = plan("category", "disposition", "reasons", "review_priority")
    assert "_deps" not in short and "_refs" not in short


def test_flags_say_all_that_is_wrong_for_each_class(spark):
    codes = evaluate.CODES[1:4]
    rows = [(i, *[bool(i >> k & 1) for k in range(3)], ["A", "C"] if i % 3 == 0 else ["B", None] if i % 3 == 1 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, x boolean, y boolean, z boolean, allowed array<string>")
    flags = evaluate.flags(dict(zip(codes, map(F.col, "xyz"), strict=True)), {c: ~F.array_contains("allowed", c) for c in evaluate.DENIED})
    for r in df.select("*", flags.alias("flags")).collect():
        assert [c for k, c in enumerate(evaluate.CODES) if r.flags >> k & 1] == [c for c, on in zip(codes, (r.x, r.y, r.z), strict=True) if on]
        # a list with a null in it refuses nothing for certain
        assert {c for c, bit in evaluate.DENIED.items() if r.flags & bit} == ({"B", "D"} if r.allowed and None not in r.allowed else set())


def test_results_are_made_of_findings_only(spark, monkeypatch):
    written = {}

    def kept(df, name):
        made = staged(df, name)
        written.setdefault(name, []).append(made)
        return made

    monkeypatch.setattr(catalog, "staged", kept)
    catalog._results(spark, "/root/testdata/sf0.01")
    assert {r.disposition for r in written["verdicts"][0].select("disposition").distinct().collect()} <= {"eligible"}


def test_evidence_of_claims_is_looked_up_once(spark, monkeypatch):
    wanted = []
    look_up = evaluate.look_up
    monkeypatch.setattr(evaluate, "look_up", lambda asked, *a, **b: wanted.extend(x[0] for x in asked) or look_up(asked, *a, **b))
    made = catalog.evidence_summary(spark, "/root/testdata/sf0.01")
    assert wanted.count("claim") == 1
    assert made.count() == 15


def test_a_fingerprint_makes_edges_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(workload, "staged", lambda df, name: written.append(name) or staged(df, name))
    made = catalog.input_fingerprint(spark, SF).first()
    assert written == ["edges"]
    assert made["fingerprint"] == evaluate.input_set_fingerprint(workload.tables(spark, SF), workload.WORKSPACE)
