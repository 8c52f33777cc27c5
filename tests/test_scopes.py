"""What organizations' claims add to candidates is named, not copied, and counts the same as the full lists."""

from pyspark.sql import functions as F

from kinweft.config import read_config, read_policy
from kinweft.operators import display, evaluate
from kinweft.plans import workload

SF = "/root/testdata/sf0.001"


def test_scopes_stand_for_all_their_references(spark):
    tables = workload.tables(spark, SF)
    # claims on two snapshots, one of them on evidence that is there twice over, and one on evidence that is not there
    two = F.when(F.substring("organization_claim_id", 2, 20).cast("long") % 5 == 0, F.array(F.col("evidence_refs")[0], F.lit("eo3"), F.lit("ei7"), F.lit("ee11"))).otherwise(F.col("evidence_refs"))
    tables["organization_claim"] = tables["organization_claim"].withColumn("evidence_refs", two)
    config = read_config(workload.config(workload.suppliers(spark, SF)))
    found = evaluate.staged(evaluate.verdicts(tables, config, read_policy(workload.POLICY), workload.clock()), "verdicts")
    # a candidate is as wide as its own evidence, however many claims its organization has
    assert found.agg(F.max(F.size("own_refs"))).first()[0] <= 3
    scoped = evaluate.scoped_references(tables)
    held = {(r.latest_organization_id, r.ref): set(r.scope) for r in scoped.collect()}
    full = {r.relationship_edge_id: r for r in evaluate.with_all_refs(found, scoped).collect()}
    known = {r.evidence_ref_id for r in tables["evidence_ref"].collect()}
    want = {}
    for r in found.collect():
        refs = set(r.own_refs) | {ref for (org, ref), scope in held.items() if org == r.latest_organization_id and scope & set(r.organization_scopes)}
        assert full[r.relationship_edge_id].own_refs == sorted(refs)
        want[r.relationship_edge_id] = len(refs & known)
    assert max(want.values()) > 3
    every = found.withColumn("disposition", F.lit("eligible"))
    made = [evaluate.results(df, config, "w", "run", ("latest_organization_id", "organization_scopes", F.col("relationship_edge_id").alias("e"))) for df in (every, evaluate.with_all_refs(every, scoped))]
    short, long = (display.evidence_summary(m, tables, *s) for m, s in zip(made, ([scoped], []), strict=True))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.select(*short.columns).collect()))
    edges = {r.result_id: r.e for r in made[0].collect()}
    assert {r.result_id: r.evidence_count for r in short.collect()} == {k: want[e] for k, e in edges.items()}
