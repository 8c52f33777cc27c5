"""What a query costs does not hang on how few files its input has, nor is work done twice."""

from kinweft.operators import adapters, materialize
from kinweft.plans import scans

REQUEST = materialize.Request("w", "s1", "k1", "generic_contacts_csv", "m", "1", "2026-01-01T00:00:00.000Z", "ab" * 32)


def test_rows_of_one_file_are_canonicalized_once_by_all_tasks(spark):
    rows = spark.createDataFrame([(i, f" N{i} ", f"d{i % 3}.example") for i in range(9)], "row_number int, full_name string, company_domain string").coalesce(1)
    canonical = materialize.canonical_rows(rows)
    assert canonical.rdd.getNumPartitions() > 1
    first = materialize.groups(materialize.stage_rows(canonical, ["full_name"], REQUEST))
    # groups are read several times and stand in files: no value is worked out anew
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "Join" not in plan and first.count() == 9


def test_of_equal_records_the_first_to_come_counts(spark):
    kind = "adapter_authorization_id string, provider_record_id string, observed_at string, record_digest_sha256 string, fields string, place long"
    at, fine, bad = "2001-01-01T00:00:00.000Z", '{"title":"x"}', '{"title":"x","secret":"y"}'
    rows = [("a", f"p{i}", at, "d", *((fine, 2), (bad, 1))[k ^ j]) for i in range(40) for j in [i % 2] for k in (0, 1)]
    none = spark.createDataFrame([], kind)
    for order, want in (("place", {"FIELD_NOT_AUTHORIZED": 40, "duplicate": 40}), (None, {"FIELD_NOT_AUTHORIZED": 40, "duplicate": 40})):
        made = adapters.accept(spark.createDataFrame(rows, kind), none, ["title"], at, at, order)
        assert {r["verdict"]: r["count"] for r in made.groupBy("verdict").count().collect()} == want
    late = [(*r[:5], 3 - r[5]) for r in rows]
    made = adapters.accept(spark.createDataFrame(late, kind), none, ["title"], at, at, "place")
    assert {r["verdict"]: r["count"] for r in made.groupBy("verdict").count().collect()} == {"FIELD_NOT_AUTHORIZED": 40, "accepted": 40}


def test_chains_are_made_once(spark):
    made = scans.user_audit_chains(spark, "/root/testdata/sf0.001")
    # a chain is serial work in Python, so what is read from it several times stands in a file
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
