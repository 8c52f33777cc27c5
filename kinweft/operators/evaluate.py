"""The coverage evaluation: which relationships are findings of which class, which are blocked, and why.

Every edge is joined to the latest employment of its person, classified by compiled rules, and then gated.  All
gates are evaluated for every candidate, since complete reason lists are part of the result.  The large tables meet
on person, on evidence id and on (organization, snapshot); people, evidence and organization claims are summed up
before they meet edges.  Small tables (consents, contributors, rules) are left to Spark's size-checked broadcast.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import FIELDS, WEIGHTS, ConfigError, instant, iso, read_config, read_policy
from kinweft.config import digest as config_digest
from kinweft.functions.digest import camel, json_object, json_string, json_value, scoped_id, scoped_id_column, sha256, sha256_hex
from kinweft.functions.scalars import age_days, score
from kinweft.operators import rules
from kinweft.operators.consent import at, authorized_aliases, disposition, suppressions
from kinweft.session import staged

ENGINE_VERSION = "0.1.0-deterministic"
_ORDER = "UNICODE"


@dataclass(frozen=True)
class Evaluation:
    """An evaluation's identity and its frames.

    ``verdicts`` has one row for each candidate edge; the others are its parts in the order reports use.
    """

    audit_run_id: str
    config_sha256: str
    policy_sha256: str
    input_set_sha256: str
    clock: datetime
    verdicts: DataFrame
    results: DataFrame
    blocked: DataFrame
    review_only: DataFrame


def in_dictionary_order(name: str) -> Column:
    return F.collate(F.col(name), _ORDER)


def latest_employment(claims: DataFrame, clock: datetime, current_days: int) -> DataFrame:
    """Each person's newest claim (by the text of its instant, then by id), and how many current employers there are.

    Claims dated after the clock count.  ``current_organizations`` counts distinct organizations among the person's
    claims that are current and not older than ``current_days``.
    """
    person = Window.partitionBy("workspace_id", "person_id")
    newest = person.orderBy(F.desc("observed_at"), F.asc("employment_claim_id"))
    recent = (F.col("state") == "current") & (age_days(at(clock), F.try_to_timestamp("observed_at")) <= current_days)
    counted = claims.withColumn("current_organizations", F.size(F.collect_set(F.when(recent, F.col("organization_id"))).over(person)))
    return counted.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")


def identity_summary(claims: DataFrame) -> DataFrame:
    """(person_id, identity_confidence, identity_conflicted, identity_refs) of each person with identity claims."""
    return claims.groupBy("person_id").agg(
        F.min("confidence").alias("identity_confidence"), F.bool_or(F.col("review_status") == "conflicted").alias("identity_conflicted"), F.array_distinct(F.flatten(F.collect_set("evidence_refs"))).alias("identity_refs")
    )


def accounts(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """(organization_id, is_target, one attribute column for each rule field) of the configured organizations.

    The attributes of a profile hide those of a target, even where they are empty.
    """
    found: dict[str, tuple[bool, dict]] = {x["organizationId"]: (True, x["attributes"]) for x in config["targetAccounts"]}
    for x in config["accountProfiles"]:
        found[x["organizationId"]] = (x["organizationId"] in found, x["attributes"])
    names = [f for f in FIELDS if f not in ("title", "function", "seniority")]
    rows = [(k, target, *(rules.attribute(attrs.get(f)) for f in names)) for k, (target, attrs) in sorted(found.items())]
    return spark.createDataFrame(rows, "organization_id string, is_target boolean, " + ", ".join(f"attr_{f} {rules.ATTRIBUTE}" for f in names))


def people(tables: dict[str, DataFrame], config: dict[str, Any], clock: datetime) -> DataFrame:
    """One row for each employed person: the latest employment, and how its account and the person fit.

    What a person's employment is worth is the same for all edges to the person, and worked out before these meet it.
    """
    spark = tables["employment_claim"].sparkSession
    latest = latest_employment(tables["employment_claim"], clock, config["freshness"]["currentEmploymentMaxDays"]).select(
        "person_id", "employment_claim_id", F.col("organization_id").alias("latest_organization_id"), "title", "function", "seniority", "state", "ended_at", F.col("review_status").alias("employment_status"),
        F.col("observed_at").alias("employment_observed_at"), F.col("confidence").alias("employment_confidence"), F.col("evidence_refs").alias("employment_refs"), "current_organizations",
    )
    if config["approvedOrganizationAliases"]:
        alias = authorized_aliases(tables["organization_alias_candidate"], tables["review_decision"], config, clock)
        first = alias.groupBy(F.col("source_organization_id").alias("latest_organization_id")).agg(F.min_by("organization_id", "position").alias("alias_organization_id"))
        latest = latest.join(F.broadcast(first), "latest_organization_id", "left")
    else:
        latest = latest.withColumn("alias_organization_id", F.lit(None).cast("string"))
    latest = latest.withColumn("organization_id", F.coalesce("alias_organization_id", "latest_organization_id"))
    # the configuration is bounded by what one JSON file holds, so its accounts can be sent everywhere
    latest = latest.join(F.broadcast(accounts(spark, config)), "organization_id", "left")
    attributes = {f: rules.text_attribute(F.col(f)) if f in ("title", "function", "seniority") else F.col(f"attr_{f}") for f in FIELDS}
    latest = latest.withColumns({"is_target": F.coalesce("is_target", F.lit(False)), "icp": rules.evaluate(config["icpRuleSet"], attributes), "persona": rules.evaluate(config["stakeholderPersonaRuleSet"], attributes)})
    coach = rules.evaluate(config["coachCandidateRuleSet"], attributes)["matched"] if "coachCandidateRuleSet" in config else F.lit(False)
    latest = latest.withColumns({"coach_matched": coach, "persona_outcome": rules.persona_outcome(F.col("persona"), config["scoring"]), "icp_matched": F.col("icp")["matched"], "icp_score": F.col("icp")["score"], "persona_score": F.col("persona")["score"]})
    return latest.drop("title", "function", "seniority", "icp", "persona", *[c for c in latest.columns if c.startswith("attr_") and c != "attr_crm_state"])


def candidates(tables: dict[str, DataFrame], config: dict[str, Any], clock: datetime, latest: DataFrame | None = None) -> DataFrame:
    """One row for each edge that falls into a class: the edge, its class and its person's latest organization.

    ``latest`` is :func:`people`, if it is there already.  Everything else that is known of the person stays with the
    person.
    """
    spark = tables["relationship_edge"].sparkSession
    latest = people(tables, config, clock) if latest is None else latest
    e = tables["relationship_edge"].select(
        "relationship_edge_id", "contributor_id", F.col("destination_person_id").alias("person_id"), "consent_record_id", "source_snapshot_id", "eligible",
        age_days(at(clock), F.try_to_timestamp("observed_at")).alias("relationship_age"), F.col("confidence").alias("edge_confidence"), F.col("evidence_refs").alias("edge_refs"), none("evidence_refs").alias("edge_bare"),
    )
    directs = spark.createDataFrame([(k, True) for k in sorted(set(config["directContributorIds"]))], "contributor_id string, direct boolean")
    fit = latest.select("person_id", "latest_organization_id", "is_target", "icp_matched", "persona_outcome")
    made = e.join(fit, "person_id").join(directs, "contributor_id", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    made = made.withColumn("category", rules.category(F.col("direct"), F.col("is_target"), F.col("icp_matched"), F.col("persona_outcome")))
    return made.where("category is not null").drop("direct", "is_target", "icp_matched", "persona_outcome")


def none(refs: str) -> Column:
    """Whether an array of references has none; shorter to carry than the array."""
    return F.coalesce(F.size(refs), F.lit(0)) <= 0


def suppression_codes(rules_: DataFrame) -> DataFrame:
    """(kind, value, hit): the reason codes of all active rules on one value."""
    return staged(rules_.groupBy("kind", "value").agg(F.collect_set("reason_code").alias("hit")), "suppressions")


def suppressed(df: DataFrame, active: DataFrame, kind: str, name: str, to: str) -> DataFrame:
    """``df`` with ``to``, the codes of the active rules of one kind on the column ``name``, null where there are none."""
    held = active.where(F.col("kind") == kind).select("value", F.col("hit").alias(to))
    return df.join(held, F.lower(df[name]) == held["value"], "left").drop("value")


def all_codes(*names: str) -> Column:
    """The codes of some columns that may be null, in one array."""
    return F.array_distinct(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names]))


def suppressed_people(persons: DataFrame, active: DataFrame) -> DataFrame:
    """``persons`` with person_suppressed: the codes of the rules that the person, an organization or the CRM state of it meets."""
    persons = suppressed(suppressed(persons, active, "person", "person_id", "hit_1"), active, "organization", "latest_organization_id", "hit_2")
    persons = suppressed(persons, active, "organization", "organization_id", "hit_3")
    # a state may be a few texts of the configuration's accounts, so each occurring one is looked up once
    states = F.when(~F.col("attr_crm_state")["many"], F.transform(F.filter(F.col("attr_crm_state")["values"], lambda x: x["kind"] == "s"), lambda x: x["text"]))
    occurring = persons.select("organization_id", F.explode(states).alias("state_text")).distinct()
    met = suppressed(occurring, active, "crm_state", "state_text", "hit").where("hit is not null").groupBy("organization_id").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit_4"))
    persons = persons.join(met, "organization_id", "left")
    return persons.withColumn("person_suppressed", all_codes("hit_1", "hit_2", "hit_3", "hit_4")).drop("hit_1", "hit_2", "hit_3", "hit_4")


#: What may be wrong with a snapshot that a candidate rests on, whatever its class: one bit each of a dependency's ``flags``.
CODES = (
    "DEPENDENCY_SNAPSHOT_MISSING", "DEPENDENCY_CONSENT_MISSING", "DEPENDENCY_CONSENT_PURPOSE_MISMATCH", "DEPENDENCY_CONSENT_CONTRIBUTOR_MISMATCH", "DEPENDENCY_CONSENT_SOURCE_DISALLOWED", "DEPENDENCY_CONTRIBUTOR_INACTIVE",
    *(f"DEPENDENCY_CONSENT_{d}" for d in ("WITHDRAWN", "INACTIVE", "NOT_YET_ACTIVE", "EXPIRED")),
)
#: The bits of the classes that its consent does not allow.
DENIED = {c: 1 << (len(CODES) + i) for i, c in enumerate("ABCD")}


def flags(codes: dict[str, Column], denied: dict[str, Column] | None = None) -> Column:
    """The bits of the codes and denied classes that hold, in one number."""
    held = {1 << CODES.index(k): c for k, c in codes.items()} | {DENIED[k]: c for k, c in (denied or {}).items()}
    return reduce(lambda x, y: x + y, [F.when(c, F.lit(bit)).otherwise(0) for bit, c in held.items()])


def known_snapshots(tables: dict[str, DataFrame], policy: dict[str, Any], clock: datetime, active: DataFrame) -> DataFrame:
    """(snapshot, dep) of all snapshots.

    ``dep`` is all that a candidate needs to know of a snapshot it rests on: its id, consent, contributor and kind, in
    ``flags`` what is wrong with it and for which classes, and the codes of the rules that suppress its kind.  It is
    worked out once for each snapshot, and candidates only put arrays of it together.
    """
    snapshots = tables["source_snapshot"].select(F.col("source_snapshot_id").alias("snapshot"), F.col("contributor_id").alias("by_contributor"), F.col("consent_record_id").alias("by_consent"), "source_kind")
    consents = tables["consent"].select(F.col("consent_record_id").alias("by_consent"), disposition(clock).alias("disposition"), "purpose_id", F.col("contributor_id").alias("consent_contributor"), "allowed_categories", "source_classes")
    people_ = tables["contributor"].select(F.col("contributor_id").alias("by_contributor"), "status")
    known = snapshots.join(consents, "by_consent", "left").join(people_, "by_contributor", "left")
    there, given = F.col("source_kind").isNotNull(), F.col("source_kind").isNotNull() & F.col("disposition").isNotNull()
    codes = {
        "DEPENDENCY_CONSENT_MISSING": there & F.col("disposition").isNull(),
        "DEPENDENCY_CONSENT_PURPOSE_MISMATCH": given & (F.col("purpose_id") != policy["purposeId"]),
        "DEPENDENCY_CONSENT_CONTRIBUTOR_MISMATCH": given & (F.col("consent_contributor") != F.col("by_contributor")),
        "DEPENDENCY_CONSENT_SOURCE_DISALLOWED": given & ~F.array_contains("source_classes", F.col("source_kind")),
        "DEPENDENCY_CONTRIBUTOR_INACTIVE": there & (F.coalesce("status", F.lit("")) != "active"),
        **{f"DEPENDENCY_CONSENT_{d.upper()}": given & (F.col("disposition") == d) for d in ("withdrawn", "inactive", "not_yet_active", "expired")},
    }
    known = suppressed(known, active, "source", "source_kind", "suppressed").withColumn("flags", flags(codes, {c: given & ~F.array_contains("allowed_categories", c) for c in DENIED}))
    return staged(known.select("snapshot", F.struct("snapshot", *_DEP).alias("dep")), "snapshots")


_DEP = ("by_consent", "by_contributor", "source_kind", "flags", "suppressed")


def named_snapshots(references: DataFrame, known: DataFrame) -> DataFrame:
    """The ``known`` snapshots that some ``references`` name, which are mostly far fewer than all."""
    named = staged(references.where("snapshot is not null").select("snapshot").distinct(), "named")
    return staged(known.join(named, "snapshot", "left_semi"), "snapshots")


def with_known(df: DataFrame, known: DataFrame, active: DataFrame) -> DataFrame:
    """``df`` with what is known of its ``snapshot``, and with the codes of the rules on that id, known or not."""
    return suppressed(df.join(known, "snapshot", "left"), active, "snapshot", "snapshot", "by_id")


def dependency(missing: int | None = None) -> Column:
    """The ``dep`` of ``snapshot`` after :func:`with_known`; of one that is not known the flags are ``missing``, or that it is."""
    missing = 1 << CODES.index("DEPENDENCY_SNAPSHOT_MISSING") if missing is None else missing
    there = F.when(F.col("dep.source_kind").isNotNull(), F.col("dep.flags")).otherwise(missing)
    made = {"flags": there, "suppressed": F.when(F.col("by_id").isNull(), F.col("dep.suppressed")).otherwise(all_codes("dep.suppressed", "by_id"))}
    return F.struct("snapshot", *[made.get(c, F.col(f"dep.{c}")).alias(c) for c in _DEP])


def summed(part: str, dep: Column) -> list[Column]:
    """What the dependencies ``dep`` of a part say together: the array of them, their flags, and the codes of the rules they meet.

    Who asks for no ids of snapshots, consents or contributors needs no arrays.
    """
    return [F.collect_set(dep).alias(f"{part}_deps"), F.bit_or(dep["flags"]).alias(f"{part}_flags"), F.array_distinct(F.flatten(F.collect_set(dep["suppressed"]))).alias(f"{part}_hit")]


def look_up(wanted: list[tuple[str, DataFrame, str, str]], tables: dict[str, DataFrame], counted: dict[str, Column] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(owner, id, ref, snapshot, held, also): the snapshot of every reference of some tables, and whether there is such evidence.

    ``wanted`` are (owner, rows, key, column of references).  All evidence is read once for all of them.  ``counted``
    has, for an owner, the snapshot that a row rests on anyway; a reference that is held there tells nothing new and is
    left out.  ``also`` names further columns of the evidence.
    """
    counted = counted or {}
    each = [df.select(F.lit(owner).alias("owner"), F.col(key).alias("id"), counted.get(owner, F.lit(None)).cast("string").alias("counted"), F.explode(refs).alias("ref")) for owner, df, key, refs in wanted]
    evidence = tables["evidence_ref"].select(F.col("evidence_ref_id").alias("ref"), F.col("source_snapshot_id").alias("snapshot"), F.lit(True).alias("held"), *also)
    found = reduce(DataFrame.unionByName, each).join(evidence, "ref", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return staged(found.where("counted is null or snapshot is null or snapshot <> counted").drop("counted"), "references")


def organization_scopes(tables: dict[str, DataFrame], references: DataFrame, known: DataFrame, active: DataFrame) -> DataFrame:
    """What is claimed of an organization by the claims that rest on a snapshot, for every pair of both.

    (latest_organization_id, snapshot, organization_conflicted, organization_suppressed, organization_deps,
    organization_lost), where ``organization_suppressed`` has the codes of the rules on its domains.  The references themselves are :func:`scoped_references`: candidates name the scopes that they
    have, since the references of one scope are as many as its claims.
    """
    claims = _scoped_claims(tables, references).withColumn("snapshot", F.explode("snapshots")).groupBy("latest_organization_id", "snapshot").agg(
        F.bool_or(F.col("review_status") == "conflicted").alias("organization_conflicted"), F.collect_set(F.when(F.col("kind") == "domain", F.col("value"))).alias("organization_domains"),
        F.array_distinct(F.flatten(F.collect_set("snapshots"))).alias("on"), F.bool_or("lost").alias("organization_lost"),
    )
    claims = staged(claims, "scopes")
    key = ["latest_organization_id", F.col("snapshot").alias("scope")]
    deps = with_known(claims.select(*key, F.explode("on").alias("snapshot")), known, active).groupBy("latest_organization_id", "scope").agg(*summed("organization", dependency()))
    hits = suppressed(claims.select(*key, F.explode("organization_domains").alias("domain")), active, "domain", "domain", "hit").where("hit is not null")
    hits = hits.groupBy("latest_organization_id", "scope").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("organization_suppressed"))
    both = deps.join(hits, ["latest_organization_id", "scope"], "left").withColumnRenamed("scope", "snapshot")
    return staged(claims.drop("on", "organization_domains").join(both, ["latest_organization_id", "snapshot"]), "scopes")


def _scoped_claims(tables: dict[str, DataFrame], references: DataFrame) -> DataFrame:
    rests = references.where("owner = 'claim'").groupBy("id").agg(F.collect_set("snapshot").alias("snapshots"), F.bool_or(~F.col("held")).alias("lost"))
    claims = tables["organization_claim"].select(F.col("organization_claim_id").alias("id"), F.col("organization_id").alias("latest_organization_id"), "evidence_refs", "review_status", "kind", F.lower("value").alias("value"))
    return claims.join(rests, "id")


def scoped_references(tables: dict[str, DataFrame], references: DataFrame | None = None) -> DataFrame:
    """(latest_organization_id, ref, scope): each reference of an organization's claims, and the snapshots in whose scopes it is."""
    if references is None:
        references = look_up([("claim", tables["organization_claim"], "organization_claim_id", "evidence_refs")], tables)
    each = _scoped_claims(tables, references).where(F.size("snapshots") > 0).select("latest_organization_id", F.explode("evidence_refs").alias("ref"), "snapshots")
    return each.groupBy("latest_organization_id", "ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("snapshots")))).alias("scope"))


def over_scopes(found: DataFrame, blocks: DataFrame, *sums: Column) -> DataFrame:
    """(latest_organization_id, organization_scopes, sums): what the scopes of every occurring set of scopes have together.

    ``blocks`` has (latest_organization_id, scope, ...): what all references have that are in the same scopes; so every
    reference is in one block, and a set of scopes has the blocks that share a scope with it.
    """
    sets = found.select("latest_organization_id", "organization_scopes").where(F.size("organization_scopes") > 0).distinct()
    touched = sets.withColumn("one", F.explode("organization_scopes")).join(blocks.select("latest_organization_id", "scope", F.explode("scope").alias("one")), ["latest_organization_id", "one"])
    touched = touched.select("latest_organization_id", "organization_scopes", "scope").distinct()
    return touched.join(blocks, ["latest_organization_id", "scope"]).groupBy("latest_organization_id", "organization_scopes").agg(*sums)


_ORGANIZATION = ("organization_suppressed", "organization_deps", "organization_hit")


def scoped_people(latest: DataFrame, references: DataFrame, scopes: DataFrame) -> DataFrame:
    """(person_id, person_scopes, conflicted_1, lost_1, organization_suppressed_1, organization_deps_1) of the people whose employment's evidence is in a scope."""
    on = references.where("owner = 'employment' and snapshot is not null").select(F.col("id").alias("person_id"), "snapshot").distinct()
    met = latest.select("person_id", "latest_organization_id").join(on, "person_id").join(scopes, ["latest_organization_id", "snapshot"])
    merged = [F.array_distinct(F.flatten(F.collect_set(c))).alias(f"{c}_1") for c in _ORGANIZATION]
    return met.groupBy("person_id").agg(F.collect_set("snapshot").alias("person_scopes"), F.bool_or("organization_conflicted").alias("conflicted_1"), F.bool_or("organization_lost").alias("lost_1"), F.bit_or("organization_flags").alias("flags_1"), *merged)


def with_scopes(found: DataFrame, scopes: DataFrame, persons: DataFrame) -> DataFrame:
    """Candidates with what is claimed of their latest organization by the snapshots that their own evidence is from.

    Adds organization_scopes (the snapshots of these scopes), organization_conflicted, organization_lost,
    organization_suppressed and organization_deps.  ``persons`` has the scopes of a person's employment, looked up once
    for the person; a candidate adds that of its own edge's snapshot.
    """
    own = scopes.select(F.col("snapshot").alias("source_snapshot_id"), "latest_organization_id", F.col("snapshot").alias("own_scope"), F.col("organization_conflicted").alias("conflicted_2"), F.col("organization_lost").alias("lost_2"), F.col("organization_flags").alias("flags_2"), *[F.col(c).alias(f"{c}_2") for c in _ORGANIZATION])
    both = found.join(persons, "person_id", "left").join(own, ["latest_organization_id", "source_snapshot_id"], "left")
    kinds, either = dict(both.dtypes), lambda c: F.coalesce(f"{c}_1", F.lit(False)) | F.coalesce(f"{c}_2", F.lit(False))
    both = both.withColumns(
        {
            "organization_scopes": F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("person_scopes", F.array().cast("array<string>")), F.array("own_scope"))))),
            "organization_conflicted": either("conflicted"), "organization_lost": either("lost"), "organization_flags": F.coalesce("flags_1", F.lit(0)).bitwiseOR(F.coalesce("flags_2", F.lit(0))),
            **{c: F.array_distinct(F.concat(*[F.coalesce(f"{c}_{i}", F.array().cast(kinds[f"{c}_{i}"])) for i in (1, 2)])) for c in _ORGANIZATION},
        }
    )
    return both.drop("own_scope", "person_scopes", *[f"{c}_{i}" for c in ("conflicted", "lost", "flags", *_ORGANIZATION) for i in (1, 2)])


_PARTS = ("edge", "person", "organization")


def dependency_closure(found: DataFrame) -> DataFrame:
    """Candidates with all snapshots, consents and contributors they rest on, and what is wrong with them.

    From ``_deps``, ``_flags`` and ``_hit`` of edge, person and organization, as :func:`summed` makes them; adds
    snapshot_ids, consent_ids, contributor_ids, source_kinds, dependency_codes and dependency_suppressed.
    """
    kinds = dict(found.dtypes)
    deps = F.array_distinct(F.concat(*[F.coalesce(f"{p}_deps", F.array().cast(kinds[f"{p}_deps"])) for p in _PARTS]))
    flags_ = reduce(lambda x, y: x.bitwiseOR(y), [F.coalesce(f"{p}_flags", F.lit(0)) for p in _PARTS])
    made = found.withColumns({"deps": deps, "flags": flags_})
    each = lambda name: F.array_distinct(F.array_compact(F.transform("deps", lambda d: d[name])))
    denied = reduce(lambda x, c: x | (F.col("category") == c) & (F.col("flags").bitwiseAND(DENIED[c]) != 0), DENIED, F.lit(False))
    codes = F.array_compact(F.array(*[F.when(F.col("flags").bitwiseAND(1 << i) != 0, F.lit(code)) for i, code in enumerate(CODES)], F.when(denied, F.lit("DEPENDENCY_CONSENT_CATEGORY_DISALLOWED"))))
    made = made.withColumns({"snapshot_ids": F.array_sort(each("snapshot")), "consent_ids": each("by_consent"), "contributor_ids": each("by_contributor"), "source_kinds": each("source_kind"), "dependency_codes": codes, "dependency_suppressed": all_codes(*[f"{p}_hit" for p in _PARTS])})
    return made.drop("deps", "flags", *[f"{p}_{c}" for p in _PARTS for c in ("deps", "flags", "hit")])


def gates(config: dict[str, Any], policy: dict[str, Any]) -> list[tuple[str, Column]]:
    """The fixed gates, in order, as (code, condition); conditions may be null, which is false."""
    fresh = config["freshness"]
    category, active = F.col("category"), F.col("consent_disposition") == "active"
    broker = category.isin("C", "D")
    age, contact = F.col("employment_age"), F.col("relationship_age")
    given = F.col("consent_disposition").isNotNull()
    return [
        ("RELATIONSHIP_EDGE_INELIGIBLE", ~F.col("eligible")),
        ("CONTRIBUTOR_INACTIVE", F.coalesce("contributor_status", F.lit("")) != "active"),
        *((f"CONSENT_{d.upper()}", F.coalesce("consent_disposition", F.lit("inactive")) == d) for d in ("withdrawn", "inactive", "not_yet_active", "expired")),
        ("CONSENT_PURPOSE_MISMATCH", ~active & ~given | (F.coalesce("consent_purpose", F.lit("")) != policy["purposeId"])),
        ("CONSENT_SCOPE_DISALLOWS_CATEGORY_OR_SOURCE", given & (~F.array_contains("consent_categories", category) | ~F.array_contains("consent_classes", F.coalesce("snapshot_kind", F.lit(""))))),
        ("BROKER_INDIVIDUAL_CONSENT_REQUIRED", broker & F.lit(policy["requireBrokerIndividualConsent"]) & (F.coalesce("consent_basis", F.lit("")) != "individual_consent")),
        ("IDENTITY_UNRESOLVED_OR_CONFLICTED", F.col("person_pending") | F.coalesce("identity_conflicted", F.lit(False))),
        ("ORGANIZATION_UNRESOLVED_OR_CONFLICTED", F.col("organization_pending") | F.coalesce("organization_conflicted", F.lit(False))),
        ("EMPLOYMENT_ENDED", (F.col("state") == "ended") | F.col("ended_at").isNotNull()),
        ("EMPLOYMENT_CONFLICTED", (F.col("employment_status") == "conflicted") | (F.col("current_organizations") > 1)),
        ("EMPLOYMENT_STALE", (age > fresh["reviewEmploymentMaxDays"]) | (age < 0)),
        ("EMPLOYMENT_REVIEW_REQUIRED", (age > fresh["currentEmploymentMaxDays"]) & (age <= fresh["reviewEmploymentMaxDays"])),
        ("RELATIONSHIP_STALE", (contact > fresh["relationshipMaxDays"]) | (contact < 0)),
        ("DEPENDENCY_EVIDENCE_INCOMPLETE", (F.col("edge_bare") & F.col("person_bare") & (F.size("organization_scopes") == 0)) | F.col("lost") | F.col("snapshot_kind").isNull()),
        ("POLICY_CATEGORY_DISALLOWED", ~category.isin(*policy["allowedCategories"])),
        # a direct target contact who fits the persona but not the account is no class B; it is reported as blocked
        ("CATEGORY_B_PERSONA_GATE_FAILED", (category == "B") & (F.col("persona_outcome") == "matched")),
    ]


def scoped_candidates(tables: dict[str, DataFrame], config: dict[str, Any], policy: dict[str, Any], clock: datetime, whole: bool = True, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(candidates with their organization scopes, the references looked up for them with the columns ``also`` of evidence).

    With ``whole``, also with what the edge and the person rest on, and with all that is known of the person.
    """
    active = suppression_codes(suppressions(tables["suppression_rule"], config, clock))
    known = known_snapshots(tables, policy, clock, active)
    latest = staged(people(tables, config, clock), "people")
    found = candidates(tables, config, clock, latest)
    wanted = [("employment", latest, "person_id", "employment_refs"), ("claim", tables["organization_claim"], "organization_claim_id", "evidence_refs")]
    if not whole:
        found, references = staged(found, "candidates"), look_up(wanted, tables, also=also)
        scopes = organization_scopes(tables, references, named_snapshots(references, known), active)
        return with_scopes(found, scopes, scoped_people(latest, references, scopes)), references
    # an edge rests on its own snapshot, whose absence has a code of its own, and on those of its evidence; these are
    # mostly the same one, which then goes with the edge, and only what else evidence tells is put together by edge
    found = with_known(found.withColumnRenamed("source_snapshot_id", "snapshot"), known, active)
    found = found.withColumns({"dep": dependency(0).dropFields("snapshot"), "source_snapshot_id": F.col("snapshot")}).drop("snapshot", "by_id")
    found = staged(found, "candidates")
    identity = staged(identity_summary(tables["identity_claim"]), "identities")
    counted = {"edge": F.when(F.col("dep.source_kind").isNotNull(), F.col("source_snapshot_id"))}
    references = look_up([*wanted, ("identity", identity, "person_id", "identity_refs"), ("edge", found, "relationship_edge_id", "edge_refs")], tables, counted, also)
    known = named_snapshots(references, known)
    scopes = organization_scopes(tables, references, known, active)
    # people, organizations and edges are each looked up by themselves; the wide rows meet the results once
    rests = with_known(references.where("owner in ('employment', 'identity')"), known, active)
    rests = rests.groupBy(F.col("id").alias("person_id")).agg(*summed("person", F.when(F.col("held"), dependency())), F.bool_or(~F.col("held")).alias("person_lost"))
    pending = tables["person_resolution_candidate"].where("status = 'pending'").select(F.col("subject_person_id").alias("person_id"), F.lit(True).alias("person_pending")).distinct()
    closed = tables["organization_alias_candidate"].where("status = 'pending'").select(F.col("proposed_organization_id").alias("latest_organization_id"), F.lit(True).alias("organization_pending")).distinct()
    persons = suppressed_people(latest, active).drop("attr_crm_state")
    persons = persons.join(closed, "latest_organization_id", "left").drop("latest_organization_id").join(identity, "person_id", "left").join(rests, "person_id", "left").join(scoped_people(latest, references, scopes), "person_id", "left").join(pending, "person_id", "left")
    persons = persons.withColumns({"employment_age": age_days(at(clock), F.try_to_timestamp("employment_observed_at")), "person_refs": F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("employment_refs", "identity_refs")]))})
    persons = staged(persons.drop("employment_refs", "identity_refs", "employment_observed_at").withColumn("person_bare", none("person_refs")), "people")
    edges = with_known(references.where("owner = 'edge'"), known, active).groupBy(F.col("id").alias("relationship_edge_id"))
    edges = staged(edges.agg(*summed("edge", F.when(F.col("held"), dependency())), F.bool_or(~F.col("held")).alias("edge_lost")), "edges")
    found = found.join(edges, "relationship_edge_id", "left")
    own = F.array(F.struct(F.col("source_snapshot_id").alias("snapshot"), *[f"dep.{c}" for c in _DEP]))
    found = found.withColumns({"edge_deps": F.when(F.col("edge_deps").isNull(), own).otherwise(F.concat(own, "edge_deps")), "edge_flags": F.col("dep.flags").bitwiseOR(F.coalesce("edge_flags", F.lit(0))), "edge_hit": all_codes("edge_hit", "dep.suppressed"), "edge_lost": F.coalesce("edge_lost", F.lit(False)), "snapshot_kind": F.col("dep.source_kind")})
    found = with_scopes(found.drop("dep"), scopes, persons)
    return suppressed(found, active, "category", "category", "category_suppressed"), references


def verdicts(tables: dict[str, DataFrame], config: dict[str, Any], policy: dict[str, Any], clock: datetime) -> DataFrame:
    """Every candidate with all its reasons, its disposition and its scores.

    ``own_refs`` is the evidence of edge and person; that of the organization's claims is what
    :func:`scoped_references` has for the candidate's ``latest_organization_id`` and ``organization_scopes``.
    """
    return judged(tables, config, policy, clock)[0]


def judged(tables: dict[str, DataFrame], config: dict[str, Any], policy: dict[str, Any], clock: datetime, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(:func:`verdicts`, the references that :func:`look_up` found for them)."""
    found, references = scoped_candidates(tables, config, policy, clock, also=also)
    nothing = F.array().cast("array<string>")
    lost = F.col("edge_lost") | F.coalesce("person_lost", F.lit(False)) | F.col("organization_lost")
    found = found.withColumns({"own_refs": F.array_sort(F.array_distinct(F.concat(F.coalesce("edge_refs", nothing), "person_refs"))), "lost": lost}).drop("edge_refs", "person_refs", "edge_lost", "person_lost", "organization_lost")
    found = found.withColumns({"person_pending": F.coalesce("person_pending", F.lit(False)), "organization_pending": F.coalesce("organization_pending", F.lit(False))})
    consents = tables["consent"].select("consent_record_id", disposition(clock).alias("consent_disposition"), F.col("purpose_id").alias("consent_purpose"), F.col("allowed_categories").alias("consent_categories"), F.col("source_classes").alias("consent_classes"), F.col("authorization_basis").alias("consent_basis"))
    found = found.join(consents, "consent_record_id", "left").join(tables["contributor"].select("contributor_id", F.col("status").alias("contributor_status")), "contributor_id", "left")
    found = dependency_closure(found)
    fixed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in gates(config, policy)]))
    found = found.withColumn("reasons", F.array_sort(F.array_distinct(F.concat(fixed, "dependency_codes", all_codes("person_suppressed", "organization_suppressed", "dependency_suppressed", "category_suppressed")))))
    soft = "EMPLOYMENT_REVIEW_REQUIRED"
    hard = F.col("reasons") if config["reviewPolicy"]["staleEmployment"] == "block" else F.array_remove("reasons", soft)
    kind = F.when(F.size(hard) > 0, "blocked").when(F.array_contains("reasons", soft), "review_only").otherwise("eligible")
    found = found.withColumn("disposition", kind).withColumn("reason_codes", F.when(F.size(hard) > 0, hard).otherwise(F.col("reasons")))
    return _scored(found, config), references


def _scored(found: DataFrame, config: dict[str, Any]) -> DataFrame:
    limit = max(config["freshness"]["currentEmploymentMaxDays"], config["freshness"]["relationshipMaxDays"])
    parts = {
        "accountFit": F.when(F.col("is_target"), 100).otherwise(F.col("icp_score")),
        "personaFit": F.col("persona_score"),
        "relationshipConfidence": score(F.col("edge_confidence") * 100),
        "employmentConfidence": score(F.col("employment_confidence") * 100),
        "pathConfidence": score(F.least("edge_confidence", "employment_confidence", F.coalesce("identity_confidence", F.lit(1.0))) * 100),
        "freshness": score(100 - F.greatest("employment_age", "relationship_age") * 100 / F.lit(float(limit))),
    }
    names = {k: "".join("_" + c.lower() if c.isupper() else c for c in k) for k in WEIGHTS}
    found = found.withColumns({names[k]: parts[k].cast("int") for k in WEIGHTS})
    weights = config["scoring"]["weights"]
    total = sum((F.col(names[k]) * weights[k] for k in WEIGHTS), F.lit(0))
    return found.withColumn("review_priority", score(total / F.lit(float(sum(weights.values()) or 1))))


def eligible_codes(config: dict[str, Any]) -> Column:
    """The reason codes of a finding."""
    category, outcome = F.col("category"), F.col("persona_outcome")
    account = F.when(F.col("is_target") & F.col("alias_organization_id").isNotNull(), "TARGET_ACCOUNT_APPROVED_ALIAS").when(F.col("is_target"), "TARGET_ACCOUNT_EXACT").otherwise("ICP_RULES_MATCHED")
    codes = [
        F.concat(F.lit("CATEGORY_"), category, F.lit("_ELIGIBLE")), account,
        F.when(outcome == "matched", "STAKEHOLDER_PERSONA_MATCHED").otherwise("COACH_CHAMPION_CANDIDATE_ONLY"),
        F.when((outcome != "matched") & F.col("coach_matched"), "COACH_CANDIDATE_RULES_MATCHED_NOT_PROVEN"),
        F.when(category.isin("B", "D"), F.lit(config["reviewPolicy"]["reviewReasonCode"])),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*codes))))


def entity_json(tables: dict[str, DataFrame], workspace: str) -> DataFrame:
    """(j): the canonical JSON of every input entity of a workspace."""
    out = None
    for name in schemas.INPUTS:
        df = tables[name].where(F.col("workspace_id") == workspace)
        body = json_object({camel(f.name): json_value(F.col(f.name), f.dataType) for f in schemas.schema(name).fields})
        part = df.select(json_object({"entityType": F.lit(f'"{name}"'), "value": body}).alias("j"))
        out = part if out is None else out.unionByName(part)
    return out


def input_set_sha256(tables: dict[str, DataFrame], workspace: str) -> str:
    """The digest of all inputs as one canonical array, in dictionary order.

    The digest is defined on one text, so one task reads it; but it streams the sorted entities, which Spark sorts on
    disk where they are many, and holds one batch.  :func:`input_set_fingerprint` is what any number of tasks can add
    up.
    """
    order = F.collate(F.col("j"), "UNICODE")
    rows = entity_json(tables, workspace).repartition(1).sortWithinPartitions(order, "j")

    def run(batches):
        import pyarrow as pa

        made, first = hashlib.sha256(b"["), True
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                made.update(text if first else b"," + text)
                first = False
        made.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([made.hexdigest()])], names=["h"])

    found = rows.mapInArrow(run, "h string").head(1)
    return found[0]["h"] if found else sha256_hex("[]")


def input_set_fingerprint(tables: dict[str, DataFrame], workspace: str) -> str:
    """An order-free digest of the same entities that any number of tasks can add up."""
    row = entity_json(tables, workspace).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(sha256(F.col("j")), 1, 12), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring(sha256(F.col("j")), 13, 12), 16, 10).cast("decimal(38,0)")).alias("b")).first()
    return config_digest({"n": row["n"], "a": str(row["a"]), "b": str(row["b"])})


def validate(tables: dict[str, DataFrame], config: dict[str, Any], policy: dict[str, Any], clock: datetime) -> None:
    """The checks that stop a run before any row: purpose, policy start, direct contributors and aliases."""
    ws = config["workspaceId"]
    workspace = tables["workspace"].where(F.col("workspace_id") == ws).first()
    if workspace is None:
        raise ConfigError("WORKSPACE_NOT_FOUND")
    if workspace["purpose_id"] != policy["purposeId"]:
        raise ConfigError("POLICY_WORKSPACE_PURPOSE_MISMATCH")
    if instant(policy["effectiveAt"]) > clock:
        raise ConfigError("POLICY_NOT_YET_EFFECTIVE")
    wanted = config["directContributorIds"]
    status = {r["contributor_id"]: r["status"] for r in tables["contributor"].where((F.col("workspace_id") == ws) & F.col("contributor_id").isin(*wanted)).collect()}
    for c in wanted:
        if c not in status:
            raise ConfigError(f"DIRECT_CONTRIBUTOR_NOT_FOUND:{c}")
        if status[c] != "active":
            raise ConfigError(f"DIRECT_CONTRIBUTOR_INACTIVE:{c}")
    if config["approvedOrganizationAliases"]:
        good = {r["alias_id"] for r in authorized_aliases(tables["organization_alias_candidate"], tables["review_decision"], config, clock).collect()}
        for x in config["approvedOrganizationAliases"]:
            if x["aliasId"] not in good:
                raise ConfigError(f"ORGANIZATION_ALIAS_APPROVAL_INVALID:{x['aliasId']}")


@dataclass(frozen=True)
class Task:
    """A checked evaluation that is still to be run, and the id that its inputs give it."""

    audit_run_id: str
    config_sha256: str
    policy_sha256: str
    input_set_sha256: str
    config: dict[str, Any]
    policy: dict[str, Any]
    clock: datetime
    tables: dict[str, DataFrame]


def prepare(tables: dict[str, DataFrame], config: Any, policy: Any, clock: str | datetime) -> Task:
    """Check what a run of one workspace needs.  ``tables`` maps table names to DataFrames; missing ones are empty."""
    config, policy = read_config(config), read_policy(policy)
    ws = config["workspaceId"]
    if policy["workspaceId"] != ws:
        raise ConfigError("the policy is of another workspace")
    clock = instant(clock) if isinstance(clock, str) else clock
    spark = next(iter(tables.values())).sparkSession
    tables = {k: v.where(F.col("workspace_id") == ws) for k, v in schemas.complete(tables, spark).items()}
    validate(tables, config, policy, clock)
    inputs, hashes = input_set_sha256(tables, ws), (config_digest(config), config_digest(policy))
    run_id = scoped_id(ws, "audit_run", {"engineVersion": ENGINE_VERSION, "inputSetSha256": inputs, "configSha256": hashes[0], "policySha256": hashes[1], "runClock": iso(clock)})
    return Task(run_id, *hashes, inputs, config, policy, clock, tables)


def run(task: Task) -> Evaluation:
    ws, run_id = task.config["workspaceId"], task.audit_run_id
    found = staged(verdicts(task.tables, task.config, task.policy, task.clock), "verdicts")
    findings = staged(with_all_refs(found.where("disposition = 'eligible'"), scoped_references(task.tables)), "findings")
    return Evaluation(run_id, task.config_sha256, task.policy_sha256, task.input_set_sha256, task.clock, found, results(findings, task.config, ws, run_id), _others(found, "blocked", ws, run_id), _others(found, "review_only", ws, run_id))


def evaluate(tables: dict[str, DataFrame], config: Any, policy: Any, clock: str | datetime) -> Evaluation:
    """Evaluate one workspace at a clock."""
    return run(prepare(tables, config, policy, clock))


def with_all_refs(found: DataFrame, scoped: DataFrame) -> DataFrame:
    """Candidates with ``own_refs`` made all references they rest on, in order; a published finding lists them one by one."""
    each = scoped.select("latest_organization_id", "ref", F.explode("scope").alias("one"))
    met = found.select("relationship_edge_id", "latest_organization_id", F.explode("organization_scopes").alias("one")).join(each, ["latest_organization_id", "one"])
    met = met.groupBy("relationship_edge_id").agg(F.collect_set("ref").alias("claimed"))
    made = found.join(met, "relationship_edge_id", "left")
    return made.withColumn("own_refs", F.array_sort(F.array_union("own_refs", F.coalesce("claimed", F.array().cast("array<string>"))))).drop("claimed")


def results(found: DataFrame, config: dict[str, Any], ws: str, run_id: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The findings among ``found``, whose evidence is ``own_refs``; with the columns ``also``."""
    broker = F.col("category").isin("C", "D")
    identity = json_object({"auditRunId": F.lit(f'"{run_id}"'), "category": json_string(F.col("category")), "destinationPersonId": json_string(F.col("person_id")), "canonicalAccountId": json_string(F.col("organization_id")), "relationshipEdgeId": F.when(broker, json_string(F.col("relationship_edge_id"))).otherwise("null")})
    label = F.when(F.col("category") == "A", "potential_direct_icp_lead").when(F.col("category") == "B", "target_account_coach_champion_candidate").when(F.col("category") == "C", "broker_path_to_target_stakeholder").otherwise("broker_path_to_target_account_coach_champion_candidate")
    dependencies = F.struct(
        F.array_sort(F.array_distinct(F.concat("contributor_ids", F.array("contributor_id")))).alias("contributor_ids"), F.array_sort(F.array_distinct(F.concat("consent_ids", F.array("consent_record_id")))).alias("consent_record_ids"), F.col("snapshot_ids").alias("source_snapshot_ids"),
        F.col("own_refs").alias("evidence_ref_ids"), F.when(broker, F.array("relationship_edge_id")).otherwise(F.array().cast("array<string>")).alias("relationship_edge_ids"), F.lit("invalidate_entire_result").alias("mixed_source_rule"),
    )
    names = ("account_fit", "persona_fit", "relationship_confidence", "employment_confidence", "path_confidence", "freshness", "review_priority")
    made = found.where("disposition = 'eligible'").select(
        F.lit(ws).alias("workspace_id"), F.lit(run_id).alias("audit_run_id"), scoped_id_column(ws, "coverage_result", identity).alias("result_id"), "category", F.col("person_id").alias("destination_person_id"), F.col("organization_id").alias("canonical_account_id"), "persona_outcome", label.alias("candidate_label"),
        F.when(broker, F.col("contributor_id")).alias("broker_contributor_id"), F.when(broker, F.col("relationship_edge_id")).alias("relationship_edge_id"), dependencies.alias("dependencies"), F.struct(*names).alias("scores"),
        eligible_codes(config).alias("reason_codes"), F.col("own_refs").alias("evidence_refs"), F.lit("active").alias("consent_disposition"), F.lit("clear").alias("suppression_status"), F.col("relationship_edge_id").alias("edge"), *also,
    )
    # two direct edges to one person are one finding: the last edge, in dictionary order, is kept
    last = Window.partitionBy("result_id").orderBy(F.desc(in_dictionary_order("edge")))
    made = made.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank", "edge")
    return in_result_order(made)


def in_result_order(made: DataFrame) -> DataFrame:
    return made.orderBy("category", F.desc("scores.review_priority"), in_dictionary_order("canonical_account_id"), in_dictionary_order("destination_person_id"), F.collate(F.coalesce("broker_contributor_id", F.lit("")), _ORDER), in_dictionary_order("result_id"))


def _others(found: DataFrame, disposition_: str, ws: str, run_id: str) -> DataFrame:
    identity = json_object({"auditRunId": F.lit(f'"{run_id}"'), "category": json_string(F.col("category")), "edge": json_string(F.col("relationship_edge_id")), "employment": json_string(F.col("employment_claim_id"))})
    made = found.where(F.col("disposition") == disposition_).select(scoped_id_column(ws, "candidate", identity).alias("candidate_id"), "category", F.col("person_id").alias("destination_person_id"), "reason_codes")
    return in_candidate_order(made)


def in_candidate_order(made: DataFrame) -> DataFrame:
    return made.orderBy("category", in_dictionary_order("destination_person_id"), in_dictionary_order("candidate_id"))
