"""Every query by name, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweft.config import read_config, read_policy
from kinweft.functions import digest, scalars
from kinweft.operators import adapters, claims, consent, display, employment, evaluate, governance, rules
from kinweft.plans import ingest, oracle, scans, workload
from kinweft.session import staged

Query = Callable[[SparkSession, str], DataFrame]


def _workspace(spark: SparkSession, sf_dir: str, written: bool = False):
    return workload.tables(spark, sf_dir, written), read_config(workload.config(workload.suppliers(spark, sf_dir))), read_policy(workload.POLICY), workload.clock()


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdicts(*_workspace(spark, sf_dir, written=True)).withColumnRenamed("relationship_edge_id", "edge")


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    return _referenced_results(spark, sf_dir)[:2]


def _referenced_results(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    tables, config, policy, clock = _workspace(spark, sf_dir, written=True)
    # only findings are results, so the other candidates are not written
    found, references = evaluate.judged(tables, config, policy, clock, also)
    found = staged(found.where("disposition = 'eligible'"), "verdicts")
    # what the claims of organizations add to a finding's evidence is the same for very many, and named by its scopes
    results = evaluate.results(found, config, workload.WORKSPACE, "audit_run_star", ("latest_organization_id", "organization_scopes"))
    return results.withColumn("edge", F.concat(F.lit("e"), F.substring(F.filter("evidence_refs", lambda r: r.startswith("er"))[0], 3, 99))), tables, references


SCORES = ("account_fit", "persona_fit", "relationship_confidence", "employment_confidence", "path_confidence", "freshness", "review_priority")


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation: every candidate's class, disposition, reasons and scores."""
    return _verdicts(spark, sf_dir).select("edge", "category", "disposition", F.array_join("reason_codes", "|").alias("reason_codes"), *SCORES)


def latest_employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.latest_employment(workload.tables(spark, sf_dir)["employment_claim"], workload.clock(), 365)
    return made.select("person_id", "employment_claim_id", "organization_id", F.col("current_organizations").cast("long").alias("current_organizations"))


def consent_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.tables(spark, sf_dir)["consent"].select("consent_record_id", consent.disposition(workload.clock()).alias("disposition"))


def eligible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = workload.tables(spark, sf_dir)
    return consent.eligible_edges(t["relationship_edge"], t["consent"], workload.clock()).select("relationship_edge_id", "consent_record_id")


_RULES = {
    "equals": ("title", "1-Urgent"), "in": ("geography", ["r0", "R2"]), "not_in": ("geography", ["r0", "r2"]), "contains_token": ("title", ["high", "specified"]), "range": ("employee_count", {"min": 5, "max": 15}), "exists": ("title", True),
}


def _rule(operator: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, config, _, clock = _workspace(spark, sf_dir)
        field, value = _RULES[operator]
        people = evaluate.latest_employment(tables["employment_claim"], clock, 365).join(F.broadcast(evaluate.accounts(spark, config)), "organization_id", "left")
        attr = rules.text_attribute(F.col("title")) if field == "title" else F.col(f"attr_{field}")
        return people.select("person_id", rules.matches({"operator": operator, "value": value}, attr).alias("matched"))

    return query


def rule_set_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, config, _, clock = _workspace(spark, sf_dir)
    used = evaluate.latest_employment(tables["employment_claim"], clock, 365).join(tables["relationship_edge"].select(F.col("destination_person_id").alias("person_id")), "person_id", "left_semi").select("organization_id").distinct()
    found = used.join(F.broadcast(evaluate.accounts(spark, config)), "organization_id", "left")
    fit = rules.evaluate(config["icpRuleSet"], {f: F.col(f"attr_{f}") for f in ("geography", "employee_count")})
    return found.withColumn("fit", fit).select("organization_id", "fit.matched", F.col("fit.score").alias("score"), *[F.array_join(F.col("fit")[c], "|").alias(c) for c in ("matched_rule_ids", "failed_rule_ids")])


def persona_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, config, _, clock = _workspace(spark, sf_dir)
    people = evaluate.latest_employment(tables["employment_claim"], clock, 365)
    fit = rules.evaluate(config["stakeholderPersonaRuleSet"], {"title": rules.text_attribute(F.col("title"))})
    return people.withColumn("fit", fit).select("person_id", rules.persona_outcome(F.col("fit"), config["scoring"]).alias("outcome"))


def category_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, config, _, clock = _workspace(spark, sf_dir)
    return evaluate.candidates(tables, config, clock).select(F.col("relationship_edge_id").alias("edge"), "category")


def identity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluate.identity_summary(workload.tables(spark, sf_dir)["identity_claim"])
    return made.select("person_id", "identity_confidence", "identity_conflicted", F.size("identity_refs").alias("n_refs"))


def organization_claims_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, config, policy, clock = _workspace(spark, sf_dir, written=True)
    found, references = evaluate.scoped_candidates(tables, config, policy, clock, whole=False)
    found = found.where(F.size("organization_scopes") > 0).select("relationship_edge_id", "latest_organization_id", "organization_scopes", "organization_conflicted")
    found = staged(found, "candidates")
    blocks = staged(evaluate.scoped_references(tables, references).groupBy("latest_organization_id", "scope").agg(F.count("*").alias("n")), "blocks")
    counted = evaluate.over_scopes(found, blocks, F.sum("n").alias("n_refs"))
    return found.join(counted, ["latest_organization_id", "organization_scopes"]).select(F.col("relationship_edge_id").alias("edge"), "n_refs", F.col("organization_conflicted").alias("conflicted"))


def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"n_snapshots": "snapshot_ids", "n_contributors": "contributor_ids", "n_kinds": "source_kinds"}
    return _verdicts(spark, sf_dir).select("edge", *[F.size(c).cast("long").alias(k) for k, c in sizes.items()])


def evidence_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where(F.array_contains("reasons", "DEPENDENCY_EVIDENCE_INCOMPLETE")).select("edge")


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select(F.explode("reasons").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def disposition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("category", "disposition").agg(F.count("*").alias("n"))


def suppression_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, config, _, clock = _workspace(spark, sf_dir)
    return consent.suppressions(tables["suppression_rule"], config, clock)


def suppression_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, config, _, clock = _workspace(spark, sf_dir)
    bad = consent.suppressions(tables["suppression_rule"], config, clock).where("kind = 'person'")
    return tables["person"].join(bad, F.lower("person_id") == F.col("value"), "left_anti").select("person_id")


def _score(name: str) -> Query:
    return lambda spark, sf_dir: _verdicts(spark, sf_dir).select("edge", name)


def ordered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _results(spark, sf_dir)
    counted = found.groupBy("category", F.col("scores.review_priority").alias("review_priority")).agg(F.count("*").alias("n"))
    # ranks within a class, shifted by the classes before it: at most 404 rows here, one for each class and priority
    return counted.withColumn("rank", F.dense_rank().over(Window.orderBy("category", F.desc("review_priority"))).cast("long"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.category_counts(_results(spark, sf_dir)[0])


def account_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.account_coverage(_results(spark, sf_dir)[0]).withColumn("categories", F.array_join("categories", "|"))


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, tables, references = _referenced_results(spark, sf_dir, ("claim_type",))
    found = staged(found, "results")
    made = display.evidence_summary(found, tables, evaluate.scoped_references(tables, references), references).join(found.select("result_id", "edge"), "result_id")
    return made.select("edge", "evidence_count", F.size("claim_types").cast("long").alias("n_claim_types"))


def display_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results still visible after the consents of every thirteenth contributor were withdrawn."""
    found, tables = _results(spark, sf_dir)
    config = read_config(workload.config(workload.suppliers(spark, sf_dir)))
    gone = F.substring("contributor_id", 2, 20).cast("long") % 13 == 1
    tables = tables | {"consent": tables["consent"].withColumn("status", F.when(gone, "withdrawn").otherwise(F.col("status")))}
    return display.visible(found, tables, config, workload.PURPOSE, workload.clock()).select("edge")


def export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, tables = _results(spark, sf_dir)
    return display.exportable(found, tables["consent"]).select("edge")


def withdrawal_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges and results that go when the second contributor withdraws."""
    found, tables = _results(spark, sf_dir)
    gone = governance.withdrawal_dependants(tables | {"coverage_result": found}, "k2")
    return gone["relationship_edge"].select("relationship_edge_id").unionByName(gone["coverage_result"].where("not startswith(edge, 'e2_')").select(F.col("edge").alias("relationship_edge_id")))


def employment_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employment.conflicts(workload.tables(spark, sf_dir)["employment_claim"].withColumn("position", F.substring("employment_claim_id", 2, 20).cast("long")), "position").select("employment_claim_id")


def employment_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employment.disposition(workload.tables(spark, sf_dir)["employment_claim"], workload.clock()).select("employment_claim_id", "disposition")


def alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each organization is mapped when every fourth one has an approved alias of the one before it."""
    nation = workload.star(spark, sf_dir, "nation")
    keys = [r[0] for r in nation.select("n_nationkey").where("n_nationkey % 4 = 1").collect()]
    bound = {k: {"source_organization_id": f"o{k}", "canonical_organization_id": f"o{k - 1}", "alias_kind": "name", "alias_value": f"N{k}"} for k in keys}
    config = {"approvedOrganizationAliases": [{"aliasId": f"a{k}", "organizationAliasCandidateId": f"z{k}", "organizationId": f"o{k - 1}", "sourceOrganizationId": f"o{k}", "kind": "name", "value": f"n{k}", "approvedReviewDecisionId": f"d{k}"} for k in keys]}
    at = "2001-01-01T00:00:00.000Z"
    candidates = [{"organization_alias_candidate_id": f"z{k}", "proposed_organization_id": f"o{k}", "alias_kind": "name", "alias_value": f"N{k}", "conflict_organization_ids": [f"o{k - 1}"], "status": "approved", "approved_canonical_organization_id": f"o{k - 1}"} for k in keys]
    decisions = [{"review_decision_id": f"d{k}", "subject_type": "organization_alias", "subject_id": f"z{k}", "actor_id": "a", "decision": "approve", "reason": "same", "decided_at": at, "prior_state": "pending", "organization_alias_authorization": v} for k, v in bound.items()]
    from kinweft.sources.demo import frames

    t = frames(spark, {"organization_alias_candidate": candidates, "review_decision": decisions})
    alias = consent.authorized_aliases(t["organization_alias_candidate"], t["review_decision"], config, workload.clock()).select("source_organization_id", F.col("organization_id").alias("mapped"))
    made = nation.select(F.concat(F.lit("o"), F.col("n_nationkey")).alias("source_organization_id")).join(F.broadcast(alias), "source_organization_id", "left")
    return made.select("source_organization_id", F.coalesce("mapped", "source_organization_id").alias("organization_id"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workload.star(spark, sf_dir, "lineitem").select(F.sha2(F.concat_ws("\n", "l_orderkey", "l_linenumber"), 256).alias("group_digest"), "l_partkey")
    return claims.duplicate_groups(rows, "group_digest", "l_partkey").withColumnRenamed("l_partkey", "first_row")


def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = digest.json_object({"event_type": digest.json_string(F.col("event_type")), "user_id": F.col("user_id").cast("string")})
    return workload.star(spark, sf_dir, "events").select("event_id", digest.sha256(body).alias("digest"))


def claim_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = workload.star(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return claims.fan_out(people, ["c_custkey"], {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string")})


def evidence_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.evidence_kinds(workload.star(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("record")))


def anchor_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    keys = {"provider_person_id": F.when(k % 5 == 0, k), "crm_contact_id": F.when(k % 5 <= 1, k), "profile_url": F.when(k % 5 <= 2, k)}
    email = F.when(k % 5 == 3, F.when(k % 2 == 0, F.concat(F.lit("ann"), k, F.lit("@corp.example"))).otherwise("team@corp.example"))
    return workload.star(spark, sf_dir, "customer").select("c_custkey", claims.anchor({n: c.cast("string") for n, c in keys.items()}, email).alias("anchor"))


def email_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    local = F.element_at(F.array(*[F.lit(x) for x in scalars.SHARED_MAILBOXES], F.lit("ann"), F.lit("bob")), (k % 10 + 1).cast("int"))
    domain = F.when(k % 6 == 0, scalars.FREE_MAIL_DOMAINS[0]).otherwise("corp.example")
    return workload.star(spark, sf_dir, "customer").select("c_custkey", scalars.email_risk(F.concat(local, F.lit("@"), domain)).alias("risk"))


def domain_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.star(spark, sf_dir, "pages").select("page_id", scalars.normalize_domain(F.col("url")).alias("domain"))


def formula_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(F.lit("="), F.lit("  +"), F.lit("\t"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return workload.star(spark, sf_dir, "documents").select("doc_id", scalars.neutralize_formula(F.concat(start, F.col("lang"))).alias("cell"))


def terminal_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.star(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.escape_terminal(F.col("text")).alias("text"))


def adapter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workload.star(spark, sf_dir, "events").select(F.col("event_id").alias("record"), "user_id", "event_type")
    return adapters.deduplicate(events, ["user_id", "event_type"], "record").withColumnRenamed("record", "first_record")


def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a hundred events."""
    return workload.star(spark, sf_dir, "events").select("event_id").orderBy("event_id").offset(200).limit(100)


def input_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of input entities and an order-free digest of them."""
    return spark.createDataFrame([(workload.WORKSPACE, evaluate.input_set_fingerprint(workload.tables(spark, sf_dir, written=True), workload.WORKSPACE))], "workspace_id string, fingerprint string")


def queries() -> dict[str, Query]:
    names = (
        coverage_audit, latest_employment, consent_disposition, eligible_edges, rule_set_score, persona_outcome, category_classify, identity_summary, organization_claims_in_scope, dependency_closure, evidence_incomplete, gate_reasons, disposition_split, suppression_union, suppression_anti,
        ordered_results, category_counts, account_coverage, evidence_summary, display_revalidation, export_filter, withdrawal_cascade, employment_conflict, employment_disposition, alias_mapping, duplicate_groups, row_digest, claim_fanout, evidence_fanout, anchor_selection, email_risk,
        domain_normalize, formula_neutralize, terminal_escape, adapter_dedup, page_slice, input_fingerprint,
    )
    made = {f.__name__: f for f in names} | ingest.queries() | scans.queries() | {f"rule_{k}": _rule(k) for k in _RULES}
    return made | {name: _score(column) for name, column in (("path_confidence", "path_confidence"), ("freshness_score", "freshness"), ("review_priority", "review_priority"))}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | ingest.SQL | scans.SQL
