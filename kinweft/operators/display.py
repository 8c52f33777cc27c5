"""What a reader may see of a run: re-validation at the display clock, redaction, aggregates and renderings."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import ConfigError, instant, read_config
from kinweft.functions.digest import camel
from kinweft.functions.scalars import csv_cell, terminal_safe
from kinweft.operators.consent import disposition, suppressions
from kinweft.operators.evaluate import ENGINE_VERSION, Evaluation, in_dictionary_order, over_scopes
from kinweft.session import staged

# Wordings and columns of the published report format.
CAVEAT = "Results are hypotheses for human review, not permission to contact."
DEFINITIONS = {
    "A": "Direct deterministic ICP and stakeholder match",
    "B": "Direct named-target review-pending coach/champion candidate, not proven influence or warmth",
    "C": "Consented broker path to a deterministic named-target stakeholder",
    "D": "Consented broker path to a named-target review-pending coach/champion candidate, not proven influence or warmth",
}
PENDING_LABEL = "review-pending coach/champion candidate"
SCORE_NOTE = "Review ordering only; not relationship strength, influence, or permission to contact"
WITHHELD, PROVENANCE = "broker identity and exact edge withheld", "locally imported, user-provided source snapshots"
CSV_COLUMNS = ("result_id", "category", "category_definition", "candidate_label", "destination_person_id", "destination_name", "account_id", "account_name", "persona_outcome", "review_status", "review_priority", "reason_codes", "consent_status", "suppression_status", "evidence_count", "source_kinds", "broker_disclosure", "caveat")


def in_report_order(results: DataFrame) -> DataFrame:
    return results.orderBy("category", F.desc("scores.review_priority"), in_dictionary_order("canonical_account_id"), in_dictionary_order("destination_person_id"), F.collate(F.coalesce("broker_contributor_id", F.lit("")), "UNICODE"), in_dictionary_order("result_id"))


def visible(results: DataFrame, tables: dict[str, DataFrame], config: dict[str, Any], purpose: str, clock: datetime) -> DataFrame:
    """The results that still hold at the clock.

    A result goes if its person, account or class is suppressed now, or if any snapshot it rests on is gone or
    suppressed, or no longer covered by an active consent of an active contributor for this purpose and class.
    """
    active = suppressions(tables["suppression_rule"], config, clock)
    bad = {k: active.where(F.col("kind") == k).select(F.col("value").alias(f"bad_{k}")).distinct() for k in ("person", "organization", "category", "source", "snapshot")}
    for column, kind in (("destination_person_id", "person"), ("canonical_account_id", "organization"), ("category", "category")):
        results = results.join(bad[kind], F.lower(column) == F.col(f"bad_{kind}"), "left_anti")
    snapshots = tables["source_snapshot"].select(F.col("source_snapshot_id").alias("snapshot"), F.col("contributor_id").alias("by_contributor"), F.col("consent_record_id").alias("by_consent"), "source_kind")
    snapshots = snapshots.join(bad["source"], F.lower("source_kind") == F.col("bad_source"), "left_anti").join(bad["snapshot"], F.lower("snapshot") == F.col("bad_snapshot"), "left_anti")
    consents = tables["consent"].where((disposition(clock) == "active") & (F.col("purpose_id") == purpose)).select(F.col("consent_record_id").alias("by_consent"), F.col("contributor_id").alias("by_contributor"), "allowed_categories", "source_classes")
    people = tables["contributor"].where("status = 'active'").select(F.col("contributor_id").alias("by_contributor"))
    good = snapshots.join(consents, ["by_consent", "by_contributor"]).join(people, "by_contributor", "left_semi").where(F.array_contains("source_classes", F.col("source_kind"))).select("snapshot", "allowed_categories")
    needed = results.select("result_id", "category", F.explode("dependencies.source_snapshot_ids").alias("snapshot"))
    broken = needed.join(good, "snapshot", "left").where(F.col("allowed_categories").isNull() | ~F.array_contains("allowed_categories", F.col("category"))).select("result_id").distinct()
    return results.join(broken, "result_id", "left_anti")


def exportable(results: DataFrame, consents: DataFrame) -> DataFrame:
    """The results all of whose consents allow a sanitized export."""
    allowed = consents.where("sanitized_export_allowed").select(F.col("consent_record_id").alias("id"))
    needed = results.select("result_id", F.explode("dependencies.consent_record_ids").alias("id"))
    return results.join(needed.join(allowed, "id", "left_anti").select("result_id").distinct(), "result_id", "left_anti")


def evidence_summary(results: DataFrame, tables: dict[str, DataFrame], scoped: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(result_id, evidence_count, claim_types, source_kinds, observed_at) of each result's evidence.

    With ``scoped`` (:func:`kinweft.operators.evaluate.scoped_references`), results name what the claims of their
    organization add by ``latest_organization_id`` and ``organization_scopes``; it is summed up for each occurring set
    of scopes.  ``references`` (:func:`kinweft.operators.evaluate.look_up`, with ``claim_type``) may say what is looked up
    of these claims' evidence already.
    """
    refs = tables["evidence_ref"].select(F.col("evidence_ref_id").alias("ref"), "claim_type", F.col("source_snapshot_id").alias("snapshot"))
    snapshots = tables["source_snapshot"].select(F.col("source_snapshot_id").alias("snapshot"), "source_kind", F.coalesce("source_observed_at", "imported_at").alias("seen"))
    sets = {"claim_types": "claim_type", "source_kinds": "source_kind", "observed_at": "seen"}
    found = [F.count("*").alias("evidence_count"), *[F.collect_set(c).alias(k) for k, c in sets.items()]]
    own = results.select("result_id", F.explode("evidence_refs").alias("ref"), *([] if scoped is None else ["latest_organization_id", "organization_scopes"]))
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in sets]
    total = [F.sum("evidence_count").alias("evidence_count"), *merged]
    if scoped is None:
        return own.join(refs, "ref").join(snapshots, "snapshot", "left").groupBy("result_id").agg(found[0], *[F.array_sort(c).alias(k) for k, c in zip(sets, found[1:], strict=True)])
    scoped, sets_of = staged(scoped, "scoped"), ["latest_organization_id", "organization_scopes"]
    # a reference of the result's own that is in one of its scopes counts there
    inside = scoped.select(F.col("latest_organization_id").alias("__organization"), F.col("ref").alias("__ref"), "scope")
    own = own.join(inside, (F.col("ref") == F.col("__ref")) & (F.col("latest_organization_id") == F.col("__organization")) & F.arrays_overlap("scope", "organization_scopes"), "left_anti")
    snapshots = staged(snapshots, "snapshots")
    claims = refs if references is None else references.where("owner = 'claim' and held").select("ref", "claim_type", "snapshot").distinct()
    own = own.select("result_id", "ref").join(refs, "ref").join(snapshots, "snapshot", "left").groupBy("result_id").agg(*found)
    blocks = staged(scoped.join(claims, "ref").join(snapshots, "snapshot", "left").groupBy("latest_organization_id", "scope").agg(*found), "blocks")
    claimed = results.select("result_id", *sets_of).join(over_scopes(results, blocks, *total), sets_of).drop(*sets_of)
    return own.unionByName(claimed).groupBy("result_id").agg(*total)


def category_counts(results: DataFrame) -> DataFrame:
    """(category, n) for all four classes."""
    spine = results.sparkSession.createDataFrame([(c,) for c in DEFINITIONS], "category string")
    return spine.join(results.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def account_coverage(results: DataFrame) -> DataFrame:
    """(organization_id, categories, finding_count) of each account with findings."""
    return results.groupBy(F.col("canonical_account_id").alias("organization_id")).agg(F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("finding_count"))


def findings(results: DataFrame, tables: dict[str, DataFrame], view: str) -> DataFrame:
    """One row for each finding, named and redacted for a view (``safe`` or ``reviewer``)."""
    disclosed = tables["consent"].where("broker_disclosure = 'authorized_reviewers'").select(F.col("consent_record_id").alias("id"))
    hidden = results.select("result_id", F.explode("dependencies.consent_record_ids").alias("id")).join(disclosed, "id", "left_anti").select("result_id", F.lit(True).alias("hidden")).distinct()
    names = tables["person"].select(F.col("person_id").alias("destination_person_id"), "display_name")
    accounts = tables["organization"].select(F.col("organization_id").alias("canonical_account_id"), "canonical_name")
    made = results.join(names, "destination_person_id", "left").join(accounts, "canonical_account_id", "left").join(evidence_summary(results, tables), "result_id", "left").join(hidden, "result_id", "left")
    review, broker = F.col("category").isin("B", "D"), F.col("category").isin("C", "D")
    definition = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in DEFINITIONS.items()])
    shown = broker & F.lit(view == "reviewer") & F.col("hidden").isNull()
    return made.select(
        "result_id", "category", definition.alias("category_definition"), F.when(review, PENDING_LABEL).otherwise(F.replace(F.col("candidate_label"), F.lit("_"), F.lit(" "))).alias("candidate_label"),
        "destination_person_id", F.coalesce("display_name", "destination_person_id").alias("destination_name"), F.col("canonical_account_id").alias("account_id"), F.coalesce("canonical_name", "canonical_account_id").alias("account_name"), "persona_outcome",
        F.when(review, "pending").otherwise("not_required").alias("review_status"), F.col("scores.review_priority").alias("review_priority"), "scores", F.array_sort("reason_codes").alias("reason_codes"), F.col("consent_disposition").alias("consent_status"), "suppression_status",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("claim_types", "source_kinds", "observed_at")], "dependencies",
        F.when(shown, "authorized_reviewer_only").when(broker, WITHHELD).otherwise("not_applicable").alias("broker_disclosure"), F.when(shown, F.col("broker_contributor_id")).alias("broker_contributor_id"), F.when(shown, F.col("relationship_edge_id")).alias("broker_edge_id"), F.lit(CAVEAT).alias("caveat"),
    )


def csv_lines(found: DataFrame) -> DataFrame:
    """(line) of each finding: all cells quoted and harmless to spreadsheets, lists joined by ``|``."""
    kinds = dict(found.dtypes)
    cells = [csv_cell(F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c).cast("string")) for c in CSV_COLUMNS]
    return found.select(F.concat_ws(",", *cells).alias("line"))


def report(run: Evaluation, tables: dict[str, DataFrame], config: Any, at: str, view: str = "safe", results: DataFrame | None = None) -> dict[str, Any]:
    """The coverage report of a run at a display clock, as plain data.  A report is read by people, so it is small."""
    if view not in ("safe", "reviewer"):
        raise ConfigError("VIEW_INVALID")
    config = read_config(config)
    ws = config["workspaceId"]
    tables = {k: v.where(F.col("workspace_id") == ws) for k, v in schemas.complete(tables, run.results.sparkSession).items()}
    purpose = tables["workspace"].first()["purpose_id"]
    stored = run.results if results is None else results
    seen = exportable(visible(stored, tables, config, purpose, instant(at)), tables["consent"])
    rows = in_report_order_of(findings(seen, tables, view)).collect()
    totals = {r["category"]: r["n"] for r in category_counts(seen).collect()}
    names = {r["account_id"]: r["account_name"] for r in rows}
    covered = sorted(account_coverage(seen).collect(), key=lambda r: r["organization_id"])
    safe = view == "safe"
    others = {k: [{**r.asDict(), "reason_codes": sorted(r["reason_codes"]), "disposition": k} for r in df.collect()] for k, df in (("blocked", run.blocked), ("review_only", run.review_only))}
    return {
        "schema_version": "0.2.0", "generated_at": at, "workspace_id": ws, "audit_run_id": run.audit_run_id, "engine_version": ENGINE_VERSION,
        "hashes": {"input_set_sha256": run.input_set_sha256, "config_sha256": run.config_sha256, "policy_sha256": run.policy_sha256},
        "view": view, "caveat": CAVEAT, "category_definitions": DEFINITIONS,
        "summary": {"eligible_total": len(rows), "categories": {c: totals[c] for c in DEFINITIONS}, "blocked_total": len(others["blocked"]), "review_only_total": len(others["review_only"]), "display_invalidated_total": stored.count() - len(rows)},
        "account_coverage": [{"organization_id": r["organization_id"], "canonical_name": names[r["organization_id"]], "categories": r["categories"], "finding_count": r["finding_count"]} for r in covered],
        "findings": [_finding(r, safe) for r in rows], **others,
        "sanitization": {
            "profile": "safe-export-v1" if safe else "authorized-reviewer-v1", "broker_identities_redacted": safe, "exact_relationship_edges_redacted": safe, "contributor_emails_included": False, "raw_rows_included": False, "private_source_metadata_included": False,
            "credentials_included": False, "portable_edge_list_included": False, "guessed_relationship_strength_included": False, "current_display_policy_revalidated": True,
        },
    }


def in_report_order_of(found: DataFrame) -> DataFrame:
    return found.orderBy("category", F.desc("review_priority"), in_dictionary_order("account_id"), in_dictionary_order("destination_person_id"), F.collate(F.coalesce("broker_contributor_id", F.lit("")), "UNICODE"), in_dictionary_order("result_id"))


def _finding(r: Any, safe: bool) -> dict[str, Any]:
    d = r["dependencies"]
    if safe:
        rests_on = {"consent_dependency_count": len(d["consent_record_ids"]), "source_snapshot_dependency_count": len(d["source_snapshot_ids"]), "evidence_dependency_count": len(d["evidence_ref_ids"]), "relationship_dependency_present": bool(d["relationship_edge_ids"]), "identifiers_redacted": True}
    else:
        rests_on = {c: d[c] for c in ("consent_record_ids", "source_snapshot_ids", "evidence_ref_ids", "contributor_ids", "relationship_edge_ids")}
    made = {
        **{c: r[c] for c in ("result_id", "category", "category_definition", "candidate_label")}, "destination": {"person_id": r["destination_person_id"], "display_name": r["destination_name"]}, "account": {"organization_id": r["account_id"], "canonical_name": r["account_name"]},
        **{c: r[c] for c in ("persona_outcome", "review_status", "review_priority")}, "score_interpretation": SCORE_NOTE, "component_scores": {camel(k): v for k, v in r["scores"].asDict().items()}, **{c: r[c] for c in ("reason_codes", "consent_status", "suppression_status")},
        "evidence": {**{c: r[c] for c in ("evidence_count", "claim_types", "source_kinds", "observed_at")}, "provenance": PROVENANCE}, "dependencies": rests_on,
    }
    if r["category"] in "CD":
        open_ = r["broker_disclosure"] == "authorized_reviewer_only"
        made["broker"] = {"contributor_id": r["broker_contributor_id"], "relationship_edge_id": r["broker_edge_id"], "disclosure": r["broker_disclosure"]} if open_ else {"redacted": True, "disclosure": WITHHELD}
    return made


def to_json(made: dict[str, Any]) -> str:
    return json.dumps(made, indent=2, ensure_ascii=False) + "\n"


def to_csv(found: DataFrame) -> str:
    """The CSV of findings in report order, for a report that one person reads."""
    lines = [r["line"] for r in csv_lines(in_report_order_of(found)).collect()]
    return "\n".join([",".join(f'"{c}"' for c in CSV_COLUMNS), *lines]) + "\n"


def to_terminal(made: dict[str, Any], title: str = "CONTACT NETWORK AUDIT") -> str:
    total, safe = made["summary"], terminal_safe
    counts = " ".join(f"{k}:{v}" for k, v in total["categories"].items())
    lines = [title, f"Run: {safe(made['audit_run_id'])}", f"Clock: {safe(made['generated_at'])}", CAVEAT, f"Eligible: {total['eligible_total']}  {counts}"]
    lines += [f"Blocked: {total['blocked_total']}  Review-only: {total['review_only_total']}  Display-invalidated: {total['display_invalidated_total']}", ""]
    for f in made["findings"]:
        lines.append(f"[{f['category']}] {safe(f['candidate_label'])} | {safe(f['destination']['display_name'])} | {safe(f['account']['canonical_name'])} | review priority {f['review_priority']}")
        lines.append(f"    reasons: {', '.join(map(safe, f['reason_codes']))}")
        lines.append(f"    provenance: {', '.join(map(safe, f['evidence']['source_kinds']))} ({f['evidence']['evidence_count']} evidence refs)")
    for key, head in (("blocked", "BLOCKED NEAR-MISSES"), ("review_only", "REVIEW-ONLY NEAR-MISSES")):
        if made[key]:
            lines += ["", head, *(f"[{x['category']}] {safe(x['destination_person_id'])}: {', '.join(map(safe, x['reason_codes']))}" for x in made[key])]
    return "\n".join(lines)
