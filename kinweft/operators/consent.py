"""Consent, suppression and alias authorization."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.config import active_suppressions, folded, iso
from kinweft.functions.scalars import folded as folded_column
from kinweft.functions.scalars import nfkc


def at(clock: datetime) -> Column:
    return F.to_timestamp(F.lit(iso(clock)))


def disposition(clock: datetime, status: str = "status", granted: str = "granted_at", expires: str = "expires_at", withdrawn: str = "withdrawn_at") -> Column:
    """``withdrawn``, ``inactive``, ``not_yet_active``, ``expired`` or ``active``; the first that applies."""
    now = at(clock)
    return (
        F.when((F.col(status) == "withdrawn") | F.col(withdrawn).isNotNull(), "withdrawn")
        .when(F.col(status) != "active", "inactive")
        .when(now < F.try_to_timestamp(granted), "not_yet_active")
        .when(now >= F.try_to_timestamp(expires), "expired")
        .otherwise("active")
    )


def eligible_edges(edges: DataFrame, consents: DataFrame, clock: datetime) -> DataFrame:
    """The edges that may be used at all: eligible, under a consent that is active at the clock."""
    active = consents.where(disposition(clock) == "active").select("consent_record_id")
    return edges.where("eligible").join(active, "consent_record_id", "left_semi")


def suppressions(persisted: DataFrame, config: dict[str, Any], clock: datetime) -> DataFrame:
    """(kind, value, reason_code): stored rules, configured ones and exclusions that hold at the clock."""
    now = at(clock)
    held = persisted.where((F.try_to_timestamp("effective_at") <= now) & (F.col("expires_at").isNull() | (now < F.try_to_timestamp("expires_at"))))
    held = held.select("kind", F.lower("value").alias("value"), "reason_code")
    own = active_suppressions(config, clock)
    if own:
        held = held.unionByName(persisted.sparkSession.createDataFrame(own, "kind string, value string, reason_code string"))
    return held.distinct()


def authorized_aliases(candidates: DataFrame, decisions: DataFrame, config: dict[str, Any], clock: datetime) -> DataFrame:
    """(alias_id, position, source_organization_id, organization_id) of the configured aliases that a review approved.

    The candidate must be approved for just this organization, the decision must be an approval of it that says the
    same, made by the clock, and no later decision by the clock may say otherwise.
    """
    spark = candidates.sparkSession
    rows = [(i, x["aliasId"], x["organizationAliasCandidateId"], x["organizationId"], x["sourceOrganizationId"], x["kind"], folded(x["value"]), x["approvedReviewDecisionId"]) for i, x in enumerate(config["approvedOrganizationAliases"])]
    wanted = spark.createDataFrame(rows, "position int, alias_id string, candidate_id string, organization_id string, source_organization_id string, kind string, value string, decision_id string")
    now = at(clock)
    made = decisions.where((F.col("subject_type") == "organization_alias") & (F.try_to_timestamp("decided_at") <= now))
    other = made.where("decision <> 'approve'").groupBy(F.col("subject_id").alias("candidate_id")).agg(F.max(F.try_to_timestamp("decided_at")).alias("last_other"))
    said = F.col("organization_alias_authorization")
    approvals = made.where((F.col("decision") == "approve") & (F.col("prior_state") == "pending") & (F.col("actor_id") != "") & (F.trim("reason") != "") & said.isNotNull()).select(
        F.col("review_decision_id").alias("decision_id"), F.col("subject_id").alias("candidate_id"), F.try_to_timestamp("decided_at").alias("decided"),
        said["source_organization_id"].alias("said_source"), said["canonical_organization_id"].alias("said_canonical"), said["alias_kind"].alias("said_kind"), folded_column(nfkc(said["alias_value"])).alias("said_value"),
    )
    approved = candidates.where("status = 'approved'").select(
        F.col("organization_alias_candidate_id").alias("candidate_id"), "proposed_organization_id", "conflict_organization_ids", "approved_canonical_organization_id", "alias_kind", folded_column(nfkc(F.col("alias_value"))).alias("alias_value")
    )
    bound = wanted.join(approved, "candidate_id").join(approvals, ["candidate_id", "decision_id"]).join(other, "candidate_id", "left")
    ok = (
        (F.col("approved_canonical_organization_id") == F.col("organization_id")) & (F.col("proposed_organization_id") == F.col("source_organization_id")) & (F.col("alias_kind") == F.col("kind")) & (F.col("alias_value") == F.col("value"))
        & (F.col("said_source") == F.col("source_organization_id")) & (F.col("said_canonical") == F.col("organization_id")) & (F.col("said_kind") == F.col("kind")) & (F.col("said_value") == F.col("value"))
        & ((F.col("organization_id") == F.col("proposed_organization_id")) | F.array_contains("conflict_organization_ids", F.col("organization_id")))
        & (F.col("last_other").isNull() | (F.col("last_other") <= F.col("decided")))
    )
    return bound.where(ok).select("alias_id", "position", "source_organization_id", "organization_id")
