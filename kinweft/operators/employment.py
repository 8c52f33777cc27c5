"""Employment claims against each other: conflicts within a year, and what a claim is worth at a clock.

Both are windows over a person's claims in time.  A range frame replaces the join of a person's claims with one
another, so a person with very many claims costs a sort, not a square.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.functions.scalars import age_days
from kinweft.operators.consent import at

YEAR_MS = 365 * 86_400_000


def _millis() -> Column:
    return F.unix_millis(F.try_to_timestamp("observed_at"))


def _conflict() -> Column:
    near = Window.partitionBy("workspace_id", "person_id").orderBy(_millis()).rangeBetween(-YEAR_MS, YEAR_MS)
    current = F.when(F.col("state") == "current", F.col("organization_id"))
    low, high = F.min(current).over(near), F.max(current).over(near)
    return F.coalesce((low != F.col("organization_id")) | (high != F.col("organization_id")), F.lit(False))


def conflicts(claims: DataFrame, order: str) -> DataFrame:
    """The claims that came after a current claim of the same person at another organization within 365 days of them.

    ``order`` is the column in whose order claims came; those with equal order came together.  A range frame finds
    the claims that have such a claim at all, which are few; only these are held against their person's claims.
    If claims tell which ``file`` they came from, those of another file count only if they were ``kept``.
    """
    maybe = claims.withColumn("__conflict", _conflict()).where("__conflict").drop("__conflict")
    theirs = claims.where("state = 'current'").select("workspace_id", "person_id", F.col("organization_id").alias("__organization"), _millis().alias("__at"), F.col(order).alias("__order"), *[F.col(c).alias(f"__{c}") for c in ("file", "kept") if c in claims.columns])
    same = [maybe[c] == theirs[c] for c in ("workspace_id", "person_id")]
    near = (maybe["organization_id"] != theirs["__organization"]) & (theirs["__order"] < maybe[order]) & (F.abs(F.unix_millis(F.try_to_timestamp(maybe["observed_at"])) - theirs["__at"]) <= YEAR_MS)
    if "file" in claims.columns:
        near &= theirs["__kept"] | (theirs["__file"] == maybe["file"])
    return maybe.join(theirs, [*same, near], "left_semi")


def disposition(claims: DataFrame, clock: datetime) -> DataFrame:
    """``claims`` with ``disposition``: ended, in conflict, current, up for review, or stale at the clock."""
    person = Window.partitionBy("workspace_id", "person_id")
    ended = F.max(F.when(F.col("state") == "ended", _millis())).over(person) >= _millis()
    age = age_days(at(clock), F.try_to_timestamp("observed_at"))
    made = (
        F.when((F.col("state") == "ended") | F.coalesce(ended, F.lit(False)), "blocked_ended")
        .when(_conflict(), "blocked_conflict")
        .when(age.isNull() | (age < 0) | (F.col("state") == "unknown"), "stale")
        .when(age <= 365, "potentially_current")
        .when(age <= 730, "review_only")
        .otherwise("stale")
    )
    return claims.withColumn("disposition", made)
