"""Who a row is: identity resolution in row order, within disjoint groups.

A row probes with one identifier, its anchor, so rows fall into groups of one (namespace, kind, value) that never
meet.  Within a group the outcome depends on how many people carried the value before: none is ``new``, one is
``exact``, several are ``review``.  The first two are running counts in a window, without Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAFE_KINDS = ("provider_id", "profile_url", "email")


def probe(incoming: DataFrame, existing: DataFrame, subject: str = "person_id", safe: tuple[str, ...] = SAFE_KINDS) -> DataFrame:
    """``incoming`` with ``outcome``, ``matches`` and ``signals`` against the claims that exist.

    Both have (workspace_id, namespace, kind, normalized); ``incoming`` also has ``risky``: whether the value may
    belong to several people.  Values compare within a workspace, namespace and kind only.
    """
    key = ["workspace_id", "namespace", "kind", "normalized"]
    known = existing.groupBy(*key).agg(F.array_sort(F.collect_set(subject)).alias("matches"))
    made = incoming.join(known, key, "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))
    sure = F.col("kind").isin(*safe) & ~F.coalesce("risky", F.lit(False))
    n = F.size("matches")
    outcome = F.when((n == 1) & sure, "exact").when((n > 0) | ~sure, "review").otherwise("new")
    signal = F.when(F.col("outcome") == "exact", F.concat(F.lit("exact_"), "kind")).when(n > 1, "identifier_collision").when(F.col("outcome") == "review", F.concat(F.lit("ambiguous_"), "kind"))
    return made.withColumn("outcome", outcome).withColumn("signals", F.array_compact(F.array(signal)))


def fold(rows: DataFrame) -> DataFrame:
    """``rows`` (workspace_id, namespace, kind, normalized, row_number, own_id, safe) with ``outcome`` and ``subject_id``.

    Rows of a group are taken in order.  A safe value's first row is new and gives the group its subject; later rows
    are exactly that one.  Rows of other values are always for review and stand for themselves.
    """
    w = Window.partitionBy("workspace_id", "namespace", "kind", "normalized").orderBy("row_number")
    first = F.first("own_id").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    made = rows.withColumn("__n", F.row_number().over(w))
    outcome = F.when(~F.col("safe"), "review").when(F.col("__n") == 1, "new").otherwise("exact")
    return made.withColumns({"outcome": outcome, "subject_id": F.when(F.col("safe"), first).otherwise(F.col("own_id"))}).drop("__n")
