"""From canonical rows to claims: duplicate groups, anchors, and the fan-out of one row into many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.functions.scalars import email_risk, folded

EVIDENCE_KINDS = ("identity", "organization", "employment", "relationship")


def duplicate_groups(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, n, order): how many rows each group has and its smallest ``order``."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias(order))


def first_of_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The first row of every group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def anchor(keys: dict[str, Column], email: Column) -> Column:
    """Which identifier a row is known by: the first of ``keys`` that is there, an address of one person, or its group."""
    made = None
    for name, value in keys.items():
        made = F.when(value.isNotNull(), name) if made is None else made.when(value.isNotNull(), name)
    return made.when(email_risk(folded(email)) == "unique_candidate", "email").otherwise("row_group")


def fan_out(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``keys``, ``kind`` and ``value``: one row for each value that is there."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in values.items()])
    return rows.select(*keys, F.explode(each).alias("c")).select(*keys, "c.kind", "c.value").where("value is not null")


def evidence_kinds(records: DataFrame) -> DataFrame:
    """Every record once for each kind of claim that it is evidence of (``claim_type``)."""
    return records.withColumn("claim_type", F.explode(F.array(*[F.lit(k) for k in EVIDENCE_KINDS])))
