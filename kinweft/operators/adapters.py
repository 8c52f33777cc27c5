"""Read-only provider metadata: authorization, field lists, deduplication and claims."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.config import ConfigError, instant

LIMITS = {"page": 1000, "pages": 100, "records": 10_000, "record_bytes": 64 * 1024}


def _checks(a: Any, workspace: str, adapter: str, provider: str, purpose: str, capability: str, between: Any, holds: Any, absent: Any) -> dict[str, Any]:
    """What must hold of an authorization, by the code that refuses it; in order."""
    return {
        "ADAPTER_AUTHORIZATION_WORKSPACE_MISMATCH": a["workspace_id"] == workspace, "ADAPTER_AUTHORIZATION_ADAPTER_MISMATCH": (a["adapter_id"] == adapter) & (a["provider"] == provider), "ADAPTER_AUTHORIZATION_PURPOSE_MISMATCH": a["purpose_id"] == purpose,
        "ADAPTER_AUTHORIZATION_REVOKED": absent(a["revoked_at"]) & (a["status"] == "active"), "ADAPTER_AUTHORIZATION_NOT_ACTIVE": between(a["authorized_at"], a["expires_at"]), "ADAPTER_CAPABILITY_DENIED": holds(a["capabilities"], capability),
    }


def authorize(authorization: dict[str, Any], workspace: str, adapter: str, provider: str, purpose: str, capability: str, at: datetime) -> None:
    """Raise unless the authorization lets this adapter read this kind of metadata for this purpose now."""
    held = {"revoked_at": None} | authorization
    for code, ok in _checks(held, workspace, adapter, provider, purpose, capability, lambda a, b: instant(a) <= at < instant(b), lambda xs, x: x in xs, lambda x: x is None).items():
        if not ok:
            raise ConfigError(code)


def refusal(workspace: str, adapter: str, provider: str, purpose: str, capability: str, at: datetime) -> Column:
    """The same of a table of authorizations: the code that refuses a row, or null.  What is unknown is refused."""
    now = F.lit(at)
    columns = {c: F.col(c) for c in ("workspace_id", "adapter_id", "provider", "purpose_id", "revoked_at", "status", "authorized_at", "expires_at", "capabilities")}
    between = lambda a, b: (F.try_to_timestamp(a) <= now) & (now < F.try_to_timestamp(b))
    made = _checks(columns, workspace, adapter, provider, purpose, capability, between, F.array_contains, lambda x: x.isNull())
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in made.items()])


def deduplicate(records: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, order, duplicates): the first record of each key, and how many others have it."""
    return records.groupBy(*key).agg(F.min(order).alias(order), (F.count("*") - 1).alias("duplicates"))


def own_verdict(allowed_fields: list[str], since: str, until: str) -> Column:
    """The code of the error that a record is by itself, or null."""
    seen = F.try_to_timestamp("observed_at")
    extra = F.size(F.array_except(F.json_object_keys("fields"), F.array(*[F.lit(f) for f in allowed_fields]).cast("array<string>"))) > 0
    return (
        F.when(F.length("fields") > LIMITS["record_bytes"], "RECORD_TOO_LARGE")
        .when(extra, "FIELD_NOT_AUTHORIZED")
        .when(seen.isNull() | ~seen.between(F.to_timestamp(F.lit(since)), F.to_timestamp(F.lit(until))), "RECORD_OUTSIDE_TIME_WINDOW")
    )


def accept(records: DataFrame, stored: DataFrame, allowed_fields: list[str], since: str, until: str, order: str | None = None) -> DataFrame:
    """``records`` with ``verdict``: ``accepted``, ``duplicate``, or the code of the error that stops them.

    ``records`` has (adapter_authorization_id, provider_record_id, observed_at, record_digest_sha256, fields: JSON).
    Within a batch the first record of a key counts; of those seen at one instant with one digest, the first by
    ``order``, a column in whose order records came, or else by their fields.  The same key with another digest is a rebinding, as it is
    against ``stored``.  Records out of the time window or with fields that are not allowed are errors, not drops.
    """
    key = ["adapter_authorization_id", "provider_record_id"]
    known = stored.select(*key, F.col("record_digest_sha256").alias("__stored"))
    same = Window.partitionBy(*key)
    made = records.join(known, key, "left").withColumns({"__place": F.row_number().over(same.orderBy("observed_at", "record_digest_sha256", *([order] if order else []), "fields")), "__digests": F.size(F.collect_set("record_digest_sha256").over(same))})
    rebound = (F.col("__stored") != F.col("record_digest_sha256")) | (F.col("__digests") > 1)
    repeat = F.col("__stored").isNotNull() | (F.col("__place") > 1)
    verdict = F.coalesce(own_verdict(allowed_fields, since, until), F.when(rebound, "PROVIDER_RECORD_REBINDING_REJECTED").when(repeat, "duplicate").otherwise("accepted"))
    return made.withColumn("verdict", verdict).drop("__stored", "__place", "__digests")
