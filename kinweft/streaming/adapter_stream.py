"""Provider metadata as a stream: records in, verdicts out, each record once.

What was accepted is keyed state: the digest of each provider's record.  A batch so costs what it holds, however many
came before, and a query that starts again from its checkpoint goes on with the state it had.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinweft.operators.adapters import own_verdict

RECORD = "adapter_authorization_id string, provider_record_id string, observed_at string, record_digest_sha256 string, fields string"
KEY = ["adapter_authorization_id", "provider_record_id"]


def _judge(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The records of one provider's record in a batch, against the digest that was accepted before."""
    held = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["observed_at", "record_digest_sha256"], kind="stable", ignore_index=True)
    sound = rows["verdict"].isna()
    digests = set(rows.loc[sound, "record_digest_sha256"])
    if held is None and len(digests) > 1 or held is not None and digests - {held}:
        # of a batch that says two things nothing is taken; against what is held only what differs is refused
        differs = sound if held is None else sound & (rows["record_digest_sha256"] != held)
        rows.loc[differs, "verdict"] = "PROVIDER_RECORD_REBINDING_REJECTED"
        sound &= ~differs
    if held is None and sound.any():
        first = sound.idxmax()
        rows.loc[first, "verdict"] = "accepted"
        sound[first] = False
        state.update((rows.loc[first, "record_digest_sha256"],))
    rows.loc[sound, "verdict"] = "duplicate"
    yield rows


def accept_stream(records: DataFrame, allowed_fields: list[str], since: str, until: str) -> DataFrame:
    """A stream of records with their ``verdict``: ``accepted``, ``duplicate`` or the code of an error.

    Records that are too large, outside the window or say what is not allowed are errors by themselves and leave no
    state.  Of the rest the first of a key is accepted; the same again is a duplicate, another content a rebinding.
    All records of a batch that have one key are held together: a batch is bounded by its source.
    """
    judged = records.withColumn("verdict", own_verdict(allowed_fields, since, until))
    return judged.groupBy(*KEY).applyInPandasWithState(_judge, judged.schema, "digest string", "append", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, allowed_fields: list[str], since: str, until: str, files_per_batch: int = 100) -> StreamingQuery:
    """Read JSON lines from ``source`` as they come, and add judged records to the Parquet folder ``sink``.

    Spark's file sink names the files of whole batches only, so a batch that is run again adds nothing twice.
    """
    records = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(source)
    judged = accept_stream(records, allowed_fields, since, until)
    return judged.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_provider(spark: SparkSession, name: str, sink: str, checkpoint: str, allowed_fields: list[str], since: str, until: str) -> StreamingQuery:
    """The same from a registered provider source (:mod:`kinweft.sources.provider_source`), page by page."""
    judged = accept_stream(spark.readStream.format(name).load(), allowed_fields, since, until)
    return judged.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="0 seconds").start()
