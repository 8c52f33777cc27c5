"""Durable intermediate tables in the folder all executors share.

The cluster names the folder in ``spark.checkpoint.dir``.  It is read from the session; only where
it is unset (unit tests, a laptop) a folder of our own is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, about; a larger row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a local one where the setting is missing."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kinweft-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, not only by rows: rows may hold very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks it was running.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: A table is sent to all executors up to so many bytes; beyond, it is dealt out so many times, and the other side once.
BROADCAST_BYTES = 16 << 20
SALTS = 32


def held_bytes(df: DataFrame):
    """About the bytes of a row: its texts, and 16 for every column and element."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            size = size + 48 * F.greatest(F.size(F.col(f"`{name}`")), F.lit(0))
    return size


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which is broadcast only if it was measured to be below ``BROADCAST_BYTES``.

    Beyond that, ``small`` is dealt out ``SALTS`` times and each row of ``big`` goes to one of them by the hash of
    all it holds, so a key that very many rows of ``big`` have is spread.  ``small`` is computed twice: pass one that
    is cheap or written.
    """
    if small.agg(F.coalesce(F.sum(held_bytes(small)), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    salt = free("salt", [*big.columns, *small.columns])
    dealt = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")).join(dealt, [*keys, salt], how).drop(salt)
