"""What a session gives the library: workers that have this package, and a folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application, and return the session."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        here = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="kinweft-")) / "kinweft.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(to))
        _sent.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kinweft-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    A frame that several branches of a plan need is computed once, the plan stays small, and a lost executor costs
    no more than its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    # nobody reads the shuffles of a written frame again, so they need not wait for the driver's garbage collection
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
