"""Stored runs: an evaluation of the same inputs, configuration, policy and clock is done once and read after that."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kinweft import schemas
from kinweft.config import ConfigError
from kinweft.operators import evaluate
from kinweft.operators.evaluate import Evaluation
from kinweft.sources.store import Store

PARTS = ("verdicts", "results", "blocked", "review_only")


class Runs:
    """Runs in a shared folder.  A run's frames go to a folder of its attempt; its marker, written last, names them.

    The marker is made only if there is none, so of two attempts at once the first to end counts, and a reader sees
    a run whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def marker(self, run_id: str) -> dict[str, Any] | None:
        """What a completed run noted, or None."""
        path, fs = self._path(f"{self.root}/{run_id}/run.json")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(str(path.toString())).collect())) if fs.exists(path) else None

    def read(self, run_id: str) -> Evaluation:
        """A completed run, its findings and near-misses in the order of the run."""
        if not run_id.startswith("audit_run_") or not run_id.replace("_", "").isalnum():
            raise ConfigError("RUN_ID_INVALID")
        noted = self.marker(run_id)
        if noted is None:
            raise ConfigError("RUN_NOT_FOUND")
        part = {p: self.spark.read.parquet(f"{self.root}/{run_id}/{noted['attempt']}/{p}") for p in PARTS}
        hashes = [noted[k] for k in ("config_sha256", "policy_sha256", "input_set_sha256")]
        return Evaluation(run_id, *hashes, datetime.fromisoformat(noted["clock"]), part["verdicts"], evaluate.in_result_order(part["results"]), *(evaluate.in_candidate_order(part[p]) for p in PARTS[2:]))

    def listed(self) -> list[str]:
        """The ids of all completed runs."""
        path, fs = self._path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if fs.exists(self._path(f"{self.root}/{n}/run.json")[0]))

    def once(self, tables: dict[str, DataFrame], config: Any, policy: Any, clock: str | datetime) -> tuple[Evaluation, bool]:
        """(the run, whether it was stored before).  What is stored is not computed again."""
        task = evaluate.prepare(tables, config, policy, clock)
        if self.marker(task.audit_run_id) is not None:
            return self.read(task.audit_run_id), True
        made = evaluate.run(task)
        attempt = uuid.uuid4().hex[:12]
        for p in PARTS:
            getattr(made, p).write.parquet(f"{self.root}/{made.audit_run_id}/{attempt}/{p}")
        noted = {"attempt": attempt, "clock": made.clock.isoformat(), **{k: getattr(made, k) for k in ("config_sha256", "policy_sha256", "input_set_sha256")}}
        # of two attempts the marker of one is made; the other one's stays away
        Store(self.spark, self.root).put_if_absent(f"{self.root}/{made.audit_run_id}/run.json", json.dumps(noted))
        return self.read(made.audit_run_id), False

    def results(self, workspace: str) -> DataFrame:
        """The findings of all completed runs of a workspace, for reports over time."""
        out = schemas.empty(self.spark, "coverage_result")
        for run_id in self.listed():
            out = out.unionByName(self.read(run_id).results.select(*out.columns))
        return out.where(out.workspace_id == workspace)
