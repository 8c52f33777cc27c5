"""A workspace store: Parquet segments under an append-only log of commits.

A commit writes the rows that it adds as new segments and then one small log entry, which takes the number after the
entry that the commit was based on and is only made if no entry has that number.  Readers see the newest entry, which
names all segments of every table, and merge them by key: the newest row of a key counts.  Segments whose keys were all
new, as those of tables that never change, need no merge.  Nothing is rewritten but by :meth:`Store.compact`.

A commit whose base has moved is put on top of the newest entry if nobody else changed a table that it read or wrote;
else it is refused, and what it wrote stays unnamed.  Audit events are chained when the entry is made, from the heads
that the entry before it holds.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweft import schemas
from kinweft.config import ConfigError
from kinweft.operators import governance
from kinweft.operators.materialize import REFERENCES

#: Tries of a commit whose base keeps moving, each time by tables that it has nothing to do with.
ATTEMPTS = 20
#: Tables that a commit checks and writes at the same time.
TABLES_AT_ONCE = 6


def _key(name: str) -> list[str]:
    return list(dict.fromkeys(["workspace_id", schemas.KEYS[name]]))


class Store:
    """The tables of a store folder, which any file system that Spark writes to may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _local(self, path: str) -> Path | None:
        """The path on the driver's own file system, if the store is there."""
        target, fs = self._fs(path)
        return Path(target.toUri().getPath()) if fs.getScheme() == "file" else None

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs(f"{self.root}/{folder}")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.endswith(".json") and not n.startswith(".")) if fs.exists(path) else []

    def _read(self, path: str) -> dict[str, Any]:
        local = self._local(path)
        return json.loads(local.read_text(encoding="utf-8") if local else self.spark.read.text(path, wholetext=True).first()[0])

    def put_if_absent(self, path: str, text: str) -> bool:
        """Make a whole file unless there is one of that name already; of two at once one is refused."""
        folder, name = path.rsplit("/", 1)
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        if local := self._local(path):  # a rename would replace there
            local.parent.mkdir(parents=True, exist_ok=True)
            written = self._local(part)
            written.write_text(text, encoding="utf-8")
            try:
                os.link(written, local)
            except FileExistsError:
                return False
            finally:
                written.unlink()
            return True
        target, fs = self._fs(part)
        out = fs.create(target, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.rename(target, self._fs(path)[0]):
            return True
        fs.delete(target, False)
        return False

    def _drop(self, path: str) -> None:
        target, fs = self._fs(path)
        fs.delete(target, True)

    # the log

    def state(self) -> dict[str, Any]:
        """The newest entry: its ``number``, the ``schema`` version, the segments of all ``tables``, and audit ``heads``.

        A folder of the first layout, whose manifests name one folder for each table, is read as entry 0 of schema 1.
        """
        if names := self._names("_log"):
            return self._read(f"{self.root}/_log/{names[-1]}")
        if names := self._names("_manifests"):
            made = self._read(f"{self.root}/_manifests/{names[-1]}")
            return {"number": 0, "schema": 1, "migrations": [], "heads": None, "indexed": False, "changed": [], "tables": {k: [{"put": p, "fresh": True, "number": 0, "schema": 1} for p in v] for k, v in made.items()}}
        return {"number": 0, "schema": schemas.VERSION, "migrations": [[schemas.VERSION, "created"]], "heads": {}, "indexed": True, "changed": [], "tables": {}}

    def _changed_after(self, number: int, upto: int) -> set[str]:
        return {t for n in range(number + 1, upto + 1) for t in self._read(f"{self.root}/_log/{n:012d}.json")["changed"]}

    def schema_version(self) -> int:
        return self.state()["schema"]

    def migrate(self) -> list[list]:
        """Bring the store to the newest schema and return all migrations that were applied, in order.

        Segments stay as they are: those of an older schema are upgraded whenever they are read.
        """
        old = self.state()
        if old["schema"] > schemas.VERSION:
            raise ConfigError("SCHEMA_TOO_NEW")
        steps = [[v, name] for v, name, _ in schemas.UPGRADES if v > old["schema"]]
        if steps:
            made = old | {"number": old["number"] + 1, "schema": schemas.VERSION, "migrations": old["migrations"] + steps, "changed": list(schemas.TABLES), "heads": self._heads(old)}
            if not self.put_if_absent(f"{self.root}/_log/{made['number']:012d}.json", json.dumps(made)):
                raise ConfigError("COMMIT_CONFLICT")
        return self.state()["migrations"]

    def _heads(self, state: dict[str, Any]) -> dict[str, Any]:
        """The last audit event of each workspace, (sequence, hash)."""
        if state["heads"] is not None:
            return state["heads"]
        return {r["workspace_id"]: {"sequence": r["sequence"], "hash": r["hash"]} for r in governance.latest_events(self.table("audit_event", state)).collect()}

    # tables

    def _segment(self, name: str, segments: list[dict[str, Any]]) -> DataFrame:
        """The rows of segments of one schema version, in the newest schema."""
        version = segments[0]["schema"]
        rows = self.spark.read.schema(schemas.schema(name, version)).parquet(*[s["put"] for s in segments])
        for v, _, steps in schemas.UPGRADES:
            if v > version and name in steps:
                rows = steps[name](rows)
        return rows.select(*schemas.schema(name).names)

    def table(self, name: str, state: dict[str, Any] | None = None) -> DataFrame:
        """The rows of a table in an entry of the log (the newest one)."""
        segments = (state or self.state())["tables"].get(name, [])
        puts = [s for s in segments if s.get("put")]
        if not puts:
            return schemas.empty(self.spark, name)
        if all(s["fresh"] for s in segments):
            return reduce(DataFrame.unionByName, [self._segment(name, [s for s in puts if s["schema"] == v]) for v in sorted({s["schema"] for s in puts})])
        key = _key(name)
        parts = [self._segment(name, [s]).withColumns({"_number": F.lit(s["number"]), "_gone": F.lit(False)}) for s in puts]
        parts += [self.spark.read.parquet(s["delete"]).withColumns({"_number": F.lit(s["number"]), "_gone": F.lit(True)}) for s in segments if s.get("delete")]
        newest = Window.partitionBy(*key).orderBy(F.desc("_number"), "_gone")
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return both.withColumn("_place", F.row_number().over(newest)).where("_place = 1 and not _gone").select(*schemas.schema(name).names)

    def tables(self, state: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        state = state or self.state()
        return {name: self.table(name, state) for name in schemas.TABLES}

    def get(self, name: str, workspace: str, row_id: Any, state: dict[str, Any] | None = None) -> dict[str, Any] | None:
        """One row by its id, or None.  The newest segment that has the id tells; its filter reaches the scan."""
        mine = (F.col("workspace_id") == workspace) & (F.col(schemas.KEYS[name]) == row_id)
        for s in reversed((state or self.state())["tables"].get(name, [])):
            if s.get("put") and (found := self._segment(name, [s]).where(mine).head(1)):
                return found[0].asDict(recursive=True)
            if s.get("delete") and self.spark.read.parquet(s["delete"]).where(mine).head(1):
                return None
        return None

    def dependants(self, workspace: str, consent: str, state: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """(workspace_id, key) of the rows of each table that rest on a consent.

        Read from the postings that commits keep, which are sorted by consent: no other table is read.  Only where rows
        of a table were replaced since, which may rest on other consents now, are these looked at again.
        """
        state = state or self.state()
        if not state["indexed"]:
            mine = {k: self.table(k, state).where(F.col("workspace_id") == workspace) for k in governance.DEPENDENT}
            return {k: df.select("workspace_id", schemas.KEYS[k]) for k, df in governance.withdrawal_dependants(mine, consent).items()}
        posted = self.table("dependency", state).where((F.col("consent_record_id") == consent) & (F.col("workspace_id") == workspace))
        found = {k: posted.where(F.col("table_name") == k).select("workspace_id", F.col("row_id").alias(schemas.KEYS[k])).distinct() for k in governance.DEPENDENT}
        for name, rows in found.items():
            if not all(s["fresh"] for s in state["tables"].get(name, [])):
                now = self.table(name, state).join(rows, _key(name), "left_semi")
                if name in governance.CLAIMS:
                    gone = found["evidence_ref"].select(F.col("evidence_ref_id").alias("ref"))
                    now = now.withColumn("ref", F.explode("evidence_refs")).join(gone, "ref", "left_semi")
                elif name == "coverage_result":
                    now = now.where(F.array_contains("dependencies.consent_record_ids", consent))
                elif "consent_record_id" in now.columns:
                    now = now.where(F.col("consent_record_id") == consent)
                found[name] = now.select(*_key(name)).distinct()
        return found

    def begin(self) -> Transaction:
        return Transaction(self)

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Put rows by key: later rows replace earlier ones; immutable tables only take rows that are new or equal."""
        made = self.begin()
        for name, rows in changes.items():
            made.put(name, rows)
        return made.commit()

    def compact(self, names: Iterable[str] | None = None) -> int:
        """Write tables of several segments as one.  Refused if somebody changes them meanwhile."""
        base = self.state()
        wanted = [n for n in (names or (*schemas.TABLES, *schemas.INDEXES)) if len(base["tables"].get(n, [])) > 1]
        for n in wanted:
            base["tables"][n] = [self._write(n, self.table(n, base), base["number"] + 1)]
        if not wanted:
            return base["number"]
        made = base | {"number": base["number"] + 1, "changed": wanted}
        if not self.put_if_absent(f"{self.root}/_log/{made['number']:012d}.json", json.dumps(made)):
            raise ConfigError("COMMIT_CONFLICT")
        return made["number"]

    def vacuum(self) -> int:
        """Delete the segments that the newest entry does not name; only while nobody else reads or writes."""
        named = {p.rsplit("/", 2)[1] + "/" + p.rsplit("/", 1)[1] for of in self.state()["tables"].values() for s in of for p in (s.get("put"), s.get("delete")) if p}
        n = 0
        for name in (*schemas.TABLES, *schemas.INDEXES):
            path, fs = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if f"{name}/{s.getPath().getName()}" not in named:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n

    def _write(self, name: str, rows: DataFrame, number: int) -> dict[str, Any]:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        # sorted, so that the statistics of the files' groups let a look-up by id skip most of them
        order = _key(name) if name in schemas.KEYS else schemas.schema(name).names
        rows.select(*schemas.schema(name).names).sortWithinPartitions(*order).write.parquet(path)
        return {"put": path, "fresh": True, "number": number, "schema": schemas.VERSION}


class Transaction:
    """Reads of one entry of the log, and changes that become visible together or not at all."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.state()
        self.read: set[str] = set()
        self.puts: dict[str, DataFrame] = {}
        self.deletes: dict[str, DataFrame] = {}
        self.events: list[tuple[str, tuple]] = []

    def table(self, name: str) -> DataFrame:
        self.read.add(name)
        return self.store.table(name, self.base)

    def tables(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in (names or schemas.TABLES)}

    def get(self, name: str, workspace: str, row_id: Any) -> dict[str, Any] | None:
        self.read.add(name)
        return self.store.get(name, workspace, row_id, self.base)

    def put(self, name: str, rows: DataFrame) -> None:
        self.puts[name] = self.puts[name].unionByName(rows.select(*self.puts[name].columns)) if name in self.puts else rows

    def put_row(self, name: str, row: dict[str, Any]) -> None:
        """Put one row given as an object; columns that it lacks are null, and one that is not known is an error."""
        kind = schemas.schema(name)
        if set(row) - set(kind.names):
            raise ConfigError(f"UNKNOWN_COLUMN:{name}:{min(set(row) - set(kind.names))}")
        self.put(name, self.store.spark.createDataFrame([tuple(row.get(c) for c in kind.names)], kind))

    def delete(self, name: str, rows: DataFrame) -> None:
        if name in schemas.IMMUTABLE and name not in governance.CASCADED:
            raise ConfigError(f"IMMUTABLE_ENTITY:{name}")
        self.deletes[name] = rows.select(*_key(name)).distinct()

    def audit(self, workspace: str, event_type: str, actor: str, at: str, subject_type: str, subject_id: str, payload: Any) -> None:
        """Append an event to the workspace's chain with this commit."""
        self.events.append((workspace, (event_type, actor, at, subject_type, subject_id, payload)))

    def _checked(self, name: str, rows: DataFrame, number: int) -> dict[str, Any] | None:
        """The written segment of rows that may be put; None if all are there already in a table that never changes."""
        store, key = self.store, _key(name)
        made = store._write(name, rows.dropDuplicates(key), number)
        written = store._segment(name, [made])
        if bad := schemas.violations(name, written).head(1):
            raise ConfigError(f"INVALID_ROWS:{name}:{bad[0]['gate_codes'][0]}")
        if not self.base["tables"].get(name):
            return made
        columns = schemas.schema(name).names
        digest = F.sha2(F.to_json(F.struct(*columns)), 256)
        both = store.table(name, self.base).select(*key, digest.alias("a")).join(written.select(*key, digest.alias("b")), key)
        n, other = both.agg(F.count("*"), F.count(F.when(F.col("a") != F.col("b"), 1))).first()
        if name not in schemas.IMMUTABLE:
            return made | {"fresh": n == 0}
        if other:
            raise ConfigError(f"IMMUTABLE_ENTITY:{name}")
        if n == 0:
            return made
        rest = written.join(both.select(*key), key, "left_anti")
        return None if rest.isEmpty() else store._write(name, rest, number)

    def _dangling(self, name: str, segment: dict[str, Any], segments: dict[str, dict[str, Any]]) -> None:
        """Raise if a written row names a row that is neither stored nor part of this commit."""
        store, rows = self.store, self.store._segment(name, [segment])
        for column, other in REFERENCES.get(name, {}).items():
            there = store.table(other, self.base).select("workspace_id", F.col(schemas.KEYS[other]).alias(column))
            if other in segments:
                there = there.unionByName(store._segment(other, [segments[other]]).select("workspace_id", F.col(schemas.KEYS[other]).alias(column)))
            if not rows.select("workspace_id", column).where(F.col(column).isNotNull()).distinct().join(there, ["workspace_id", column], "left_anti").isEmpty():
                raise ConfigError(f"DANGLING_REFERENCE:{name}:{column}")

    def commit(self, references: bool = False) -> int:
        """Make the changes visible; returns the number of the log entry.

        With ``references`` every row that a written row names must be there.  Raises without any effect if a row is
        not valid, would change an immutable one, or if somebody changed a table that was read or written here.
        """
        store, number = self.store, self.base["number"] + 1
        if "audit_event" in self.puts and self.events:
            raise ConfigError("AUDIT_EVENTS_ARE_CHAINED")
        if self.base["schema"] < schemas.VERSION:
            raise ConfigError("MIGRATION_REQUIRED")
        # tables do not wait for one another: their jobs are small, and most of a small commit is waiting for them
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            segments = list(pool.map(lambda x: self._checked(*x, number), self.puts.items()))
            made = {name: segment for name, segment in zip(self.puts, segments, strict=True) if segment}
            if references:
                list(pool.map(lambda x: self._dangling(*x, made), list(made.items())))
        if self.base["indexed"] and (rests := {k: store._segment(k, [s]) for k, s in made.items() if k in governance.DEPENDENT}):
            made["dependency"] = store._write("dependency", governance.postings(rests, store.table("dependency", self.base)), number)
        for name, keys in self.deletes.items():
            path = f"{store.root}/{name}/{uuid.uuid4().hex}"
            keys.write.parquet(path)
            made[name] = made.get(name, {"put": None, "number": number, "schema": schemas.VERSION}) | {"delete": path, "fresh": False}
        mine = self.read | set(self.puts) | set(self.deletes)
        if "dependency" in made:  # the postings of evidence hang on the snapshots that were seen
            mine |= {"source_snapshot", "evidence_ref"}
        for _ in range(ATTEMPTS):
            now = store.state()
            if now["number"] > self.base["number"] and mine & store._changed_after(self.base["number"], now["number"]):
                raise ConfigError("COMMIT_CONFLICT")
            number, added = now["number"] + 1, dict(made)
            heads = dict(store._heads(now))
            events = []
            for workspace, event in self.events:
                last = governance.audit_event(workspace, heads[workspace]["sequence"] + 1 if workspace in heads else 1, heads[workspace]["hash"] if workspace in heads else None, event)
                heads[workspace] = {"sequence": last["sequence"], "hash": last["hash"]}
                events.append(last)
            if events:
                added["audit_event"] = store._write("audit_event", governance.audit_frame(store.spark, events).coalesce(1), number)
            tables = dict(now["tables"])
            for name, segment in added.items():
                tables[name] = [*tables.get(name, []), segment | {"number": number}]
            entry = now | {"number": number, "heads": None if "audit_event" in made else heads, "tables": tables, "changed": sorted(set(made) - set(schemas.INDEXES))}
            if store.put_if_absent(f"{store.root}/_log/{number:012d}.json", json.dumps(entry)):
                return number
            if events:
                store._drop(added["audit_event"]["put"])
        raise ConfigError("COMMIT_CONFLICT")
