"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

The exact table says in how many documents each line key occurs.  Documents are inserted by adding
their counts and deleted by subtracting them, so the state after a deletion equals the state without
the document.  Keys that occur in at least ``min_docs`` documents are put into cuckoo filters, one for
each shard of the key space; filters support deletion too, and answer for most lines without a look at
the table.  The few rare keys that a filter takes for common ones are found by probing the exact table
once, so results are exact.

Filters up to a size are sent to all workers.  Beyond it, lines are sent to the tasks of their shards, which are
made ready by the shard's filter and its false positives; how many tasks a shard has follows from its reference
counts, so a line that every document has is spread over many.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweft.llm.shared import durable, free, map_arrow

MIN_DOCS = 10
KEYS_PER_SHARD = 200_000
#: Above so many bytes of filters, or so many false positives, lines go to the filters instead of filters to lines.
BROADCAST_BYTES = 32 << 20
BROADCAST_KEYS = 200_000
#: Lines for each task there; a shard with more of them has copies of its filter in several tasks.
LINES_PER_TASK = 10_000_000

_U = np.uint64
_SLOTS = 4


def line_keys(text: bytes) -> list[bytes]:
    """The key of every line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip() for x in text.lower().split(b"\n")]


def key_digest(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A cuckoo filter with 16-bit fingerprints over 128-bit key digests."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets
        self.mask = len(buckets) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for ``keys`` keys (at most 80 % full)."""
        need = max(2, int(keys / (_SLOTS * 0.8)) + 1)
        return cls(np.zeros((1 << (need - 1).bit_length(), _SLOTS), np.uint16))

    @classmethod
    def build(cls, digests: list[bytes]) -> CuckooFilter:
        room = max(1, len(digests))
        while True:
            made = cls.sized(room)
            if all(made.insert(d) for d in digests):
                return made
            room *= 2

    @staticmethod
    def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        return flat[:, 0], flat[:, 1]

    def _places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self._halves(digests)
        print_ = (b >> _U(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = (a & _U(self.mask)).astype(np.int64)
        return print_, one, one ^ self._jump(print_)

    def _jump(self, print_: np.ndarray) -> np.ndarray:
        return ((print_.astype(np.int64) * 0x5BD1E995) >> 7) & self.mask

    def insert(self, digest: bytes) -> bool:
        print_, one, two = (x[0] for x in self._places([digest]))
        at = int(one)
        for at in (int(one), int(two)):
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = print_
                return True
        for step in range(500):  # move what is there to its other bucket
            slot = step % _SLOTS
            print_, self.buckets[at, slot] = self.buckets[at, slot], print_
            at = int(at ^ self._jump(np.array([print_], np.uint16))[0])
            free = np.flatnonzero(self.buckets[at] == 0)
            if len(free):
                self.buckets[at, free[0]] = print_
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Take out one insertion of a key that was inserted."""
        print_, one, two = (x[0] for x in self._places([digest]))
        for at in (int(one), int(two)):
            found = np.flatnonzero(self.buckets[at] == print_)
            if len(found):
                self.buckets[at, found[0]] = 0
                return True
        return False

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        print_, one, two = self._places(digests)
        return ((self.buckets[one] == print_[:, None]) | (self.buckets[two] == print_[:, None])).any(axis=1)


def reference_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, refs): for each line key of ``docs``, in how many rows it occurs.  Keys are 128-bit digests.

    Empty keys are left out.  Counts are added up in the tasks that read, so a line that every
    document has costs one row for each task.
    """

    def run(batches):
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "refs"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                seen.update({key_digest(k) for k in {*line_keys(text.as_py() or b"")} if k})
            if len(seen) > 400_000:
                yield flush()
        yield flush()

    return map_arrow(docs.select(F.col(text_col).cast("binary")), run, "key binary, refs long").groupBy("key").agg(F.sum("refs").alias("refs"))


def update_counts(table: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The table after insertion and deletion of documents; keys without documents leave it.

    Deleting a document that was never inserted would make a count negative: that raises an error.
    """
    parts = table
    if inserted is not None:
        parts = parts.unionByName(reference_counts(inserted, text_col))
    if deleted is not None:
        parts = parts.unionByName(reference_counts(deleted, text_col).withColumn("refs", -F.col("refs")))
    total = parts.groupBy("key").agg(F.sum("refs").alias("refs"))
    sound = F.when(F.col("refs") < 0, F.raise_error(F.lit("a document was deleted that was not there"))).otherwise(F.col("refs"))
    return total.withColumn("refs", sound.cast("long")).where("refs > 0")


def _shard(shards: int):
    """A key's shard, by bytes of the digest that the filters themselves do not use."""
    return F.expr(f"cast(pmod(cast(conv(hex(substring(key, 9, 4)), 16, 10) as bigint), {shards}) as int)")


def shard_filters(table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(shard, shards, keys, filter): a cuckoo filter for each shard of the keys in ``min_docs`` documents or more."""
    common = table.where(F.col("refs") >= min_docs).select("key")
    shards = 1 << max(0, (common.count() // KEYS_PER_SHARD).bit_length())

    def build(group: pa.Table) -> pa.Table:
        made = CuckooFilter.build(group.column("key").to_pylist())
        return pa.table({"shard": group.column("shard").slice(0, 1), "shards": pa.array([shards], pa.int32()), "keys": pa.array([group.num_rows], pa.int64()), "filter": pa.array([made.buckets.tobytes()], pa.binary())})

    return common.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, shards int, keys long, filter binary")


class Shards:
    """All shards' filters, for probing; a key asks the filter of its own shard only."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.shards = max((n for _, n, _ in rows), default=1)
        self.filters = {shard: CuckooFilter(np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS)) for shard, _, raw in rows}

    def contains(self, digests: list[bytes]) -> np.ndarray:
        hit = np.zeros(len(digests), bool)
        if len(self.filters) == 1 and self.shards == 1:
            return self.filters[0].contains(digests)
        if digests:
            flat = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
            shard = np.ascontiguousarray(flat[:, 8:12]).view(">u4").ravel() % self.shards
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                if s in self.filters:
                    hit[at] = self.filters[int(s)].contains([digests[i] for i in at])
        return hit


def _numbered(schema: T.StructType, at: int) -> T.StructType:
    """The schema under names of our own, the text (column ``at``) as bytes, and two counts after it."""
    kinds = [T.BinaryType() if k == at else f.dataType for k, f in enumerate(schema.fields)]
    return T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate([*kinds, T.LongType(), T.LongType()])])


def _named(made: DataFrame, columns: list[str], at: int) -> DataFrame:
    names = [*columns, "n_lines", "n_dropped"]
    return made.select(*[(F.col(f"c{k}").cast("string") if k == at else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)])


def drop_common_lines(docs: DataFrame, table: DataFrame | None = None, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` less its common lines, and two columns ``n_lines`` and ``n_dropped``.

    A line goes, wherever it stands, if its key has at least one code point and occurs in ``min_docs``
    rows of ``table`` (by default, of ``docs``).  Lines are split at ``\\n`` only; what stays is joined by
    ``\\n`` unchanged.  A null text is one empty line and becomes an empty text.  Repeated rows count as
    documents of their own.  Columns of ``docs`` that are called ``n_lines`` or ``n_dropped`` are replaced.
    An empty table gives an empty table.
    """
    if table is None:
        table = durable(reference_counts(docs, text_col), "line-refs")
    docs = docs.drop("n_lines", "n_dropped")
    filters = durable(shard_filters(table, min_docs), "line-filters")
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return _drop_routed(docs, table, filters, text_col, min_docs)
    context = docs.sparkSession.sparkContext
    shards = context.broadcast([tuple(r) for r in filters.select("shard", "shards", "filter").collect()])

    def probe(batches):
        found = Shards(shards.value)
        for batch in batches:
            hit = found.contains(batch.column(0).to_pylist())
            yield batch.filter(pa.array(hit, pa.bool_()))

    wrong = durable(map_arrow(table.where(F.col("refs") < min_docs).select("key"), probe, "key binary"), "line-false")
    if wrong.count() > BROADCAST_KEYS:
        return _drop_routed(docs, table, filters, text_col, min_docs)
    rare = context.broadcast({r[0] for r in wrong.collect()})
    at = docs.columns.index(text_col)

    def run(batches):
        found, no = Shards(shards.value), rare.value
        for batch in batches:
            texts, lines, dropped = [], [], []
            raw = [x or b"" for x in batch.column(at).to_pylist()]
            keys = [line_keys(x) for x in raw]
            flat = [key_digest(k) for ks in keys for k in ks]
            hit = found.contains(flat)
            i = 0
            for text, ks in zip(raw, keys, strict=True):
                n = len(ks)
                if hit[i : i + n].any():
                    gone = [bool(hit[i + j]) and bool(k) and flat[i + j] not in no for j, k in enumerate(ks)]
                    text = b"\n".join(x for x, g in zip(text.split(b"\n"), gone, strict=True) if not g)
                    dropped.append(sum(gone))
                else:
                    dropped.append(0)
                texts.append(text)
                lines.append(n)
                i += n
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[f"c{k}" for k in range(len(cols) + 2)])

    made = docs.select(*[F.col(f"`{c}`").cast("binary") if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return _named(map_arrow(made, run, _numbered(docs.schema, at)), docs.columns, at)


def _found_in_shards(asked: DataFrame, filters: DataFrame, wrong: DataFrame | None) -> DataFrame:
    """The rows (text_key, key) of ``asked`` whose key its shard's filter holds and ``wrong`` does not.

    ``filters`` has (shard, shards, filter, tasks).  A task reads a shard's filter, then its false positives, then
    its lines, in this order, and holds the first two only.
    """
    shards, tasks = filters.agg(F.coalesce(F.max("shards"), F.lit(1)), F.coalesce(F.sum("tasks"), F.lit(1))).first()
    # one row for each shard of 200,000 common keys or so; how it is joined is left to Spark's check of its size
    where, every = filters.select("shard", "tasks"), F.explode(F.expr("sequence(0L, tasks - 1)")).alias("task")
    none = lambda kind: F.lit(None).cast(kind)
    parts = filters.select("shard", every, F.lit(0).alias("kind"), none("long").alias("text_key"), none("binary").alias("key"), "filter")
    if wrong is not None:
        parts = parts.unionByName(wrong.withColumn("shard", _shard(shards)).join(where, "shard").select("shard", every, F.lit(1).alias("kind"), none("long").alias("text_key"), "key", none("binary").alias("filter")))
    lines = asked.withColumn("shard", _shard(shards)).join(where, "shard")
    parts = parts.unionByName(lines.select("shard", F.expr("pmod(xxhash64(text_key, key), tasks)").alias("task"), F.lit(2).alias("kind"), "text_key", "key", none("binary").alias("filter")))

    def run(batches):
        held, no = None, set()
        for batch in batches:
            kinds, keys = batch.column(2).to_numpy(), batch.column(4)
            heads = np.flatnonzero(kinds == 0)
            hit = np.zeros(batch.num_rows, bool)
            for a, b in zip([0, *heads], [*heads, batch.num_rows], strict=True):
                if a < b and kinds[a] == 0:
                    held, no = CuckooFilter(np.frombuffer(batch.column(5)[int(a)].as_py(), np.uint16).reshape(-1, _SLOTS)), set()
                no.update(keys[int(i)].as_py() for i in np.flatnonzero(kinds[a:b] == 1) + a)
                at = np.flatnonzero(kinds[a:b] == 2) + a
                if len(at):
                    ask = keys.take(pa.array(at)).to_pylist()
                    hit[at] = held.contains(ask) & np.array([k not in no for k in ask], bool)
            yield batch.filter(pa.array(hit, pa.bool_())).select(["text_key", "key"])

    width = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tasks))
    return map_arrow(parts.repartition(width, "shard", "task").sortWithinPartitions("shard", "task", "kind"), run, "text_key long, key binary")


def _drop_routed(docs: DataFrame, table: DataFrame, filters: DataFrame, text_col: str, min_docs: int) -> DataFrame:
    """The same with all distinct lines sent to the filters, where these are too large to send to every worker."""

    def explode(batches):
        for batch in batches:
            keys, digests = [], []
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {key_digest(k) for k in {*line_keys(x or b"")} if k}
                keys += [t] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary())], names=["text_key", "key"])

    text_key, gone_name = free("text_key_", docs.columns), free("gone_", docs.columns)
    named = docs.withColumn(text_key, F.xxhash64(text_col))
    lines = map_arrow(named.select(text_key, F.col(text_col).cast("binary")), explode, "text_key long, key binary").distinct()
    load = table.groupBy(_shard(filters.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]).alias("shard")).agg(F.ceil(F.sum("refs") / LINES_PER_TASK).alias("tasks"))
    filters = durable(filters.join(load, "shard"), "line-filters")
    rare = table.where(F.col("refs") < min_docs).select(F.lit(0).cast("long").alias("text_key"), "key")
    wrong = durable(_found_in_shards(rare, filters, None).select("key"), "line-false")
    gone = _found_in_shards(lines, filters, wrong).groupBy("text_key").agg(F.collect_list("key").alias(gone_name))
    both = named.join(gone.withColumnRenamed("text_key", text_key), text_key, "left")
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for x, gone in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                x, gone = x or b"", set(gone or ())
                keep = [line for line, k in zip(x.split(b"\n"), line_keys(x), strict=True) if not (gone and k and key_digest(k) in gone)]
                lines.append(x.count(b"\n") + 1)
                dropped.append(lines[-1] - len(keep))
                texts.append(b"\n".join(keep))
            cols = list(batch.columns)[:last]
            cols[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[f"c{k}" for k in range(last + 2)])

    made = both.select(*[F.col(f"`{c}`").cast("binary") if c == text_col else F.col(f"`{c}`") for c in docs.columns], gone_name)
    return _named(map_arrow(made, run, _numbered(docs.schema, at)), docs.columns, at)
