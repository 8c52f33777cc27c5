"""Which keys recur in a corpus, and where: one shuffle of packed arrays, in which most keys are seen once.

Tasks gather entries (key, a, b) and sort them.  Keys that recur within what a task has gathered are known to, and
their entries leave at once; each key sends one entry to its shard, so that a key that every text has costs a shard
one entry for each gathering, as with a partial aggregation.  Shards are cut by the upper bits of the key; a shard
tells which of the entries that it got have company.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import map_arrow

_U = np.uint64
#: Entries that a task gathers before it sorts them, and bytes of text for each shard.
GATHER = 300_000
SHARD_BYTES = 16 << 20
#: Bits of a filter of wanted keys, whatever their number.
FILTER_BITS = 1 << 25

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sorted(entries: Entries, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by key, without repeated (key, a) if ``once``; where keys begin, and how many entries each has."""
    key, a, b = entries
    order = np.argsort(key)
    key, a, b = key[order], a[order], b[order]
    if once and len(key):
        # only the few keys that recur need their entries in order
        same = np.concatenate([[False], key[1:] == key[:-1]])
        at = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        inner = at[np.lexsort((a[at], key[at]))]
        key[at], a[at], b[at] = key[inner], a[inner], b[inner]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1])])
        key, a, b = key[new], a[new], b[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key, a, b, first, np.diff(np.concatenate([first, [len(key)]]))


def _pack(*columns: np.ndarray) -> bytes:
    return np.array([len(columns[0])], "<u8").tobytes() + b"".join(c.tobytes() for c in columns)


def _unpack(raw: list[bytes], width: int) -> list[np.ndarray]:
    parts = []
    for x in raw:
        n = int(np.frombuffer(x, "<u8", 1)[0])
        at, row = 8, []
        for kind in ("<u8", "<u8", f"<u{width}", "u1"):
            row.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append(row)
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def recurring(texts: DataFrame, entries: Callable[[pa.RecordBatch], Iterable[Entries]], size: int, once: bool, width: int = 4) -> DataFrame:
    """(key, a, b) of the entries whose key has another entry; with ``once``, another one with a different ``a``.

    ``entries`` makes arrays of 8, 8 and ``width`` bytes of a batch of ``texts``; ``size`` is the texts' total of
    bytes.  A row may come out twice.
    """
    shards = 1 << max(0, int(-(-size // SHARD_BYTES)) - 1).bit_length()
    log = shards.bit_length() - 1

    def gather(batches):
        held: list[Entries] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, a, b, first, count = _sorted(tuple(np.concatenate(c) for c in zip(*held, strict=True)), once)
            held.clear()
            known = np.repeat(count > 1, count)
            rows, raw = [], []
            out = [x[known] for x in (key, a, b)]
            for i in range(0, len(out[0]), 1 << 16):  # known to recur: to any task
                part = [x[i : i + (1 << 16)] for x in out]
                rows.append(-1 - int(part[1][0] % _U(shards)))
                raw.append(_pack(*part, np.zeros(len(part[0]), np.uint8)))
            key, a, b, flag = key[first], a[first], b[first], (count > 1).astype(np.uint8)
            cut = np.searchsorted(key >> _U(64 - log), np.arange(shards + 1, dtype=_U)) if log else np.array([0, len(key)])
            for s in range(shards):
                if cut[s + 1] > cut[s]:
                    rows.append(s)
                    raw.append(_pack(*(x[cut[s] : cut[s + 1]] for x in (key, a, b, flag))))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(raw, pa.binary())], names=["shard", "raw"])

        for batch in batches:
            for part in entries(batch):
                held.append(part)
                n += len(part[0])
                if n >= GATHER:
                    n = 0
                    yield flush()
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        key, a, b, flag = _unpack(table.column("raw").to_pylist(), width)
        if table.column("shard")[0].as_py() >= 0:
            order = np.argsort(key, kind="stable")
            key, a, b, flag = key[order], a[order], b[order], flag[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([first, [len(key)]]))
            if once:
                several = (np.minimum.reduceat(a, first) != np.maximum.reduceat(a, first)) | (np.maximum.reduceat(flag, first) > 0)
            else:
                several = count > 1
            keep = np.repeat(several, count) & (flag == 0)
            key, a, b = key[keep], a[keep], b[keep]
        return pa.table({"key": pa.array(key.view(np.int64)), "a": pa.array(a.view(np.int64)), "b": pa.array(b.astype(np.int64))})

    return map_arrow(texts, gather, "shard int, raw binary").groupBy("shard").applyInArrow(merge, "key long, a long, b long")


def wanted_bits(keys: DataFrame, key: str):
    """A broadcast filter of the 64-bit ``key`` column, of ``FILTER_BITS`` bits whatever the number of keys.

    The more keys, the more others pass it too, so it only ever saves work.
    """
    bit = F.pmod(F.col(key), F.lit(FILTER_BITS))
    each = keys.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("one"))
    found = each.groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    made = np.zeros(FILTER_BITS // 64, np.int64)
    made[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(made)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be wanted."""
    at = keys.view(np.uint64) & _U(FILTER_BITS - 1)
    return ((bits.view(np.uint64)[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).astype(bool)
