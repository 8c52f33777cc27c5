"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Documents are partitioned by the size of their shingle set, in powers of two.  In the partition of
sets of up to ``u`` shingles a signature has ``SPREAD * u`` coordinates: a hash puts each shingle in one,
and the coordinate keeps the smallest value.  The longer the document, the longer its signature, so a
short item's minima survive in it with the same chance whatever the size (98 % at least for each shared
shingle; a contained item of four shared shingles is missed in fewer than one case in a million).  Items
are posted under their own minima for each partition; a collision makes a candidate, and the share of
the item's shingles in the document, counted exactly, decides.

Of a document's signature, only the coordinates at which some item is posted are worked out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import durable, map_arrow
from kinweft.llm.textpack import blocks, mix, sets, shingles, words

NUMERATOR, DENOMINATOR = 75, 100
SPREAD_BITS = 5
#: Items of fewer shingles than this are posted under every shingle, so that none is missed.
FEW = 3
#: Bytes of item shingles that one pass over the documents searches for; more items take more passes.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22


class ItemIndex:
    """The items of one block: shingles in order, the item of each, and who is a minimum where."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(raw, np.uint64) for _, raw in items]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        owner = np.repeat(np.arange(len(items)), self.sizes)
        flat = np.concatenate(self.sets) if items else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.value, self.owner = flat[order], owner[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.value >> np.uint64(64 - _FILTER_BITS)] = True
        self.posted: dict[int, np.ndarray] = {}

    @staticmethod
    def coordinate(values: np.ndarray, part: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - min(60, part + SPREAD_BITS))

    def minima(self, part: int) -> np.ndarray:
        """For each posting, whether it is its item's minimum at its coordinate in this partition."""
        if part not in self.posted:
            slot = self.coordinate(self.value, part)
            order = np.lexsort((self.value, slot, self.owner))
            first = np.ones(len(order), bool)
            first[1:] = (self.owner[order][1:] != self.owner[order][:-1]) | (slot[order][1:] != slot[order][:-1])
            made = np.zeros(len(order), bool)
            made[order] = first
            self.posted[part] = made | (self.sizes[self.owner] < FEW)
        return self.posted[part]

    def maybe(self, values: np.ndarray) -> np.ndarray:
        """Which values may be item shingles."""
        return self.seen[values >> np.uint64(64 - _FILTER_BITS)]

    def search(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a set of shingles (sorted) contains enough of."""
        few = doc[self.maybe(doc)]
        lo, hi = np.searchsorted(self.value, few, "left"), np.searchsorted(self.value, few, "right")
        few, lo, hi = few[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(few):
            return []
        part = int(len(doc) - 1).bit_length()
        slots, mine = self.coordinate(doc, part), self.coordinate(few, part)
        order = np.argsort(slots, kind="stable")  # values ascend, so the first of a slot is its minimum
        least = doc[order[np.searchsorted(slots[order], mine)]] == few
        posted = self.minima(part)
        found: set[int] = set()
        for a, b, top in zip(lo, hi, least, strict=True):
            at = np.arange(a, b)
            found.update(self.owner[at[posted[a:b] & (top | (self.sizes[self.owner[a:b]] < FEW))]].tolist())
        out = []
        for i in sorted(found):
            s = self.sets[i]
            at = np.minimum(np.searchsorted(doc, s), len(doc) - 1)
            both = int((doc[at] == s).sum())
            if DENOMINATOR * both >= NUMERATOR * len(s):
                out.append((i, both))
        return out


def _hits(batch_column: pa.Array, index: ItemIndex):
    """(row, [(item, shared)]) of the texts of a column that contain an item."""
    for first, _, buf, offs in blocks(batch_column):
        s, to = shingles(*words(buf, offs))
        may = np.flatnonzero(index.maybe(s))
        for d in np.unique(np.searchsorted(to, may, "right") - 1):
            if found := index.search(np.unique(s[to[d] : to[d + 1]])):
                yield first + int(d), found


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast indexes of the items, each of a bounded number of bytes."""

    def run(batches):
        for batch in batches:
            raw = [s.tobytes() for s in sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["item", "shingles"])

    made = map_arrow(items.select(F.col(item_col).cast("long"), F.col(text_col).cast("binary")), run, "item long, shingles binary").where("length(shingles) > 0").distinct()
    made = durable(made, "items")
    size = made.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    context = items.sparkSession.sparkContext
    for b in range(n):
        rows = made.where(F.expr(f"pmod(xxhash64(shingles), {n}) = {b}")).collect()
        if rows:
            yield context.broadcast(sorted((r.item if r.item is not None else -1, bytes(r.shingles), r.item is None) for r in rows))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, n_item_shingles, n_shared): each row of ``docs`` with each item it contains.

    A document contains an item if it has at least 75 % of the item's distinct five-word shingles.
    Items or documents that are null, empty or without words take no part.  An item of fewer than five
    words is one shingle, which only a document of the same few words has.  Repeated rows of ``docs``
    give repeated rows; repeated items with one id count once.  Other columns are ignored.
    """
    out = None
    for held in item_blocks(items, item_col, item_text_col):

        def run(batches, held=held):
            rows = held.value
            index = ItemIndex([(i, s) for i, s, _ in rows])
            for batch in batches:
                ids, found, size, both = [], [], [], []
                for row, hits in _hits(batch.column(1), index):
                    for i, shared in hits:
                        ids.append(batch.column(0)[row].as_py())
                        found.append(None if rows[i][2] else rows[i][0])
                        size.append(int(index.sizes[i]))
                        both.append(shared)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, found, size, both)], names=["a", "b", "c", "d"])

        part = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")), run, f"`{id_col}` long, `{item_col}` long, n_item_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` long, `{item_col}` long, n_item_shingles long, n_shared long")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they were."""
    at = docs.columns.index(text_col)
    for held in item_blocks(items, item_col, item_text_col):

        def run(batches, held=held):
            index = ItemIndex([(i, s) for i, s, _ in held.value])
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _ in _hits(batch.column(at), index):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs
