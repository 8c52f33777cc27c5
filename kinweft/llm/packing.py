"""Best-fit packing by the sum of squares.

A piece goes where the sum, over all residual gaps, of the squared number of open bins with that gap
becomes smallest, and into a new bin only where it fits into none.  The rule keeps all gaps about equally
common, so that some bin fits almost anything.  It is an online rule whose state is one count for each gap;
pieces are dealt into groups of bounded size and each group is packed by itself, long pieces first.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import durable, free, map_arrow
from kinweft.llm.tokenization import ByteLevelIds

#: Pieces that one group packs: a task holds about 1 MB of lengths, whatever the corpus.
GROUP = 40_000


class SumOfSquares:
    """Open bins of one size, counted by residual gap."""

    def __init__(self, size: int):
        self.size = size
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = np.zeros(size + 1, np.int64)
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``, 1 to the bins' size."""
        n, size = self.count, self.size
        # a piece that leaves gap g - length for gap g changes the sum by 2 (N[g - length] - N[g] + 1), or
        # by 1 - 2 N[g] if it fills the bin
        change = 2 * (n[: size - length + 1] - n[length:]) + 2
        change[0] = 1 - 2 * n[length]
        change[n[length:] == 0] = 1 << 40
        best = int(change.argmin())
        if change[best] < 1 << 40:
            gap = best + length
            at = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, at = size, self.bins
            self.bins += 1
        left = gap - length
        if left:
            self.open[left].append(at)
            n[left] += 1
        return at, size - gap


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each of the lengths (all 1 to ``size``), packed long ones first."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rule = SumOfSquares(size)
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i], offsets[i] = rule.place(length)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of every row of ``docs``, cut into at most ``size`` ids."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = ByteLevelIds(tokenizer)
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = ids.encode(text or "") + stop
                    n = len(raw) // 4
                    at = 0
                    for piece in range(-(-n // size)):
                        to = n - (-(-n // size) - 1 - piece) * size
                        for col, x in zip(out, (doc, piece, at, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                            col.append(x)
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(out)], names=["a", "b", "c", "d", "e"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to ``size``) and the columns ``sequence_id`` and ``offset``.

    Offsets in a sequence run from 0 without gaps.  Full pieces have a sequence each.  ``pieces`` must be a
    table that can be read again; its rows are dealt to groups by a hash of the whole row, repeated rows too.
    Null lengths count as 1.  Columns of those names in ``pieces`` are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // group))
    last = len(pieces.columns)
    at = pieces.columns.index("length")

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column(at).fill_null(1).to_numpy().astype(np.int64)
        bins, offsets = pack_lengths(lengths, size)
        number = table.column(last).to_numpy().astype(np.int64)
        return pa.table([*table.columns[:last], pa.array((number << 40) + bins), pa.array(offsets)], names=[*table.column_names[:last], "sequence_id", "offset"])

    name = free("group", pieces.columns)
    dealt = pieces.withColumn(name, F.expr(f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in pieces.columns)}, monotonically_increasing_id()), {groups}) as int)"))
    return dealt.groupBy(name).applyInArrow(run, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def packed_documents(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): every document's ids packed into sequences.

    A document is its ids and ``end``; a null text is an empty one and so a document of one id.  A document
    longer than ``size`` is cut so that only its first piece may be shorter.  Repeated rows are packed as often
    as they occur; other columns are ignored; an empty table gives no rows.
    """
    return pack(durable(token_pieces(docs, tokenizer, end, size, id_col, text_col), "pieces"), size)
