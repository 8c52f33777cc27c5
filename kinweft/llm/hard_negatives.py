"""Hard negatives of anchors by a vector-approximation file.

Rows are packed into blocks.  In each, every dimension is cut into 16 cells that hold about equally many of the
block's components; a row is kept as its cells (half a byte each) beside its exact components.  For an anchor, a table
of the least and the greatest product of its component with each cell gives a lower and an upper bound of the score of
every row by look-ups alone; only rows whose bounds may let them in are scored exactly.

The anchors are a stated query set.  They pass over the file in chunks that were measured to fit a broadcast, each
chunk meeting the blocks where these are, and each task keeps one short list for an anchor (or anchor and positive)
over all blocks that it reads.  First pass: the best rows of the anchor's label.  Second pass: for each positive, the
best rows of other labels within the window of scores that the positive's score opens.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.llm import shared
from kinweft.llm.shared import durable, map_arrow

SCALE = 256
CELLS = 16
#: Rows of a block of the file, and of anchors.
BLOCK, ANCHORS = 1024, 512
#: Integer scores are exact in doubles below the first, in 64-bit integers below the second.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62
#: Stands for a null id, which comes last among equal scores.
NO_ID = (1 << 63) - 1
_FILE = "block long, size int, dims int, ids binary, labels binary, kind string, exact binary, cells binary, least binary, most binary"


def _integers(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of components to a matrix of floor(SCALE * x) as doubles; missing ones are 0."""
    made = np.zeros((len(parts), max(map(len, parts), default=0)))
    for i, x in enumerate(parts):
        made[i, : len(x)] = np.floor(np.asarray(x, np.float64) * SCALE)
    if not np.isfinite(made).all():
        raise OverflowError("a component is too large for an exact score")
    return made


def _pack(size: int, with_cells: bool):
    """Rows (id, label, vector) to blocks of ``size`` rows, sorted by label."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, labels, vectors = [], [], []

        def block():
            nonlocal number
            order = sorted(range(len(ids)), key=lambda i: labels[i])
            x = _integers([vectors[i] for i in order])
            if x.shape[1] % 2:
                x = np.hstack([x, np.zeros((len(x), 1))])
            large = np.abs(x).max(initial=0)
            kind = "int16" if large < 1 << 15 else "int32" if large < 1 << 31 else "float64"
            cells = least = most = b""
            if with_cells:
                y = np.sort(x, axis=0)
                marks = y[[len(y) * k // CELLS for k in range(1, CELLS)]]  # a cell begins at its mark
                code = (x[None] >= marks[:, None]).sum(axis=0).astype(np.uint8).T if x.size else np.zeros((0, len(x)), np.uint8)
                low, high = np.zeros((x.shape[1], CELLS)), np.zeros((x.shape[1], CELLS))
                for c in range(CELLS):
                    inside = code.T == c
                    some = inside.any(axis=0)
                    low[some, c] = np.where(inside, x, np.inf).min(axis=0)[some]
                    high[some, c] = np.where(inside, x, -np.inf).max(axis=0)[some]
                cells, least, most = (code[0::2] * CELLS + code[1::2]).tobytes(), low.tobytes(), high.tobytes()
            held = (number, len(x), x.shape[1], np.array([ids[i] for i in order], np.int64).tobytes(), np.array([labels[i] for i in order], np.int64).tobytes(), kind, x.astype(kind).tobytes(), cells, least, most)
            number += 1
            for z in (ids, labels, vectors):
                z.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held, kinds, strict=True)], names=["block", "size", "dims", "ids", "labels", "kind", "exact", "cells", "least", "most"])

        for batch in batches:
            for k, label, vector in zip(batch.column("id"), batch.column("label"), batch.column("vector"), strict=True):
                ids.append(NO_ID if k.as_py() is None else k.as_py())
                labels.append(label.as_py())
                vectors.append(vector.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return run


class _Block:
    """A block of the file or of anchors, unpacked."""

    def __init__(self, row: dict):
        self.size, self.dims = row["size"], row["dims"]
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        self.x = np.frombuffer(row["exact"], row["kind"]).reshape(self.size, self.dims).astype(np.float64)
        self.large = int(np.abs(self.x).max(initial=0))
        if row["cells"] or not self.dims:
            self.cells = np.frombuffer(row["cells"], np.uint8).reshape(self.dims // 2, self.size).astype(np.intp) + CELLS * CELLS * np.arange(self.dims // 2)[:, None]
            self.least, self.most = (np.frombuffer(row[k]).reshape(self.dims, CELLS) for k in ("least", "most"))


class _Meeting:
    """A block of the file and a block of anchors: bounds by look-up, and exact scores."""

    def __init__(self, block: _Block, anchors: _Block):
        self.block, self.anchors = block, anchors
        self.dims = min(block.dims, anchors.dims)  # components that one of them lacks are 0
        most = block.large * anchors.large * max(self.dims, 1)
        self.kind = np.float64 if most < EXACT_DOUBLE else np.int64 if most < EXACT_LONG else object
        whole = (lambda x: x) if self.kind is np.float64 else (lambda x: x.astype(np.int64)) if self.kind is np.int64 else lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
        self.x, self.q = whole(block.x[:, : self.dims]), whole(anchors.x[:, : self.dims])
        self.least, self.most = whole(block.least[: self.dims]), whole(block.most[: self.dims])
        self.cells = block.cells[: self.dims // 2]

    def bounds(self, i: int, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower and upper bounds of the scores of ``rows`` with anchor ``i``."""
        one, two = self.q[i][:, None] * self.least, self.q[i][:, None] * self.most
        cells = self.cells[:, rows]
        found = []
        for t in (np.minimum(one, two), np.maximum(one, two)):
            pairs = (t[0::2, :, None] + t[1::2, None, :]).reshape(-1)  # one look-up for two dimensions
            found.append(pairs[cells].sum(axis=0) if len(cells) else np.zeros(cells.shape[1], self.kind))
        return found[0], found[1]

    def scores(self, i: int, rows: np.ndarray) -> list[int]:
        made = self.x[rows] @ self.q[i] if self.dims else np.zeros(len(rows))
        return [int(v) for v in made]


class _Best:
    """The ``k`` best (score descending, id ascending) of what is offered."""

    __slots__ = ("k", "held")

    def __init__(self, k: int):
        self.k, self.held = k, []  # a heap of (score, -id), the worst first

    def offer(self, scores, ids) -> None:
        for s, i in zip(scores, ids, strict=True):
            if len(self.held) < self.k:
                heapq.heappush(self.held, (s, -i))
            elif (s, -i) > self.held[0]:
                heapq.heapreplace(self.held, (s, -i))

    def worst(self):
        """The score that a row must have to come in, or None while there is room."""
        return self.held[0][0] if len(self.held) == self.k else None


def _largest(values: np.ndarray, k: int):
    """The ``k``-th largest of ``values``, or None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k > 0 else None


def _enough(upper: np.ndarray, sure: np.ndarray, best: _Best) -> np.ndarray:
    """Which rows may come in by their upper bounds; ``sure`` are lower bounds of rows that are in the running."""
    may = np.ones(len(upper), bool)
    for least in (best.worst(), _largest(sure, best.k)):
        if least is not None:
            may &= upper >= least
    return may


_PAIR = ("size", "dims", "ids", "labels", "kind", "exact", "cells", "least", "most")


def _meetings(batches):
    """(meeting, block number of the anchors, the windows told with them) of joined rows; blocks are unpacked once."""
    last, block, held = None, None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != last:
                last, block = row["block"], _Block(row)
            if row["a_block"] not in held:
                held[row["a_block"]] = _Block({k: row["a_" + k] for k in _PAIR})
            yield _Meeting(block, held[row["a_block"]]), row["a_block"], row.get("a_wanted")


def _emit(rows, names, kinds):
    for at in range(0, len(rows), 20_000):
        cols = list(zip(*rows[at : at + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _same_label(k: int):
    """The ``k + 1`` best rows of each anchor's label; the anchor itself is one of the rows, and told as ``own``."""

    def run(batches):
        best: dict[tuple[int, int], _Best] = {}
        about: dict[tuple[int, int], tuple[int, int]] = {}
        for m, a, _ in _meetings(batches):
            for i in range(m.anchors.size):
                label = m.anchors.labels[i]
                lo, hi = np.searchsorted(m.block.labels, label, "left"), np.searchsorted(m.block.labels, label, "right")
                if (a, i) not in about:
                    about[a, i] = (int(m.anchors.ids[i]), sum(int(v) ** 2 for v in m.anchors.x[i]))
                    best[a, i] = _Best(k + 1)
                if lo == hi:
                    continue
                lower, upper = m.bounds(i, slice(lo, hi))
                at = lo + np.flatnonzero(_enough(upper, lower, best[a, i]))
                if len(at):
                    best[a, i].offer(m.scores(i, at), m.block.ids[at].tolist())
        rows = [(a, i, about[a, i][0], -j, s, -j == about[a, i][0] and s == about[a, i][1]) for (a, i), b in best.items() for s, j in b.held]
        yield from _emit(rows, ["a_block", "i", "anchor", "id", "score", "own"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))

    return run


def _other_labels(k: int, low: int, high: int):
    """For each anchor and positive the ``k`` best rows of other labels in the positive's window."""

    def run(batches):
        best: dict[tuple[int, int, int], _Best] = {}
        for m, a, wanted in _meetings(batches):
            of: dict[int, list[tuple[int, int]]] = {}
            for w in wanted:
                of.setdefault(w["i"], []).append((w["k"], w["score"]))
            for i, positives in of.items():
                label = m.anchors.labels[i]
                lo, hi = np.searchsorted(m.block.labels, label, "left"), np.searchsorted(m.block.labels, label, "right")
                rows = np.r_[0:lo, hi : m.block.size]
                windows = [(n, -(-low * s // 100), high * s // 100) for n, s in positives]
                windows = [w for w in windows if w[1] <= w[2]]
                if not len(rows) or not windows:
                    continue
                lower, upper = m.bounds(i, rows)
                asked = []
                for n, least, most in windows:
                    b = best.setdefault((a, i, n), _Best(k))
                    sure = lower[(lower >= least) & (upper <= most)]
                    asked.append((upper >= least) & (lower <= most) & _enough(upper, sure, b))
                at = np.flatnonzero(np.logical_or.reduce(asked))
                if not len(at):
                    continue
                scores = m.scores(i, rows[at])
                ids = m.block.ids[rows[at]].tolist()
                for n, least, most in windows:
                    some = [(s, j) for s, j in zip(scores, ids, strict=True) if least <= s <= most]
                    best[a, i, n].offer([s for s, _ in some], [j for _, j in some])
        rows = [(a, i, n, -j, s) for (a, i, n), b in best.items() for s, j in b.held]
        yield from _emit(rows, ["a_block", "i", "k", "id", "score"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))

    return run


def _passes(file: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of every block of the file with every block of anchors, in passes of bounded broadcasts."""
    size = sum((F.octet_length(c) for c in ("ids", "labels", "exact")), F.lit(64)) + (F.lit(32) * F.greatest(F.size("wanted"), F.lit(0)) if "wanted" in anchors.columns else F.lit(0))
    sized = anchors.select("*", size.cast("long").alias("bytes"))
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    chunks = -(-total // shared.BROADCAST_BYTES)
    while chunks > 1:
        dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
        if dealt.groupBy("chunk").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where((F.col("b") > shared.BROADCAST_BYTES) & (F.col("n") > 1)).isEmpty():
            break
        chunks *= 2
    named = [F.col(c).alias("a_" + c) for c in anchors.columns]
    made = []
    for c in range(max(chunks, 1)):
        one = sized.where(F.pmod(F.xxhash64("block"), F.lit(max(chunks, 1))) == c).select(F.lit(c).alias("pass"), *named)
        met = file.withColumn("pass", F.explode(F.array(F.lit(c)))).join(F.broadcast(one), "pass")
        made.append(durable(map_arrow(met, run, schema), "pass"))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each key, as ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    A component x counts as floor(256 * x), a score is the integer inner product of two rows.  An anchor's positives
    are its ``positives`` best other rows of its label; for each of them the ``negatives`` best rows of other labels
    with ``low`` % to ``high`` % of the positive's score are returned, ties by the smaller id.  Rows with a null
    label or vector or with a null or non-finite component take no part.  Vectors may differ in length: a missing
    component is 0.  Rows with a null id come last among equal scores and give a null id.  Repeated rows are rows of
    their own, anchors too.  An empty table or one without anchors gives an empty result; other columns are ignored,
    whatever they are called.  A score that no 64-bit integer holds is an error.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    whole = F.col(f"`{label_col}`").isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    taken = rows.where(whole).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    file = durable(map_arrow(taken.drop("anchor"), _pack(BLOCK, True), _FILE).repartition(tasks), "vector-file")
    anchors = durable(map_arrow(taken.where("anchor").drop("anchor").repartition(max(1, tasks // 8)), _pack(ANCHORS, False), _FILE).drop("cells", "least", "most").withColumns({c: F.lit(b"") for c in ("cells", "least", "most")}), "anchors")

    near = _first(_passes(file, anchors, _same_label(positives), "a_block long, i int, anchor long, id long, score long, own boolean"), ["a_block", "i"], positives + 1)
    # of the rows that look like the anchor itself one is the anchor
    by = Window.partitionBy("a_block", "i").orderBy("rank")
    near = near.withColumn("owns", F.sum(F.col("own").cast("int")).over(by)).where(~(F.col("own") & (F.col("owns") == 1)))
    near = near.withColumn("k", F.row_number().over(by)).where(F.col("k") <= positives)
    near = durable(near.select("a_block", "i", "k", "anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")

    wanted = near.groupBy("a_block").agg(F.collect_list(F.struct("i", "k", F.col("positive_score").alias("score"))).alias("wanted"))
    asking = durable(anchors.join(wanted.withColumnRenamed("a_block", "block"), "block"), "asking")
    found = _first(_passes(file, asking, _other_labels(negatives, low, high), "a_block long, i int, k int, id long, score long"), ["a_block", "i", "k"], negatives)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    joined = found.join(near, ["a_block", "i", "k"])
    return joined.select(F.col("anchor").alias("anchor_id"), known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def sql() -> str:
    """DuckDB SQL over all pairs of an anchor and a row, with the numbers of the query."""
    return """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM r a JOIN r b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""
