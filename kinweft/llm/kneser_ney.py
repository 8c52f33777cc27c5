"""Interpolated modified Kneser-Ney bigrams, counted in Spark and kept as sorted hash arrays.

Counting.  Every task turns its training texts into (context, word) pairs of 48-bit fingerprints, adds up
equal pairs and sends them, sorted by a 64-bit hash of the pair, to the shard of that hash.  Shards are even
whatever the commonest word, since they are cut by pair.  A shard adds up its pairs, writes their hashes and
counts as sorted arrays, and passes on, for each word, in how many contexts it occurs and how its own pairs
divide; these go to shards of words, which write arrays of their own.

Scoring.  Workers map the arrays into memory and look up each block of texts by binary search.  Nothing of the
model is sent to the driver but a dozen totals.

    p(w | u) = max(c(u, w) - D(c(u, w)), 0) / c(u) + gamma(u) p(w)
    p(w)     = max(k(w) - E(k(w)), 0) / K + lambda / (V + 1),   k(w): the contexts of w,  K: their sum

with the usual three discounts of either order.  A context never seen leaves p(w).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import map_arrow, new_path
from kinweft.llm.textpack import blocks, mix, words

_U = np.uint64
BITS = 48
#: Fingerprints of the text's start (never predicted) and end (a token); words have others.
START, END = _U(1), _U(2)
#: Pairs that a task gathers before it adds them up, and bytes of text for each shard.
GATHER = 2_000_000
SHARD_BYTES = 16 << 20
#: Shards of each kind that a worker keeps mapped.
MAPS = 4096


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _U(0x9E3779B97F4A7C15) + word * _U(0xC2B2AE3D27D4EB4F))


def pairs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, first pair of each text and one more): each text's words after its start, then its end."""
    h, at = words(buf, offs)
    n = np.diff(at)
    to = np.concatenate([[0], np.cumsum(n + 1)])
    word = np.empty(to[-1], _U)
    inner = np.ones(to[-1], bool)
    inner[to[1:] - 1] = False
    word[inner] = (h >> _U(64 - BITS)) | _U(4)
    word[~inner] = END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[to[:-1]] = START
    return context, word, to


def _narrow(x: np.ndarray) -> list[np.ndarray]:
    return [(x & _U(0xFFFFFFFF)).astype("<u4"), (x >> _U(32)).astype("<u2")]


def _pack(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(arrays[0])], "<u8").tobytes() + b"".join(a.tobytes() for a in arrays)


def _pack_pairs(context: np.ndarray, word: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs by context, contexts as differences, which are smaller."""
    order = np.argsort(context)
    context = context[order]
    context[1:] -= context[:-1].copy()
    return _pack([*_narrow(context), *_narrow(word[order]), times[order].astype("<u4")])


def _unpack_pairs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, words, counts = [], [], []
    for x in raw:
        c_lo, c_hi, w_lo, w_hi, times = _unpack([x], _PAIR_KINDS)
        contexts.append(np.cumsum(c_lo.astype(_U) | (c_hi.astype(_U) << _U(32)), dtype=_U))
        words.append(w_lo.astype(_U) | (w_hi.astype(_U) << _U(32)))
        counts.append(times)
    return np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)


def _unpack(raw: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for x in raw:
        n, at = int(np.frombuffer(x, "<u8", 1)[0]), 8
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def _sum(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order by key, the first place of each distinct key, and the values added up for each."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, first, [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


_PAIR_KINDS = ("<u4", "<u2", "<u4", "<u2", "<u4")
_WORD_KINDS = ("<u4", "<u2", "<u4", "<u8", "<u4", "<u4", "<u4", "<u8")  # key, k, count, n1, n2, n3, total


def _split(sorted_key: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys of so many bits, and the end."""
    log = shards.bit_length() - 1
    return np.searchsorted(sorted_key >> _U(bits - log), np.arange(shards + 1, dtype=_U)) if log else np.array([0, len(sorted_key)])


class Folder:
    """A folder in a file system that all workers see; files are written whole or not at all."""

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlsplit(uri)
        self.local = parts.path if parts.scheme in ("", "file") else None

    def write(self, name: str, arrays: list[np.ndarray]) -> None:
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                for a in arrays:
                    f.write(np.array([a.nbytes, a.itemsize], "<u8").tobytes())
                    f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
            os.replace(part, f"{self.local}/{name}")
            return
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/.{name}-{(tag := uuid.uuid4().hex)}") as f:
            for a in arrays:
                f.write(np.array([a.nbytes, a.itemsize], "<u8").tobytes())
                f.write(np.ascontiguousarray(a).tobytes())
        system.move(f"{path}/.{name}-{tag}", f"{path}/{name}")

    def map(self, name: str) -> list[np.ndarray] | None:
        """The arrays of unsigned numbers in a file, mapped into memory; None if there is no such file."""
        path = f"{self.local}/{name}"
        if self.local is None:
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(self.uri)
            if system.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                return None
            held = tempfile.TemporaryFile()
            with system.open_input_stream(f"{base}/{name}") as f:
                while chunk := f.read(8 << 20):
                    held.write(chunk)
            held.flush()
            raw = np.memmap(held, np.uint8, "r")
        elif not os.path.exists(path):
            return None
        else:
            raw = np.memmap(path, np.uint8, "r")
        out, at = [], 0
        while at < len(raw):
            n, width = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
            out.append(np.frombuffer(raw, f"<u{width}", n // width, at + 16) if n else np.zeros(0, f"<u{width}"))
            at += 16 + n
        return out


@dataclass(frozen=True)
class Model:
    """Where a model's arrays are, and its totals."""

    uri: str
    shards: int
    tokens: int
    types: int
    contexts: int
    pair_counts: tuple[int, int, int, int]
    word_counts: tuple[int, int, int, int]

    @staticmethod
    def discounts(n: tuple[int, int, int, int]) -> np.ndarray:
        """The discounts of counts 0, 1, 2 and more, from the numbers of entries with counts 1 to 4."""
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        made = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
            made.append(min(max(d, 0.05), k - 0.05))
        return np.array(made)


def train(docs: DataFrame, training: Column, text_col: str = "text") -> Model:
    """A model of the rows of ``docs`` for which ``training`` holds (null: it does not)."""
    spark = docs.sparkSession
    uri = new_path(spark, "lm")
    texts = docs.where(training).select(F.col(text_col).cast("binary"))
    size = texts.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    shards = 1 << max(0, int(-(-size // SHARD_BYTES)) - 1).bit_length()

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            context, word = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held.clear()
            key = _pair(context, word)
            order, first, (times,) = _sum(key, [np.ones(len(key), np.uint32)])
            key, context, word = key[order[first]], context[order[first]], word[order[first]]
            cut = _split(key, 64, shards)
            rows = [s for s in range(shards) if cut[s + 1] > cut[s]]
            raw = [_pack_pairs(context[cut[s] : cut[s + 1]], word[cut[s] : cut[s + 1]], times[cut[s] : cut[s + 1]]) for s in rows]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(raw, pa.binary())], names=["shard", "raw"])

        for batch in batches:
            for _, _, buf, offs in blocks(batch.column(0)):
                context, word, _ = pairs(buf, offs)
                held.append((context, word))
                n += len(word)
                if n >= GATHER:
                    n = 0
                    yield flush()
        if held:
            yield flush()

    def merge_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        context, word, times = _unpack_pairs(table.column("raw").to_pylist())
        key = _pair(context, word)
        order, first, (times,) = _sum(key, [times.astype(_U)])
        order = order[first]
        key, context, word = key[order], context[order], word[order]
        more = times[times > 1]
        Folder(uri).write(f"pairs-{shard}", [key[times == 1], key[times > 1], more.astype("<u4" if not len(more) or more.max() <= 0xFFFFFFFF else "<u8")])
        totals = [int((times == k).sum()) for k in (1, 2, 3, 4)]
        del key, order, first
        names = np.concatenate([word, context])
        n = len(word)
        del context, word
        order = np.argsort(names)
        names = names[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        back, order = order < n, order % max(n, 1)
        fields = []
        for kind, side, values in (("<u4", True, None), ("<u8", True, times), ("<u4", False, times == 1), ("<u4", False, times == 2), ("<u4", False, times > 2), ("<u8", False, times)):
            x = (back == side).astype(_U) if values is None else np.where(back == side, values.astype(_U)[order], _U(0))
            fields.append((np.add.reduceat(x, first) if len(first) else x).astype(kind))
        names = names[first]
        cut = _split(names, BITS, shards)
        rows = [s for s in range(shards) if cut[s + 1] > cut[s]]
        raw = [zlib.compress(_pack([*_narrow(names[cut[s] : cut[s + 1]]), *(f[cut[s] : cut[s + 1]] for f in fields)]), 1) for s in rows]
        return pa.table({"shard": pa.array([*rows, -1], pa.int32()), "raw": pa.array([*raw, np.array(totals, "<i8").tobytes()], pa.binary())})

    def merge_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        raw = table.column("raw").to_pylist()
        if shard < 0:
            totals = np.sum([np.frombuffer(x, "<i8") for x in raw], axis=0).tolist() + [0] * 7
        else:
            lo, hi, *fields = _unpack([zlib.decompress(x) for x in raw], _WORD_KINDS)
            names = lo.astype(_U) | (hi.astype(_U) << _U(32))
            order, first, fields = _sum(names, [f.astype(_U) for f in fields])
            names = names[order[first]]
            Folder(uri).write(f"words-{shard}", [names, *(np.minimum(f, 0xFFFFFFFF).astype("<u4") if len(f) and f.max() <= 0xFFFFFFFF else f for f in fields)])
            k, times = fields[0], fields[1]
            totals = [0] * 4 + [int(times.sum()), int((times > 0).sum()), int(k.sum()), *(int((k == i).sum()) for i in (1, 2, 3, 4))]
        return pa.table({"totals": pa.array([totals], pa.list_(pa.int64()))})

    merged = map_arrow(texts, count, "shard int, raw binary").groupBy("shard").applyInArrow(merge_pairs, "shard int, raw binary")
    total = merged.groupBy("shard").applyInArrow(merge_words, "totals array<long>")
    t = [int(x) for x in total.agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(11)]).first()]
    return Model(uri, shards, t[4], t[5], t[6], tuple(t[:4]), tuple(t[7:]))


class Scorer:
    """A model's arrays in this worker."""

    def __init__(self, model: Model):
        self.model, folder = model, Folder(model.uri)
        # a shard is mapped when a key of it is asked for, and only so many stay mapped
        self.pairs, self.words = (lru_cache(MAPS)(lambda s, kind=kind: folder.map(f"{kind}-{s}")) for kind in ("pairs", "words"))
        self.pair_discount, self.word_discount = Model.discounts(model.pair_counts), Model.discounts(model.word_counts)
        n1, n2, _, _ = model.word_counts
        e = self.word_discount
        more = int(model.types - n1 - n2)
        self.rest = (e[1] * n1 + e[2] * n2 + e[3] * more) / max(model.contexts, 1) / (model.types + 1) if model.contexts else 1.0

    def _find(self, key: np.ndarray, bits: int, shard: Callable[[int], Sequence[np.ndarray] | None], fields: int) -> list[np.ndarray]:
        """Fields of sorted distinct keys; zeros for keys that are not there."""
        out = [np.zeros(len(key), np.float64) for _ in range(fields)]
        cut = _split(key, bits, self.model.shards)
        for s in range(self.model.shards):
            a, b = cut[s], cut[s + 1]
            arrays = shard(s) if b > a else None
            if arrays is not None and len(arrays[0]):
                at = np.minimum(np.searchsorted(arrays[0], key[a:b]), len(arrays[0]) - 1)
                hit = arrays[0][at] == key[a:b]
                for o, values in zip(out, arrays[1:], strict=False):
                    o[a:b][hit] = values[at[hit]]
        return out

    def pair_count(self, key: np.ndarray) -> np.ndarray:
        (once,) = self._find(key, 64, lambda s: None if (x := self.pairs(s)) is None else (x[0], np.broadcast_to(np.float64(1), len(x[0]))), 1)
        (more,) = self._find(key, 64, lambda s: None if (x := self.pairs(s)) is None else x[1:], 1)
        return once + more

    def score(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of the word in training, log10 p(word | context)) of every pair."""
        names, back = np.unique(np.concatenate([word, context]), return_inverse=True)
        k, times, n1, n2, n3, total = self._find(names, BITS, self.words, 6)
        m = self.model
        low = np.maximum(k - self.word_discount[np.minimum(k, 3).astype(int)], 0) / max(m.contexts, 1) + self.rest
        d = self.pair_discount
        gamma = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1), 1.0)
        w, u = back[: len(word)], back[len(word) :]
        key, where = np.unique(_pair(context, word), return_inverse=True)
        c = self.pair_count(key)[where]
        p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / np.maximum(total[u], 1) + gamma[u] * low[w]
        return times[w], np.log10(p)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: the remainder by 7 of the CRC-32 of its id as text is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words and one end; a null or empty text has the end only.  ``base_score`` is the add-one unigram
    log10 probability, ``score`` that of the model.  A null id counts as an empty one (and so as training).
    Repeated rows give repeated rows; other columns are ignored.
    """
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for _, _, buf, offs in blocks(batch.column(2), 4 << 20):
                context, word, to = pairs(buf, offs)
                times, score = scorer.score(context, word)
                base = np.log10((times + 1) / (model.tokens + 1 * (model.types + 1)))
                for o, x in zip(out, (np.diff(to), np.add.reduceat((times > 0).astype(np.int64), to[:-1]), np.add.reduceat(base, to[:-1]), np.add.reduceat(score, to[:-1])), strict=True):
                    o.append(x)
            n, known, base, score = (np.concatenate(o) if o else np.zeros(0) for o in out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(batch.num_rows, model.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=names)

    rows = docs.select(F.col(id_col).cast("long"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary"))
    return map_arrow(rows, run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
