"""Repeated passages: MinHash banding of paragraphs, and runs of words that recur verbatim anywhere in a text.

A paragraph is a line (texts are split at ``\\n``) of at least ``MIN_WORDS`` words, or neighbouring shorter lines
that have so many together.  Its five-word shingles give a signature of ``BANDS`` bands of ``ROWS`` minima; two
paragraphs of similarity 0.75 miss each other in all bands with a chance of 5e-5.  Paragraphs that collide are
verified on their full sets and clustered by components; of each cluster the first paragraph, by document id and
place, is kept and the others are removals.

Runs have nothing to do with lines.  Of every ``SPREAD`` neighbouring windows of ``RUN`` words the one of least hash
is a unit, so two texts that share ``RUN + SPREAD - 1`` words (50) share a unit, wherever these words stand in
either; runs of ``RUN`` words or more may.  Units are equal or not: there is no candidate step.  Of each unit the
first occurrence is kept, one outside removed paragraphs if there is any.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweft.llm.components import components
from kinweft.llm.linking import connect
from kinweft.llm.recurring import maybe, recurring, wanted_bits
from kinweft.llm.shared import durable, free, map_arrow
from kinweft.llm.textpack import WIDTH, blocks, constants, mix, shingles, windows, words

MIN_WORDS = 40
BANDS, ROWS = 12, 2
#: Words of a verbatim unit, and of how many neighbouring ones one is taken.
RUN, SPREAD = 41, 10

_XOR = constants(BANDS * ROWS, 404)
_ODD = constants(BANDS * ROWS, 505) | np.uint64(1)
_BAND = constants(BANDS, 606)
_DIGEST = constants(2, 707) | np.uint64(1)

FEATURES = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("paragraph", T.IntegerType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("part", T.LongType())])
def bands(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band keys of sets of shingle hashes that stand one after another; ``first`` has where each begins."""
    key = np.repeat(_BAND[None, :], len(first), axis=0)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            low = np.minimum.reduceat((found ^ _XOR[k]) * _ODD[k], first)
            b = k // ROWS
            key[:, b] = mix(key[:, b] * np.uint64(0x9E3779B97F4A7C15) + low)
    return key


def digests(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """64 and 128 bits of each of the sets: sums of two scramblings of its members."""
    with np.errstate(over="ignore"):
        pair = [np.add.reduceat(mix(found * odd + odd), first) for odd in _DIGEST]
    flat = np.stack(pair, axis=1).astype("<u8").tobytes()
    return pair[0].view(np.int64), [flat[i : i + 16] for i in range(0, len(flat), 16)]


class _Lines:
    """The words of a block of texts, and the lines that they stand in."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        # texts cut at newlines: each line is a text of its own, and begins with its newline
        self.offs, self.ends = offs, np.flatnonzero(buf == 10)
        self.cuts = np.unique(np.concatenate([offs, self.ends]))
        self.words, self.at = words(buf, self.cuts)
        self.first = self.at[np.searchsorted(self.cuts, offs)]

    def place(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the line in it) of words of the block."""
        doc = np.searchsorted(self.first, word, "right") - 1
        cut = self.cuts[np.searchsorted(self.at, word, "right") - 1]
        return doc, np.searchsorted(self.ends, cut, "right") - np.searchsorted(self.ends, self.offs[doc])


class _Paragraphs:
    """The paragraphs of a block that are long enough: row, number of the line, first word, words, and sets.

    The set of paragraph ``k`` is ``found[first[k] : first[k + 1]]``, sorted.
    """

    def __init__(self, row: int, buf: np.ndarray, offs: np.ndarray):
        lines = _Lines(buf, offs)
        # short lines stay with short neighbours
        short = np.diff(lines.at) < MIN_WORDS
        own = np.isin(lines.cuts, offs)
        own[:-1] |= ~short
        own[1:] |= ~short
        at = lines.at[own]
        n = np.diff(at)
        long = np.flatnonzero(n >= MIN_WORDS)
        s, to = shingles(lines.words, at)
        owner = np.repeat(np.arange(len(n)), np.diff(to))
        inside = (n >= MIN_WORDS)[owner]
        s, owner = s[inside], owner[inside]
        for a, b in zip(*(np.searchsorted(owner, long, side) for side in ("left", "right")), strict=True):
            s[a:b].sort()
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        self.found, owner = s[new], owner[new]
        self.first = np.concatenate([np.searchsorted(owner, long), [len(owner)]])
        doc, self.number = lines.place(at[long])
        self.row, self.start, self.n = row + doc, at[long] - lines.first[doc], n[long]

    @staticmethod
    def of(column: pa.Array):
        for row, _, buf, offs in blocks(column):
            made = _Paragraphs(row, buf, offs)
            if len(made.row):
                yield made


def units(column: pa.Array):
    """(hashes of the units, rows, numbers of their first words, and of the lines these stand in) of blocks of texts."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for first, _, buf, offs in blocks(column):
        lines = _Lines(buf, offs)
        h, at = windows(lines.words, RUN), lines.first
        if not len(h):
            continue
        start = np.arange(len(h))
        doc = np.searchsorted(at, start, "right") - 1
        last = at[doc + 1] - RUN
        inside = start <= last
        h[~inside] = most
        padded = np.concatenate([h, np.full(SPREAD - 1, most)])
        chosen = start + np.lib.stride_tricks.sliding_window_view(padded, SPREAD).argmin(axis=1)
        # all of a text of fewer windows are one group
        chosen = np.unique(chosen[inside & ((start + SPREAD - 1 <= last) | (start == at[doc]))])
        doc, number = lines.place(chosen)
        yield h[chosen], first + doc, chosen - at[doc], number


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, paragraph, start_word, n_words, n, cls, part) of every long paragraph.

    ``cls`` is a digest of its shingle set, ``part`` half of it.
    """

    def run(batches):
        for batch in batches:
            for p in _Paragraphs.of(batch.column(2)):
                part, cls = digests(p.found, p.first[:-1])
                at = pa.array(p.row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(p.number, pa.int32()), pa.array(p.start, pa.int64()), pa.array(p.n, pa.int64()), pa.array(np.diff(p.first), pa.int64()), pa.array(cls, pa.binary()), pa.array(part)], names=[f.name for f in FEATURES])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text")), run, FEATURES)


def _tokens(batch: pa.RecordBatch):
    """Entries of the bands of a batch's paragraphs, with half of the digests of their sets."""
    for p in _Paragraphs.of(batch.column(0)):
        part, _ = digests(p.found, p.first[:-1])
        yield bands(p.found, p.first[:-1]).ravel(), np.repeat(part, BANDS).view(np.uint64), np.zeros(len(part) * BANDS, np.uint32)


def _sets(docs: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """(cls, shingles) of the paragraphs whose class is ``known``, by column ``part``, and of a few others."""
    wanted = wanted_bits(known, "part")

    def run(batches):
        for batch in batches:
            for p in _Paragraphs.of(batch.column(0)):
                part, cls = digests(p.found, p.first[:-1])
                # equal paragraphs of a block need one row
                some = np.intersect1d(np.flatnonzero(maybe(wanted.value, part)), np.unique(part, return_index=True)[1])
                raw = [p.found[p.first[k] : p.first[k + 1]].tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([cls[k] for k in some], pa.binary()), pa.array(raw, pa.binary())], names=["cls", "shingles"])

    return map_arrow(docs.select(F.col(text_col).cast("binary").alias("text")), run, "cls binary, shingles binary")


def _paragraph_repeats(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs that occur twice or more, as ``repeats`` has them."""
    feats = durable(features(docs, id_col, text_col), "paragraphs")
    classes = durable(feats.groupBy("cls").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.count("*").alias("copies")), "paragraph-classes")
    met = recurring(docs.select(F.col(text_col).cast("binary")), _tokens, size, once=True)
    posted = durable(met.select(F.col("key").alias("token"), F.col("a").alias("part")).join(classes, "part").select("token", "cls", "n", "part").distinct(), "bands")
    named = classes.select("cls", F.col("cls").alias("component"), "copies")
    if not posted.isEmpty():
        known = durable(posted.select("cls", "part").distinct(), "known")
        full = durable(_sets(docs, known, text_col).join(known.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "paragraph-sets")
        comp = components(connect(posted.drop("part"), full)).withColumnRenamed("component", "c")
        named = classes.join(comp.select(F.col("node").alias("cls"), "c"), "cls", "left").select("cls", F.coalesce("c", "cls").alias("component"), "copies")
    named = durable(named, "paragraph-components")
    often = named.groupBy("component").agg(F.sum("copies").alias("occurrences")).where("occurrences > 1")
    rows = durable(feats.drop("part").join(named.join(often, "component").select("cls", "component", "occurrences"), "cls"), "paragraph-repeats")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "paragraph")
    first = durable(rows.groupBy("component").agg(F.min(place).alias("first"), F.min("id").alias("cluster_id")), "firsts")
    made = rows.join(first, "component")
    return made.select("id", "text_key", "paragraph", "start_word", "n_words", F.col("n").alias("n_shingles"), "cluster_id", "occurrences", (place == F.col("first")).alias("kept"))


def _unit_entries(batch: pa.RecordBatch):
    keys = batch.column(0).to_numpy().view(np.uint64)
    for unit, row, start, line in units(batch.column(1)):
        yield unit, keys[row], ((start << 32) | line).astype(np.uint64)


def _run_repeats(docs: DataFrame, removed: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Runs that occur twice or more, as ``repeats`` has them, but for those in paragraphs that are ``removed``."""
    met = recurring(docs.select(F.xxhash64(text_col), F.col(text_col).cast("binary")), _unit_entries, size, once=False, width=8)
    met = durable(met.select(F.col("key").alias("unit"), F.col("a").alias("text_key"), F.shiftright("b", 32).alias("start"), F.col("b").bitwiseAND(0xFFFFFFFF).cast("int").alias("line")).distinct(), "units")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key")).groupBy("id", "text_key").agg(F.count("*").alias("copies"))
    spans = removed.groupBy("id", "text_key").agg(F.collect_set(F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("stop"))).alias("spans"))
    same = (F.col("r.text_key") == F.col("s.text_key")) & F.col("r.id").eqNullSafe(F.col("s.id"))
    rows = durable(rows.alias("r").join(spans.alias("s"), same, "left").select("r.*", "s.spans"), "unit-rows")
    gone = F.coalesce(F.exists("spans", lambda s: (s["start_word"] <= F.col("start")) & (F.col("start") + RUN <= s["stop"])), F.lit(False))
    seen = durable(met.join(rows, "text_key").select("id", "text_key", "start", "line", "unit", "copies", gone.alias("gone")), "unit-places")
    place = F.struct("gone", F.col("id").isNull().alias("none"), "id", "text_key", "start")
    first = durable(seen.groupBy("unit").agg(F.min(place).alias("first"), F.min("id").alias("cluster_id"), F.sum("copies").alias("occurrences")), "first-places")
    rows = seen.join(first, "unit").select("id", "text_key", "start", "line", "copies", "gone", "cluster_id", "occurrences", (place == F.col("first")).alias("kept"))
    w = Window.partitionBy("id", "text_key").orderBy("start")
    apart = F.coalesce((F.lag("kept").over(w) != F.col("kept")) | (F.col("start") > F.lag("start").over(w) + RUN), F.lit(True))
    spans = rows.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(w))
    spans = spans.groupBy("id", "text_key", "span").agg(F.min("start").alias("start_word"), F.min("line").alias("paragraph"), F.max("start").alias("stop"), F.min("cluster_id").alias("cluster_id"), F.max("occurrences").alias("occurrences"), F.first("kept").alias("kept"), F.max("copies").alias("copies"), F.min("gone").alias("gone"))
    n = F.col("stop") + RUN - F.col("start_word")
    made = spans.where("kept or not gone").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return made.select("id", "text_key", "paragraph", "start_word", n.alias("n_words"), (n - (WIDTH - 1)).alias("n_shingles"), "cluster_id", "occurrences", "kept")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key, paragraph, start_word, n_words, n_shingles, cluster_id, occurrences, kept): repeated passages.

    A passage is a paragraph or a run of neighbouring units.  ``paragraph`` is the number of the line that it begins
    in, from 0, ``start_word`` that of its first word in the text; ``cluster_id`` the smallest document id in the
    cluster, or where a unit of the run occurs; ``occurrences`` those of the cluster, or of the run's commonest
    unit.  ``kept`` marks the first of each, by id (nulls last), text and place.  A run is given by its units, so
    of the words shared up to ``SPREAD - 1`` at either end may be left out.  Null and empty texts have no passages.
    Rows with the same id and text count as occurrences each, but share their fate.  Other columns are ignored.
    """
    size = docs.agg(F.coalesce(F.sum(F.length(F.col(text_col).cast("binary"))), F.lit(0))).first()[0]
    paragraphs = durable(_paragraph_repeats(docs, size, id_col, text_col), "paragraph-rows")
    runs = _run_repeats(docs, paragraphs.where("not kept"), size, id_col, text_col)
    return paragraphs.unionByName(runs).withColumnRenamed("id", id_col)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _without(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of ``spans`` (first, number), and without lines of which no word is left."""
    if text is None or not spans:
        return text
    gone: set[int] = set()
    for first, n in spans:
        gone.update(range(first, first + n))
    out, k = [], 0
    for line in text.split("\n"):
        found = list(_WORD.finditer(line))
        drop = [k + i in gone for i in range(len(found))]
        k += len(found)
        if not any(drop):
            out.append(line)
        elif not all(drop):
            # a word goes with the white space before it, the first of a line with that after it
            edges = [0, *(m.end() for m in found)]
            left = "".join(line[edges[i] : m.end()] for i, m in enumerate(found) if not drop[i]) + line[edges[-1] :]
            out.append(left.lstrip(" \t\v\f\r") if drop[0] else left)
    return "\n".join(out)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage taken out of its text, but for the first of each.

    All rows stay, with their other columns, whatever those are called.  Null texts stay null; an empty table stays
    empty; rows with the same id and text lose the same passages.
    """
    key, gone = free("text_key", docs.columns), free("gone", docs.columns)
    found = repeats(docs, id_col, text_col).where("not kept").groupBy(F.col(id_col).alias("id"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    named = docs.withColumn(key, F.xxhash64(text_col))
    same = (F.col(f"d.`{key}`") == F.col("g.k")) & F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("g.id"))
    both = named.alias("d").join(found.alias("g"), same, "left").select("d.*", F.col("g.spans").alias(gone))
    return both.withColumn(text_col, F.udf(_without, "string")(text_col, gone)).drop(key, gone)
