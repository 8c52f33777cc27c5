"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of five-word shingles and a signature of ``COORDINATES`` minima.  Texts
   with equal sets are one class from here on, whatever the number of copies.
2. A signature is a set of (coordinate, value) tokens.  A pair at the similarity sought agrees in at
   least ``MATCHES`` of them (for a true pair of similarity 0.75 the chance of fewer is below 1e-5).
   Tokens are ordered from rare to common; two sets that share ``MATCHES`` tokens must share one
   among the rarest ``COORDINATES - MATCHES + 1`` of each, so only these prefixes are posted, and the
   long posting lists of passages that many texts share are skipped.
3. Posting lists are merged against centres rather than as all pairs (see :mod:`kinweft.llm.linking`): signature
   collisions of these pairs are counted, pairs under the threshold dropped, the rest verified on full sets, and
   what lists still hold in different components is met exactly, so no link is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweft.llm.components import components
from kinweft.llm.linking import connect
from kinweft.llm.shared import durable, free, map_arrow
from kinweft.llm.textpack import constants, mix, sets

COORDINATES = 32
MATCHES = 12

_XOR = constants(COORDINATES, 101)
_ODD = constants(COORDINATES, 202) | np.uint64(1)
_SLOT = constants(COORDINATES, 303)

FEATURES = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType(), False))])


def signature(found: np.ndarray) -> np.ndarray:
    """The (coordinate, value) tokens of a non-empty set of shingle hashes."""
    low = np.empty(COORDINATES, np.uint64)
    with np.errstate(over="ignore"):
        step = max(1, (1 << 18) // COORDINATES)
        parts = [((found[None, i : i + step] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1) for i in range(0, len(found), step)]
        low = reduce(np.minimum, parts)
        return mix(low ^ _SLOT)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, cls, tokens) of every row; ``cls`` is a 128-bit digest of the shingle set."""

    def run(batches):
        import xxhash

        for batch in batches:
            n, cls, off, flat = [], [], [0], []
            for s in sets(batch.column(2)):
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    flat.append(signature(s).view(np.int64))
                off.append(off[-1] + (COORDINATES if len(s) else 0))
            tokens = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), tokens], names=[f.name for f in FEATURES])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text")), run, FEATURES)


def shingle_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cls, shingles): the full set of every row as a sorted array of 64-bit hashes, as bytes."""

    def run(batches):
        import xxhash

        for batch in batches:
            raw = [s.tobytes() for s in sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["cls", "shingles"])

    return map_arrow(docs.select(F.col(text_col).cast("binary").alias("text")), run, "cls binary, shingles binary")


def links(docs: DataFrame, feats: DataFrame, text_col: str = "text") -> DataFrame | None:
    """Verified links between classes that connect everything a complete list of links would.

    ``feats`` must be a table that can be read again (see :func:`durable`).  None if nothing collides.
    """
    classes = feats.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    tokens = classes.select("cls", "n", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(df, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    posted = ranked.where(F.size("t") >= MATCHES).select("cls", "n", F.explode(F.slice("t", 1, F.size("t") - (MATCHES - 1))).alias("t")).select("cls", "n", F.col("t.token").alias("token"))
    posted = durable(posted, "postings")
    if posted.isEmpty():
        return None
    known = posted.select("cls").distinct()
    texts = docs.select(F.col(text_col), F.xxhash64(text_col).alias("text_key"))
    one_text = feats.join(known, "cls", "left_semi").groupBy("cls").agg(F.min("text_key").alias("text_key")).select("text_key")
    full = durable(shingle_sets(texts.join(one_text, "text_key", "left_semi").dropDuplicates(["text_key"])).dropDuplicates(["cls"]), "sets")
    sig = durable(classes.join(known, "cls", "left_semi").select("cls", "tokens"), "signatures")

    def collide(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(sig.select(F.col("cls").alias("a"), F.col("tokens").alias("s")), "a").join(sig.select(F.col("cls").alias("b"), F.col("tokens").alias("t")), "b")
        return sides.where(F.size(F.array_intersect("s", "t")) >= MATCHES).select("a", "b")

    return connect(posted, full, collide)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id of the row's group of near-duplicates; ``kept`` says that the
    row's id is that one.  Texts that are null, empty or without words have no shingles and are
    linked with nothing, not even with one another.  Null ids count as no id: a group of only null
    ids has a null ``component_id`` and is kept.  Rows with the same id and text share their fate;
    rows with the same id and other texts are judged by their texts.  Other columns are ignored.
    """
    feats = durable(features(docs, id_col, text_col), "features")
    found = links(docs, feats, text_col)
    lowest = feats.where("n > 0").groupBy("cls").agg(F.min("id").alias("low"))
    if found is not None:
        comp = components(found)
        lowest = durable(lowest.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "classes")
        group = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
        lowest = lowest.join(group, "component").select("cls", F.col("component_id").alias("low"))
    rows = feats.join(lowest, "cls", "left")
    ids = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), ids.alias("component_id"), F.col("id").eqNullSafe(ids).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns as they were.

    The row with the group's smallest id stays (of several such rows, one).  Rows without words all stay.  Other
    columns may have any names; an empty table stays empty.
    """
    judged = durable(near_duplicates(docs, id_col, text_col).where("kept"), "kept")
    text_key = free("text_key", docs.columns)
    named = docs.withColumn(text_key, F.xxhash64(text_col))
    key = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.id")) & (F.col(f"d.`{text_key}`") == F.col("k.text_key"))
    worded = judged.where("n_shingles > 0").groupBy("component_id").agg(F.min("text_key").alias("text_key"), F.count("*").alias("m")).select(F.col("component_id").alias("id"), "text_key", "m")
    plain = judged.where("n_shingles = 0").select(F.col(id_col).alias("id"), "text_key").distinct()
    once = worded.where("m = 1").select("id", "text_key").unionByName(plain)
    kept = named.alias("d").join(once.alias("k"), key, "left_semi")
    again = worded.where("m > 1").select("id", "text_key")
    if not again.isEmpty():
        kept = kept.unionByName(named.alias("d").join(again.alias("k"), key, "left_semi").dropDuplicates([id_col, text_key]))
    return kept.drop(text_key)
