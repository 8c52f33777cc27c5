"""Links between shingle sets from posting lists, enough for components, without all pairs of a list.

A posting list holds sets that may be similar.  Its members are first compared with a few members that all of
them choose alike; what is verified is joined to components, and lists within one component are done.  The sets
of the other lists are posted again, under the rarest of their own shingles: two similar sets share one of these,
while passages that many texts have in common are skipped.  The new lists are asked in rounds, a few members of
each against the rest, until each lies within one component or all its members were asked.  The links found
connect everything that all links would connect.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweft.llm.components import components
from kinweft.llm.shared import durable, map_arrow

#: The similarity of a link: intersection over union, in hundredths.
NUMERATOR, DENOMINATOR = 75, 100
#: Members of a list that are asked in the first round, and how many times more in each further one.
ASKED, MORE = 8, 8


def connect(posted: DataFrame, full: DataFrame, collide: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """Verified links (a, b) that connect what all links between sets with a common token connect.

    ``posted`` has (token, cls, n: the size of the set), ``full`` (cls, shingles: sorted 64-bit hashes as bytes);
    both must be tables that can be read again.  ``collide`` drops pairs that cannot be links.
    """
    pairs = _around(posted, [F.col("cls"), F.xxhash64("cls")])
    found = durable(_verify(collide(pairs), full), "links")
    known = components(found).select(F.col("node").alias("cls"), "component")
    named = posted.join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    members = durable(_mixed(named, "token").select("cls", "n", "component").distinct(), "members")
    if members.isEmpty():
        return found
    lists = durable(_rarest(members, full), "lists")
    asked = ASKED
    while True:
        lists = durable(_mixed(lists, "token"), "lists")
        if lists.isEmpty():
            return found
        size = durable(lists.groupBy("token").agg(F.count("*").alias("size")), "sizes")
        # the members asked in this round: all of a short list, a few of a long one, chosen by hash
        chance = F.pmod(F.xxhash64("token", "cls"), F.lit(1 << 20)) * F.col("size") < F.lit(asked << 20)
        lists = durable(lists.join(size, "token").select("token", "cls", "n", "at", "component", chance.alias("asked")), "lists")
        links = durable(_verify(_ask(lists), full), "links")
        found = found.unionByName(links)
        lists = lists.where("not asked").drop("asked")
        joined = links.join(members.select(F.col("cls").alias("a"), F.col("component").alias("x")), "a").join(members.select(F.col("cls").alias("b"), F.col("component").alias("y")), "b")
        moved = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
        members, lists = (df.join(moved, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to") for df in (members, lists))
        members = durable(members, "members")
        asked *= MORE


def _near_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _around(lists: DataFrame, orders: list[Column]) -> DataFrame:
    """Pairs (a, b) of each member of a list with the list's smallest member in each order."""
    # written, so that the rows of a hot token can be dealt to several tasks of the join
    centres = durable(lists.groupBy("token").agg(*[F.min(F.struct(o.alias("o"), "cls", "n")).alias(f"c{i}") for i, o in enumerate(orders)]), "centres")
    chosen = F.array_distinct(F.array(*[F.struct(F.col(f"c{i}.cls").alias("cls"), F.col(f"c{i}.n").alias("n")) for i in range(len(orders))]))
    near = lists.join(centres, "token").select("cls", "n", F.explode(chosen).alias("c"))
    near = near.where((F.col("c.cls") != F.col("cls")) & _near_in_size(F.col("n"), F.col("c.n")))
    return near.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()


def _verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, counted exactly."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(full.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return map_arrow(sides.select("a", "b", "x", "y"), run, "a binary, b binary")


def _mixed(named: DataFrame, key: str) -> DataFrame:
    """The rows of the lists that hold several components."""
    several = durable(named.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(key), "mixed")
    return named.join(several, key, "left_semi")


def _rarest(members: DataFrame, full: DataFrame) -> DataFrame:
    """(token, cls, n, at, component): each set under its rarest shingles that another of ``members`` has too.

    ``at`` is the shingle's place in the set, in the order from rare to common.  Of two sets that are similar
    enough each has at most a share ``1 - NUMERATOR / DENOMINATOR`` of shingles that the other lacks, so they share
    one of that many and one more; and a set with more shingles of its own alone is similar to no other.
    """

    def explode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                name = pa.DictionaryArray.from_arrays(np.zeros(len(found), np.int32), batch.column(0).slice(i, 1))
                yield pa.RecordBatch.from_arrays([name.cast(pa.binary()), pa.array(found)], names=["cls", "shingle"])

    sets = full.select("cls", "shingles").join(members.select("cls"), "cls", "left_semi")
    rows = durable(map_arrow(sets, explode, "cls binary, shingle long"), "shingles")
    often = durable(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = rows.join(often, "shingle").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("t"))
    dealt = ranked.join(members, "cls")
    alone = F.col("n") - F.size("t")
    spare = F.floor(F.col("n") * (DENOMINATOR - NUMERATOR) / DENOMINATOR)
    post = dealt.where(alone <= spare).select("cls", "n", "component", alone.alias("alone"), F.posexplode(F.slice("t", 1, (spare - alone + 1).cast("int"))).alias("k", "x"))
    return post.select(F.col("x.shingle").alias("token"), "cls", "n", (F.col("k") + F.col("alone")).alias("at"), "component")


def _ask(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of a list that are asked with those in other components that may be similar."""
    one = lists.where("asked").select("token", *[F.col(c).alias(f"q_{c}") for c in ("cls", "n", "at", "component")])
    # if this token is the first that both share, the rest of either set bounds what they can share at all
    most = F.least(F.col("n") - F.col("at"), F.col("q_n") - F.col("q_at"))
    able = most * (NUMERATOR + DENOMINATOR) >= (F.col("n") + F.col("q_n")) * NUMERATOR
    near = lists.join(one, "token").where((F.col("component") != F.col("q_component")) & _near_in_size(F.col("n"), F.col("q_n")) & able)
    return near.select(F.least("cls", "q_cls").alias("a"), F.greatest("cls", "q_cls").alias("b")).distinct()
