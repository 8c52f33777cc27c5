"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import durable


#: Tasks of a stage, at least, and links for each task beyond.
TASKS, LINKS_PER_TASK = 6, 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns ``a`` and ``b`` of one orderable type).

    ``component`` is the smallest node reachable.  Each round, every node first hangs its larger
    neighbours on its smallest neighbour, then its smaller ones; both are aggregations and joins on
    nodes, so no component is ever gathered in one place.  Every round is written to the shared
    folder.  It ends when a round changes nothing, after about the logarithm of the longest path.
    Self links and repeated links are fine; without links the result is empty.
    """
    edges = durable(links.select("a", "b").where("a <> b").distinct(), "edges")
    # stages of few links need few tasks: the number follows the links, which only become fewer
    tasks = TASKS + edges.count() // LINKS_PER_TASK
    seen = None
    while True:
        # large star: links both ways; hang larger neighbours on the smallest node around
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.coalesce(tasks).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct()
        # small star: each node hangs its smaller neighbours, and itself, on the smallest of them
        large = large.coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = durable(small.select("e.a", "e.b").where("a <> b").coalesce(tasks).distinct().coalesce(tasks), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
