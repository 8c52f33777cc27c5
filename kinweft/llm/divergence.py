"""How the sources of a language differ in their words: an audit by sorted runs.

Documents are folded into blocks on the map side: for each language, source and term a block holds the number of its
documents that have the term and of the term's occurrences.  These rows are dealt out by (lang, term) and sorted by
(lang, term, source, block of documents) within each task, so one pass over the runs gives a term's document frequency
and its counts by source with the memory of one run; a term that every document has is as many rows as there are
blocks and sources.  The terms that are kept are written.  A second pass over runs, now with the probabilities,
emits partial sums for pairs of sources.

For sources s and o the sum of f over all kept terms is split so that only what occurs is visited: with p0 as the
probability at count zero, it is V * f(p0s, p0o), plus f(ps, p0o) - f(p0s, p0o) for every term of s (gathered by
distinct ps), the same for o, plus a correction for the terms that both have.  The sums are integers and exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweft.llm.shared import durable, map_arrow, small_join

LEAST_DOCS = 10
TOP = 10
#: Counts that a task holds before it passes them on, bytes of a text looked at together, entries of a run's chunk.
HELD, SLICE, CHUNK = 100_000, 1 << 20, 50_000
#: Bytes to term bytes, A-Z lower-cased, and everything that stands in no term to a space.  All bytes of characters
#: from U+0080 on are 0x80 or more.
_TERM = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PARTIAL = "lang string, term string, source string, block long, n_docs long, n long"
_KEPT = "lang string, term string, source string, n long, lang_n long, first boolean"


def terms(text: bytes):
    """Lists of the terms of a text in UTF-8, slice by slice."""
    low, at = text.translate(_TERM), 0
    while at < len(low):
        end = low.find(b" ", at + SLICE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def _fold(batches):
    """Documents to partial rows of blocks of documents."""
    block = TaskContext.get().partitionId() << 32
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (counts, docs) in held.items():
            of = list(counts)
            n = len(of)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(of, pa.binary()).cast(pa.string()), pa.array([source] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([docs[t] for t in of], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "source", "block", "n_docs", "n"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            counts, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for some in terms(text.as_py()):
                counts.update(some)
                seen.update(some)
            docs.update(seen)
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield from out()
            held.clear()
            block += 1
    yield from out()


def _scan(least: int):
    """Sorted partial rows to one row for each source of every term that ``least`` documents have."""

    def run(batches):
        made: list[tuple] = []
        key, in_docs, sources, counts = None, 0, [], []

        def close():
            if in_docs >= least:
                total = sum(counts)
                made.extend((*key, s, c, total, i == 0) for i, (s, c) in enumerate(zip(sources, counts, strict=True)))

        def out():
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            cols = list(zip(*made, strict=True)) or [[]] * 6
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["lang", "term", "source", "n", "lang_n", "first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, source = (batch.column(c) for c in ("lang", "term", "source"))
            changes = lambda c: pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            other_term = np.r_[True, changes(lang) | changes(term)]
            runs, parts = np.flatnonzero(other_term), np.flatnonzero(other_term | np.r_[True, changes(source)])
            docs = np.add.reduceat(batch.column("n_docs").to_numpy(), runs)
            sums = np.add.reduceat(batch.column("n").to_numpy(), parts)
            bounds = np.r_[np.searchsorted(parts, runs), len(parts)]
            # a run that is whole in the batch and too rare needs no look; the first and the last may go on elsewhere
            seen = docs >= least
            seen[0] = seen[-1] = True
            for r in np.flatnonzero(seen).tolist():
                of = (lang[runs[r]].as_py(), term[runs[r]].as_py())
                if of != key:
                    close()
                    key, in_docs, sources, counts = of, 0, [], []
                in_docs += int(docs[r])
                here = slice(bounds[r], bounds[r + 1])
                for s, n in zip(source.take(parts[here]).to_pylist(), sums[here].tolist(), strict=True):
                    if sources and sources[-1] == s:
                        counts[-1] += n
                    else:
                        sources.append(s)
                        counts.append(n)
            if len(made) > 50_000:
                yield out()
        close()
        yield out()

    return run


def divergence(p: Column, q: Column) -> Column:
    """floor((p-q)^2 / (p+q)) of long columns."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _both(batches):
    """Sorted runs to partial corrections of the pairs of sources that have a term in common."""
    sums: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    names: list[str] = []
    number: dict[str, int] = {}
    kept: list[tuple] = []  # the open run, and closed ones that wait for the chunk to fill

    def work(rows):
        if not rows:
            return
        langs = [r[0] for r in rows]
        run = np.empty(len(rows), np.int64)
        n = -1
        last = None
        for i, r in enumerate(rows):
            if (r[0], r[1]) != last:
                last, n = (r[0], r[1]), n + 1
            run[i] = n
        for r in rows:
            if r[2] not in number:
                number[r[2]] = len(names)
                names.append(r[2])
        src = np.array([number[r[2]] for r in rows], np.int64)
        p, p0 = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[starts[1:], len(rows)][run]
        which = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        lang_of, by = np.array([which[x] for x in langs], np.int64), list(which)
        at, lag = np.arange(len(rows)), 0
        while True:
            lag += 1
            at = at[at + lag < ends[at]]
            if not len(at):
                break
            to = at + lag
            value = _f(p[at], p[to]) - _f(p[at], p0[to]) - _f(p0[at], p[to]) + _f(p0[at], p0[to])
            order = np.lexsort((src[to], src[at], lang_of[at]))
            a, b, c = src[at][order], src[to][order], lang_of[at][order]
            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            for x, y, z, v in zip(a[cut].tolist(), b[cut].tolist(), c[cut].tolist(), np.add.reduceat(value[order], cut).tolist(), strict=True):
                sums[by[z]][x << 32 | y] += v

    def out():
        for lang, of in sums.items():
            keys = list(of)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([names[k >> 32] for k in keys], pa.string()), pa.array([names[k & 0xFFFFFFFF] for k in keys], pa.string()), pa.array(list(of.values()), pa.int64())], names=["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        kept += zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "p", "p0")), strict=True)
        if len(kept) > CHUNK:
            cut = len(kept)
            while cut and kept[cut - 1][:2] == kept[-1][:2]:
                cut -= 1
            work(kept[:cut])
            del kept[:cut]
            if sum(map(len, sums.values())) > HELD:
                yield from out()
    work(kept)
    yield from out()


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (n + 2) / (total + 2 * kept)), in decimals, so counts of any size are exact."""
    n, total, kept = (c.cast("decimal(20,0)") for c in (n, total, kept))
    return F.lit(1) + F.call_function("div", (n + F.lit(2)) * F.lit(1_000_000_000), total + F.lit(2) * kept)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and in which terms.

    Part ``pair`` has a row for every other source of the language with the summed divergence, part ``term`` the
    ``top`` terms that the source has more often than the language as a whole.  Null languages, sources and texts are
    empty; every source that occurs has its rows, with value 0 if its language keeps no term.  Rows are documents:
    repeated rows count each.  Equal values rank by the item's bytes.  A source alone in its language has no pairs; an
    empty table gives an empty result; other columns are ignored, whatever they are called.  Texts may have any length.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    partial = map_arrow(rows, _fold, _PARTIAL)
    runs = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    kept = durable(map_arrow(runs.drop("block"), _scan(least_docs), _KEPT), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    zero = F.when(F.col("v") > 0, probability(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(1)
    groups = durable(groups.withColumn("p0", zero), "groups")

    entries = small_join(kept, groups, ["lang", "source"]).select("lang", "term", "source", probability(F.col("n"), F.col("total"), F.col("v")).alias("p"), probability(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "p0")
    entries = durable(entries, "probabilities")
    above = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sorted_runs = entries.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = map_arrow(sorted_runs, _both, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), "v")
    apart = F.col("source") != F.col("other")
    base = small_join(groups.drop("v"), others, ["lang"]).where(apart).select("lang", "source", "other", F.when(F.col("v") > 0, F.col("v") * divergence(F.col("p0"), F.col("other_p0"))).otherwise(0).alias("value"))
    met = entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    single = small_join(met, others, ["lang"]).where(apart).groupBy("lang", "source", "other").agg(F.sum(F.col("n") * (divergence(F.col("p"), F.col("other_p0")) - divergence(F.col("p0"), F.col("other_p0")))).alias("value"))
    ways = lambda df, a, b: df.select("lang", F.col(a).alias("source"), F.col(b).alias("other"), "value").unionByName(df.select("lang", F.col(b).alias("source"), F.col(a).alias("other"), "value"))
    summed = base.unionByName(ways(single, "source", "other")).unionByName(ways(both, "a", "b")).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL that evaluates every term for every source and pair."""
    f = "(({0}) - ({1})) * (({0}) - ({1})) // (({0}) + ({1}))".format
    p = "(1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v))::BIGINT".format
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {least_docs}),
l AS (SELECT lang, sum(n)::BIGINT AS n, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(t.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c.n)::BIGINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL) t USING (lang, source) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.n")} AS p, {p("k.n", "l.n")} AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(any_value(s.value), 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, sum({f("a.p", "b.p")})::BIGINT AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = x.lang AND s.s = x.source AND s.o = y.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, ({f("p", "q")})::BIGINT FROM e WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found QUALIFY part = 'pair' OR rank <= {top}
"""
