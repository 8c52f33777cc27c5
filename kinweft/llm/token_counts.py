"""Token counts without ids: pieces once for each distinct pre-token, joined to frequencies.

Pre-tokens are the white-space-delimited units of the texts.  One pass counts how often each occurs in
the corpus; every distinct one is then encoded once.  The commonest, a fixed number of them, are sent to
the workers, where they cover all but a few percent of a text; the rest of each document's pre-token
frequencies are joined to the piece counts by a shuffle, and summed for each document.
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import durable, map_arrow
from kinweft.llm.tokenization import UnitCounts

#: Pre-tokens sent to every worker, at most: about 10 MB, whatever the corpus.
COMMON = 400_000
_FLUSH = 400_000


def _key(unit: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(unit) - (1 << 63)


def pieces(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(key, unit, freq, pieces): every distinct pre-token of ``docs``, how often it occurs, its number of ids."""

    def count(batches):
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "freq"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(UnitCounts.units(text or "") or ())
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = UnitCounts(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                units = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([_key(u) for u in units], pa.int64()), part.column(0), part.column(1), pa.array(counts.counts(units), pa.int32())], names=["key", "unit", "freq", "pieces"])

    total = map_arrow(docs.select(F.col(text_col).cast("string")), count, "unit string, freq long").groupBy("unit").agg(F.sum("freq").alias("freq"))
    return map_arrow(total, encode, "key long, unit string, freq long, pieces int")


def _least_common(table: DataFrame) -> int:
    """The least frequency that at most ``COMMON`` pre-tokens reach, from a histogram of frequencies."""
    # above a few thousand, frequencies count by powers of two, so the histogram is small whatever the corpus
    level = F.when(F.col("freq") < 4096, F.col("freq")).otherwise(F.expr("shiftleft(1L, cast(floor(log2(freq)) as int))"))
    seen, least = 0, 1 << 62
    for at, n in sorted(((r[0], r[1]) for r in table.groupBy(level.alias("level")).agg(F.count("*")).collect()), reverse=True):
        seen += n
        if seen > COMMON:
            break
        least = at
    return least


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Counts are those of the library for the whole text without added special tokens; special strings in a
    text count as the library takes them by default.  A null text is an empty one: no bytes, no tokens.
    Repeated rows give repeated rows; other columns are ignored.
    """
    table = durable(pieces(docs, tokenizer, text_col), "pieces")
    top = table.where(F.col("freq") >= _least_common(table)).select("unit", "pieces").toArrow()
    common = docs.sparkSession.sparkContext.broadcast((top.column("unit").to_pylist(), top.column("pieces").to_pylist()))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = dict(zip(*common.value, strict=True))
        counts = None
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, keys, freqs, ids, sizes = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    units = UnitCounts.units(text)
                    n = 0
                    if units is None:
                        counts = counts or UnitCounts(tokenizer)
                        n = counts.whole(text)
                    else:
                        got = list(map(known.get, units))
                        if None in got:
                            rare = Counter(u for u, g in zip(units, got, strict=True) if g is None)
                            n = sum(filter(None, got))
                            rows += [row] * len(rare)
                            keys += map(_key, rare)
                            freqs += rare.values()
                            ids += [None] * len(rare)
                            sizes += [None] * len(rare)
                        else:
                            n = sum(got)
                    rows.append(row)
                    keys.append(row)
                    freqs.append(n)
                    ids.append(doc)
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, keys, freqs, ids, sizes)], names=["row", "key", "freq", "id", "n_bytes"])

    found = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "row long, key long, freq long, id long, n_bytes long")
    joined = found.join(table.select("key", "pieces"), "key", "left")
    ids = F.when(F.col("n_bytes").isNotNull(), F.col("freq")).otherwise(F.col("freq") * F.col("pieces"))
    made = joined.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(ids).alias("n_tokens"))
    return made.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
