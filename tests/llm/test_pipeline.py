"""The pipeline's stages against brute force on a small table."""

from collections import Counter

import corpus_pipeline
from kinweft.llm import tokenization


def test_stages_take_effect_in_order(spark, tmp_path):
    def prose(k, n=8):
        return "\n".join(" ".join(f"{c}{k}x{i}" for c in "abcdefghij") + "." for i in range(n))

    shared = "This very line stands in every single document of the corpus."
    item = " ".join(f"bench{i}" for i in range(20)) + "."
    rows = [(i, prose(i) + "\n" + shared, "en", "s", 0) for i in range(12)]
    rows += [(20, prose(3) + "\n" + shared, "en", "s", 0), (21, prose(21) + "\n" + item, "en", "s", 0), (22, "too short", "en", "s", 0), (23, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = tokenization.load("byte_bpe_50k.json")
    want = Counter((i, len(whole.encode(prose(i), add_special_tokens=False).ids) + 1) for i in range(12))
    assert Counter((r.doc_id, r.length) for r in got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "benchmark decontamination", "packing"]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
