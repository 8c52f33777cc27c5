"""Each operator against brute force on awkward small tables."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinweft.llm import decontaminate, html_wrapper, kneser_ney, line_dedup, minhash_dedup, packing, paragraph_dedup, quality, secret_scan, textpack, token_counts, tokenization

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(3000))
BASE = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, BASE), (2, BASE.upper()), (3, BASE.replace("word5 ", "other ")), (4, None), (5, ""), (6, " \n\t"), (7, "short text"), (8, "Short  TEXT"), (9, LONG), (10, LONG + " tail"), (11, BASE + "\n" + BASE), (12, "éàü ß " * 20), (13, "a b c d e"), (14, "f g h i j k"), (None, BASE), (7, "short text"),
]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 3, False) for i, t in DOCS], "doc_id long, text string, cls string, n_lines long, kept boolean")


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_shingle_counts_equal_a_plain_count():
    texts = [t for _, t in DOCS]
    assert [len(s) for s in textpack.sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]
    assert [len(s) for s in textpack.sets(pa.array(texts * 3, pa.string()).slice(5))] == [len(shingles(t)) for t in texts * 3][5:]


def test_near_duplicates_equal_brute_force(docs):
    sets = [shingles(t) for _, t in DOCS]
    pairs = [(i, j) for i in range(len(DOCS)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    comp = components(pairs, range(len(DOCS)))
    low_id = {c: min((DOCS[i][0] for i in comp if comp[i] == c and DOCS[i][0] is not None), default=None) for c in set(comp.values())}
    want = Counter((DOCS[i][0], len(sets[i]), low_id[comp[i]] if sets[i] else DOCS[i][0]) for i in comp)
    rows = minhash_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_keep_first_keeps_one_of_each_group(docs):
    kept = minhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 9, 12, 13, 14]


def test_large_group_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(80):
        own = list(words)
        for j in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            own[j] = f"edit{i}_{j}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(pairs, sets)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for made in (minhash_dedup.near_duplicates(none), paragraph_dedup.repeats(none), line_dedup.drop_common_lines(none), quality.verdicts(none), secret_scan.scan_versions(none), token_counts.token_counts(none, "word_bpe_49k.json", 5), packing.packed_documents(none, "byte_bpe_50k.json")):
        assert made.count() == 0
    assert kneser_ney.scores(none, kneser_ney.train(none, ~kneser_ney.held_out())).count() == 0


def test_secrets_and_the_ledger(spark, tmp_path):
    text = 'é token = "abcdef" password: abc AKIA' + "Q" * 16 + " AKIAx " + "0a" * 12 + " " + "0a" * 11 + " token=token\" = abcdefgh"
    rows = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "clean")], "doc_id long, text string")
    want = sorted((m.start(), o, k, m.end()) for o, (k, p, g, n) in enumerate([("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]) for m in re.finditer(p, text) if len(m[g]) >= n)
    ledger = str(tmp_path / "ledger")
    first = {r.doc_id: r.spans for r in secret_scan.scan_versions(rows, ledger).collect()}
    assert [(s.start, s.kind_order, s.kind, s.stop) for s in first[1]] == want and first[2] == first[1]
    assert first[3] == [] and first[4] == []
    assert spark.read.parquet(ledger).count() == 3
    more = rows.unionByName(spark.createDataFrame([(5, "passwd=hunter22")], "doc_id long, text string"))
    assert len(secret_scan.scan_versions(more, ledger).where("doc_id = 5").first().spans) == 1
    assert spark.read.parquet(ledger).count() == 4
    secret_scan.scan_versions(more, ledger, rule_version="2").count()
    assert spark.read.parquet(ledger).count() == 8


def test_repeated_passages(docs):
    got = {(r.doc_id, r.paragraph, r.kept) for r in paragraph_dedup.repeats(docs).collect()}
    assert {(d, p) for d, p, _ in got} == {(1, 0), (2, 0), (3, 0), (None, 0), (11, 0), (11, 1), (9, 0), (10, 0)}
    assert {(d, p) for d, p, k in got if k} == {(1, 0), (9, 0)}
    left = {r.doc_id: r.text for r in paragraph_dedup.drop_repeats(docs.where("doc_id is not null")).collect()}
    assert left[1] == BASE and left[11] == "" and left[4] is None


def test_repeated_passages_anywhere_in_a_text(spark):
    def own(name, n):
        return [f"{name}{i}" for i in range(n)]

    shared, split, short = own("s", 50), own("t", 160), own("u", 40)
    broken = [split[i:j] for i, j in ((0, 17), (17, 48), (48, 79), (79, 110), (110, 141), (141, 155), (155, 160))]
    rows = [
        (1, " ".join(own("a", 58) + shared + own("b", 27))), (2, " ".join(own("c", 7)) + "\n" + " ".join(own("d", 31) + [x.upper() for x in shared] + own("e", 90))),
        (3, "\n".join(map(" ".join, broken))), (4, " ".join(own("f", 30) + split + own("g", 300))), (5, " ".join(own("h", 90) + short)), (6, " ".join(short + own("i", 90))),
        (7, "\n".join(" ".join(own(f"j{k}_", 20)) for k in range(9))), (8, "\n".join(" ".join(own(f"j{k}_", 20)) for k in range(1, 9)) + "\nother words"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraph_dedup.repeats(docs).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(1, True), (2, False), (3, True), (4, False), (7, True), (8, False)}
    assert {r.doc_id: r.paragraph for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 1} and all(r.occurrences == 2 for r in got)
    for r in got:
        inside = WORD.findall(low(rows[r.doc_id - 1][1]))[r.start_word : r.start_word + r.n_words]
        assert r.n_words >= paragraph_dedup.RUN and (r.doc_id > 4 or set(inside) <= set(shared + split))
    left = {r.doc_id: r.text for r in paragraph_dedup.drop_repeats(docs).collect()}
    assert all(left[i] == rows[i - 1][1] for i in (1, 3, 5, 6, 7))
    assert len(set(WORD.findall(low(left[2]))) & set(shared)) <= 9 and set(own("c", 7) + own("d", 31) + own("e", 90)) <= set(WORD.findall(left[2]))
    assert len(set(WORD.findall(left[4])) & set(split)) <= 18 and set(own("f", 30) + own("g", 300)) <= set(WORD.findall(left[4]))


def test_two_texts_that_share_fifty_words_share_a_unit():
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in range(50)]
    rows = [(i, " ".join([f"p{i}_{k}" for k in range(int(rng.integers(0, 80)))] + shared + [f"q{i}_{k}" for k in range(int(rng.integers(0, 80)))])) for i in range(60)]
    found = [set() for _ in rows]
    for units, row, _, _ in paragraph_dedup.units(pa.array([t.encode() for _, t in rows], pa.binary())):
        for unit, r in zip(units.tolist(), row.tolist(), strict=True):
            found[r].add(unit)
    assert all(found) and set.intersection(*found)


def test_marked_pages_have_no_say_in_the_template_of_the_others(spark):
    plain = "<html><body><div class=top><p>Menu line</div><div class=text><p>Story {0}</div></body></html>"
    marked = "<html><body><article><p>Marked {0}</article></body></html>"
    rows = [(i, "http://a.example/x", plain.format(i)) for i in range(6)] + [(i, "http://a.example/x", marked.format(i)) for i in range(6, 12)]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" if i < 6 else f"Marked {i}" for i in range(12)}


def test_wrapper_takes_what_is_constant_and_roles_take_the_rest(spark):
    page = "<html><body><div id=top><ul><li>Home<li>About</ul></div><div>Same line</div><div class=text><p>Story {0} &amp; <i>mo</i>re<p>Second   {0}</div><div class='comments'><p>nice</div><aside>side</aside></body></html>"
    rows = [(i, "http://a.example/x", page.format(i)) for i in range(5)] + [(9, None, None), (10, "bad url", "<article><h1>T</h1><p>one<br>two<script>x</script></article><footer>f</footer>"), (11, "http://a.example/", "")]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"Story {i} & more Second {i}" for i in range(5)]
    assert got[9] == "" and got[10] == "T one two" and got[11] == ""


def test_simple_tree_matching_skips_what_has_no_partner():
    a, b = html_wrapper.Page("<div><p>1</p><ul><li>2</ul></div>"), html_wrapper.Page("<div><h2>0</h2><p>1</p><ul><li>2</ul></div>")
    found = html_wrapper.align((a.structure(), b.structure()))
    assert [b.labels[found[i]] for i in range(len(a.labels))] == a.labels


def test_contained_items(spark, docs):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 120))), (2, " ".join(f"w{i}" for i in range(5000, 5030))), (3, "SHORT text"), (4, None), (5, " ".join(f"w{i}" for i in range(40)) + " x y")], "item_id long, text string")
    want = Counter()
    for d, t in DOCS:
        for r in items.collect():
            s = shingles(r.text)
            n = len(s & shingles(t))
            if s and 100 * n >= 75 * len(s):
                want[d, r.item_id, len(s), n] += 1
    got = Counter(tuple(r) for r in decontaminate.contained_items(docs, items).collect())
    assert got == want and len(want) > 4
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {d for d, _ in DOCS} - {7, 8, 9, 10}


def test_quality_verdicts(spark):
    good = "\n".join(f"Sentence {i} has words a{i} b{i} c{i} d{i} and ends {i * 7} here." for i in range(12))
    rows = [(1, good), (2, good.replace(".", "")), (3, "one two three " * 40 + "."), (4, None), (5, "Home | About | Contact\n" * 30), (6, good + "\nClick here to subscribe")]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.kept for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    for i, t in rows:
        w = WORD.findall(t or "")
        win = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        rep = {j + k for j in range(len(w) - 2) if win[tuple(w[j : j + 3])] > 1 for k in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
    assert "Click" not in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 6").first().text


def test_language_model_probabilities_sum_to_one_and_beat_the_base(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"t{int(x)}" for x in np.cumsum(rng.integers(0, 3, 40)) % 50)) for i in range(300)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = kneser_ney.train(docs, ~kneser_ney.held_out())
    got = kneser_ney.scores(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert model.tokens == sum(r.n_tokens for r in got if not r.held_out)
    scorer = kneser_ney.Scorer(model)
    vocabulary = [f"t{i}" for i in range(50)]
    buf = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    _, word, _ = kneser_ney.pairs(buf, np.array([0, len(buf)]))
    one = textpack.words(np.frombuffer(b"t7", np.uint8), np.array([0, 2]))[0] >> np.uint64(16) | np.uint64(4)
    unknown = np.array([12345 << 3], np.uint64)
    _, p = scorer.score(np.repeat(one, len(word) + 1), np.concatenate([word, unknown]))
    assert abs((10**p).sum() - 1) < 1e-9


def test_packing_is_gapless_and_cuts_only_long_documents(spark, docs):
    got = packing.packed_documents(docs, "byte_bpe_50k.json", 2, 64).collect()
    whole = tokenization.load("byte_bpe_50k.json")
    want = Counter()
    for d, t in DOCS:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 64)], [first, *range(first + 64, len(ids) + 1, 64)], strict=True)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 64) * 1.1 + 1


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "x<|endoftext|>y", "tab\tnl\n\nz", "it's we'll 12,5\nnew", "\x1c odd   space", "naïve Ünï \U0001f600 ok", ""])
def test_units_give_the_ids_of_the_whole_text(text):
    ids = tokenization.ByteLevelIds("byte_bpe_50k.json", 3)
    assert ids.encode(text) == ids._whole(text) == ids.encode(text)
    counts = tokenization.UnitCounts("word_bpe_49k.json")
    units = counts.units(text)
    assert (counts.whole(text) if units is None else sum(counts.counts(units))) == counts.whole(text)


def test_token_counts_of_unbroken_texts(spark, monkeypatch):
    texts = ["q7" * 50000, "\u4e2d\u6587" * 40000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = tokenization.load("word_bpe_49k.json")
    want = {i: (len(whole.encode(t, add_special_tokens=False).ids), True) for i, t in enumerate(texts)}
    assert all(n > 65535 for n, _ in want.values())
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.token_counts(rows, "word_bpe_49k.json", 65000).collect()} == want
    monkeypatch.setattr(token_counts, "COMMON", 1)
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.token_counts(rows, "word_bpe_49k.json", 65000).collect()} == want


def test_token_counts(docs):
    whole = tokenization.load("word_bpe_49k.json")
    want = Counter((d, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t in DOCS)
    got = token_counts.token_counts(docs, "word_bpe_49k.json", 2048).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_rare_pre_tokens_are_joined(docs, monkeypatch):
    want = Counter(tuple(r) for r in token_counts.token_counts(docs, "word_bpe_49k.json", 9).collect())
    monkeypatch.setattr(token_counts, "COMMON", 3)
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, "word_bpe_49k.json", 9).collect()) == want


def lines_spark(spark):
    rows = [(i, f"Common Line\n own {i}\n\n\tcommon line ") for i in range(12)] + [(50, None), (51, "common LINE"), (52, "rare\nrare")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_common_lines_go_by_either_way(spark, monkeypatch, limit):
    rows, docs = lines_spark(spark)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_common_lines(docs).collect()}
    assert got[3] == (" own 3\n", 4, 2) and got[50] == ("", 1, 0) and got[51] == ("", 1, 1) and got[52] == ("rare\nrare", 2, 0)


def test_line_counts_are_reversible(spark):
    _, docs = lines_spark(spark)
    state = line_dedup.reference_counts(docs)
    more = spark.createDataFrame([(90, "common line\nnew")], "doc_id long, text string")
    grown = line_dedup.update_counts(state, inserted=more)
    assert grown.count() == state.count() + 1
    back = line_dedup.update_counts(grown, deleted=more)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, state.collect()))
    with pytest.raises(Exception, match="not there"):
        line_dedup.update_counts(state, deleted=more).collect()


def test_cuckoo_filter_inserts_finds_and_deletes():
    keys = [line_dedup.key_digest(str(i).encode()) for i in range(5000)]
    made = line_dedup.CuckooFilter.build(keys)
    assert made.contains(keys).all()
    assert made.contains([line_dedup.key_digest(b"no%d" % i) for i in range(5000)]).mean() < 0.01
    assert all(made.delete(k) for k in keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01


def test_held_out_rule(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", kneser_ney.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_any_column_names_may_be_there(spark):
    text = " ".join(f"w{i}" for i in range(60)) + "."
    extra = ["text_key", "__text_key", "gone", "quality", "__quality", "id", "n", "cls", "component_id", "kept", "item_id", "sequence_id", "offset", "shard", "key", "spans"]
    rows = spark.createDataFrame([(1, text, *range(len(extra))), (2, text, *range(len(extra))), (3, None, *range(len(extra)))], "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in extra))
    items = spark.createDataFrame([(7, "none of these words is there", 1)], "item_id long, text string, doc_id long")
    for made, n in ((minhash_dedup.keep_first(rows), 2), (quality.clean(rows), 2), (paragraph_dedup.drop_repeats(rows), 3), (decontaminate.decontaminate(rows, items), 3), (line_dedup.drop_common_lines(rows).drop("n_lines", "n_dropped"), 3)):
        assert made.columns == rows.columns
        got = made.collect()
        assert len(got) == n and all([r[c] for c in extra] == list(range(len(extra))) for r in got)
    assert secret_scan.scan_versions(rows.withColumnRenamed("key", "blob"), keys=("doc_id", "blob")).columns == ["doc_id", "blob", "spans"]
    with pytest.raises(ValueError):
        secret_scan.scan_versions(rows, keys=("spans",))
    assert packing.packed_documents(rows, "byte_bpe_50k.json").count() == 3
    assert kneser_ney.scores(rows, kneser_ney.train(rows, ~kneser_ney.held_out())).count() == 3
    assert decontaminate.contained_items(rows, items).count() == 0


def test_empty_tables_of_pages_items_and_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "five words are in this")], "doc_id long, text string")
    assert html_wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert decontaminate.contained_items(docs, items).count() == 0 and decontaminate.contained_items(some, items).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == 0 and decontaminate.decontaminate(some, items).count() == 1
    assert paragraph_dedup.drop_repeats(docs).count() == 0 and minhash_dedup.keep_first(docs).count() == 0


def test_very_many_secrets_in_one_text(spark):
    n = 100_000
    text = "token=abcdef " * n
    row = secret_scan.scan_versions(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(row) == 2 and [(s.start, s.stop) for s in row[0].spans] == [(13 * i, 13 * i + 12) for i in range(n)]


def test_ids_and_counts_of_odd_texts_are_the_library_s():
    rng = np.random.default_rng(5)
    alphabet = [*"ab \n \n", "\xa0", "\u2003", "\t", "\r", "\x1c", "\x85", "é", "中", "<|", "the", "1", "'s", "!", "\u3000", "\x0b"]
    ids, counts = tokenization.ByteLevelIds("byte_bpe_50k.json"), tokenization.UnitCounts("word_bpe_49k.json")
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 12))))
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.encode(text), np.uint32).tolist() == want, text
        units = counts.units(text)
        assert (counts.whole(text) if units is None else sum(counts.counts(units))) == counts.whole(text), text
    assert np.frombuffer(ids.encode("a\xa0b\n\xa0"), np.uint32).tolist() == ids.tokenizer.encode("a\xa0b\n\xa0", add_special_tokens=False).ids


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)), p=np.arange(30, 0, -1) / 465))) for i in range(50)] + [(50, None), (51, "w1 unseen words W2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seq = {i: [*WORD.findall(low(t or "")), "</s>"] for i, t in texts}
    held = {i for i in seq if zlib.crc32(str(i).encode()) % 7 == 2}
    pair, one, total = Counter(), Counter(), Counter()
    for i in seq.keys() - held:
        for u, w in zip(["<s>", *seq[i]], seq[i]):
            pair[u, w] += 1
            one[w] += 1
            total[u] += 1

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
        return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))]

    contexts = Counter(w for _, w in pair)
    d, e, k_all, v = discounts(pair.values()), discounts(contexts.values()), len(pair), len(one)
    rest = sum(e[min(k, 3)] for k in contexts.values()) / k_all / (v + 1)

    def p(u, w):
        low_p = max(contexts[w] - e[min(contexts[w], 3)], 0) / k_all + rest
        if not total[u]:
            return low_p
        gamma = sum(d[min(c, 3)] for (x, _), c in pair.items() if x == u) / total[u]
        return max(pair[u, w] - d[min(pair[u, w], 3)], 0) / total[u] + gamma * low_p

    got = kneser_ney.scores(docs, kneser_ney.train(docs, ~kneser_ney.held_out())).collect()
    n = sum(one.values())
    assert len(got) == len(texts)
    for r in got:
        s = seq[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(s), sum(one[w] > 0 for w in s), n)
        assert abs(r.base_score - sum(math.log10((one[w] + 1) / (n + 1 * (v + 1))) for w in s)) < 1e-6
        assert abs(r.score - sum(math.log10(p(u, w)) for u, w in zip(["<s>", *s], s))) < 1e-6


@pytest.mark.parametrize("unit", ["-----BEGIN ", "-----BEGIN RSA PRIVATE KEY-----", "AB ", "eyJ", "eyJabcdefgh.", "a://", "ab.", "a://b:", "gh", "ghp_", "xoxb-", "xoxb-a", "AKIA", "0", "password", "password = ", "token\"", "api_key "])
def test_secret_rules_take_linear_time_on_what_they_begin_with(spark, unit):
    text = "-----BEGIN " + unit * (1_000_000 // len(unit)) + "KEY"
    began = time.monotonic()
    rows = secret_scan.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 1 and time.monotonic() - began < 60


def test_a_secret_does_not_begin_inside_a_run(spark):
    jwt = "eyJabcdefgh.eyJabcdefgh.abcdefgh"
    texts = {1: f"x{jwt}", 2: f"{jwt} {jwt}", 3: f"x.{jwt}", 4: "longerschemethanallowed://a:b@", 5: "http://a:b@ftp://c:d@", 6: "-----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----", 7: "-----BEGIN PRIVATE KEY-----ab-----END PRIVATE KEY-----"}
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secret_scan.scan_versions(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [("jwt", 0, 32), ("jwt", 33, 65)], 3: [("jwt", 2, 34)], 4: [], 5: [("url_login", 0, 11), ("url_login", 11, 21)], 6: [("pem", 0, 67 - 1)], 7: [("pem", 0, 54)]}


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_names_that_the_line_filters_use_may_be_there(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    names = ["__gone", "__text_key", "gone_", "text_key_", "text_key", "key"]
    rows = spark.createDataFrame([(i, "line\nown", *range(len(names))) for i in range(12)], "doc_id long, text string, " + ", ".join(f"`{c}` long" for c in names))
    made = line_dedup.drop_common_lines(rows).collect()
    assert len(made) == 12 and all([r[c] for c in names] == list(range(len(names))) and r.text == "" for r in made)


def test_packing_may_have_groups(spark):
    pieces = spark.createDataFrame([(i, 5, "x", "y") for i in range(10)], "id long, length long, `__group` string, `group` string")
    made = packing.pack(pieces, 10).collect()
    assert len(made) == 10 and {r["__group"] + r["group"] for r in made} == {"xy"} and len({r.sequence_id for r in made}) == 5
