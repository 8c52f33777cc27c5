"""Source divergence, hard negatives and URL filters against plain evaluations on awkward small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweft.llm import divergence, hard_negatives, shared, url_rules

DOCS = "doc_id long, lang string, source string, text string, term string, block long, n long, p long, value long, rank int"
WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audit(rows, least, top):
    """The definition, term by term."""
    rows = [(a or "", b or "", [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")]) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs, counts, own = Counter(), Counter(), defaultdict(Counter)
        for _, s, w in mine:
            docs.update(set(w))
        keep = {t for t, n in docs.items() if n >= least}
        for _, s, w in mine:
            own[s].update(x for x in w if x in keep)
            counts.update(x for x in w if x in keep)
        v = len(keep)
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(f(p(own[s], t), p(own[o], t)) for t in keep), o.encode()) for o in own if o != s)
            found = sorted((-f(p(own[s], t), p(counts, t)), t.encode()) for t in keep if own[s][t] and p(own[s], t) > p(counts, t))[:top]
            out |= {(lang, s, part, i.decode(), -x, k + 1) for part, items in (("pair", pairs), ("term", found)) for k, (x, i) in enumerate(items)}
    return out


def documents(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "a_b", "x1y", "naïve", "日本", "Ω", "\u00a0", "z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, r.choice(["en", "en", "en", None, "fr", ""]), r.choice(["s", "s", "s", "t", "Ü", None, "日"]), " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(n)]
    return [*rows, (None, "xx", "lonely", None), (n, "yy", "a", ""), (n, "yy", "b", "12 34"), (1, "en", "s", "the " * 50_000 + "q" * 300_000), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "bound", "chunk"), [(1, 16 << 20, 200_000), (2, 0, 7), (3, 0, 200_000)])
def test_divergence_equals_the_definition(spark, monkeypatch, seed, bound, chunk):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = documents(seed, 150)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in divergence.audit(df, least_docs=5, top=4).collect()]
    assert set(got) == audit([r[1:] for r in rows], 5, 4) and len(got) == len(set(got))


def test_divergence_folds_the_same_in_small_blocks_and_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "The quick_brown 12 FOX élan\u0085x" * 20
    assert [w.decode() for some in divergence.terms(text.encode()) for w in some] == [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text)]


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


VECTORS = "vec_id long, label int, embedding array<double>, id long, vector string, anchor boolean, i int, score long"


def negatives(rows):
    """The definition, row by row."""
    good = [(i, label, [int(256 * x // 1) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], 1 << 70 if x[1] is None else x[1])
    out = []
    for k, (a, label, v) in enumerate(good):
        if a is None or a % 100:
            continue
        for s, p in sorted(((dot(v, w), i) for j, (i, other, w) in enumerate(good) if other == label and j != k), key=order)[:5]:
            hard = sorted(((dot(v, w), i) for i, other, w in good if other != label and 30 * s <= 100 * dot(v, w) <= 90 * s), key=order)[:10]
            out += [(a, p, n + 1, i, s, x) for n, (x, i) in enumerate(hard)]
    return out


def vectors(seed, n, dims, scale=1.0):
    r = random.Random(seed)
    made = [(r.choice([i, i, i, 100 * r.randint(0, 3)]), r.choice([0, 0, 0, 1, 2, None]), [r.choice([r.gauss(0.3, 1) * scale, 0.0, 0.5]) for _ in range(dims)]) for i in range(n)]
    some = made[: n // 10]
    return [*made, *some, (None, 1, made[1][2]), (5, 1, None), (6, 1, [float("nan")] * dims), (7, 2, [float("inf")] * dims), (8, 0, [None, 1.0]), (9, 0, []), (200, 1, []), (300, 2, [1.0] * (dims + 3)), (11, 1, [0.5])]


@pytest.mark.parametrize(("seed", "n", "dims", "scale", "block", "bound"), [(1, 300, 8, 1.0, 1024, 16 << 20), (2, 200, 5, 1.0, 16, 4000), (3, 120, 3, 1e4, 7, 400), (4, 80, 4, 4e5, 32, 16 << 20), (6, 60, 2, 1e6, 32, 16 << 20), (5, 60, 1, 1e-3, 8, 2000)])
def test_hard_negatives_equal_the_definition(spark, monkeypatch, seed, n, dims, scale, block, bound):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    rows = vectors(seed, n, dims, scale)
    df = spark.createDataFrame([(*r, 1, "x", True, 2, 3) for r in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(negatives(rows), key=key) and got


def test_bounds_hold_and_save_exact_scores():
    import numpy as np

    r = np.random.default_rng(0)
    x = np.floor(256 * r.normal(size=(1000, 16)))
    import pyarrow as pa

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 0

    hard_negatives.TaskContext, kept = Here, hard_negatives.TaskContext
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([0] * 1000), pa.array((x / 256).tolist(), pa.list_(pa.float64()))], names=["id", "label", "vector"])
        row = next(iter(hard_negatives._pack(1000, True)([batch]))).to_pylist()[0]
    finally:
        hard_negatives.TaskContext = kept
    block = hard_negatives._Block(row)
    m = hard_negatives._Meeting(block, block)
    exact = np.array(m.scores(3, np.arange(1000)))
    lower, upper = m.bounds(3, slice(0, 1000))
    assert (lower <= exact).all() and (exact <= upper).all()
    best = hard_negatives._Best(10)
    assert hard_negatives._enough(upper, lower, best).sum() < 150


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    without = spark.createDataFrame([(1, 1, [0.5], 1, "x", True, 2, 3)], VECTORS)
    assert hard_negatives.mine(without, F.col("vec_id") % 100 == 0).collect() == []


PAGES = "page_id long, url string, html string, host string, path string, key string, rule string, verdict string, token string"
RULES = (url_rules.Rule("net/", "block"), url_rules.Rule("example.net/en/", "allow"), url_rules.Rule("example.com/de/", "block"), url_rules.Rule("org/fr/", "allow"))
URLS = [
    None, "", "no scheme", "http://", "://net/", "http://net", "http://net/", "HTTP://A.NET/x", "http://anet/x", "http://a.net:80/x", "http://example.net/en/1", "https://www.EXAMPLE.net/en/1?x=/de/", "http://example.net/en", "http://badexample.net/en/", "http://example.net/EN/",
    "http://m.example.com/de/#x", "http://example.com/de?/de/", "http://x.org/fr/a", "http://x.org/fr", "http://org/fr/", "http://a.org/wp-admin/x", "http://a.org/fr/cart/", "http://a.com/x/cart/y", "http://a.com/xcart/y", "http://a.com/file.ZIP", "http://a.com/file.zip", "http://a.com/file.zip?x", "http://a.com/file.zip/x",
    "http://a.com/\n.zip", "http://é.net/ü", "http://a.com/wp-login.phpx", "a://b://c.net/", "http://user@host.net/", "http://x.org?/fr/", "http://x.org#/fr/",
]


def verdict(url, rules, general):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate({k: k + 32 for k in range(65, 91)})

    def fits(r):
        want, _, begin = r.pattern.partition("/")
        if want != "*" and host != want and not host.endswith("." + want):
            return False
        body = "/" + begin
        end = body.endswith("$")
        first, star, last = body.removesuffix("$").partition("*")
        if not path.startswith(first):
            return False
        if star:
            return path.endswith(last) and len(path) >= len(first) + len(last) if end else last in path[len(first) :]
        return path == first if end else True

    for tier in (rules, general):
        if found := [r for r in tier if fits(r)]:
            best = max(found, key=lambda r: (len(r.pattern), -tier.index(r)))
            return host, path, best.pattern if tier is rules else None, best.action, best.pattern if tier is general else None
    return host, path, None, "allow", None


MORE = (url_rules.Rule("*/", "block"), url_rules.Rule("a.com/f*p$", "allow"), url_rules.Rule("example.com/d", "block"), url_rules.Rule("*/*/FR/", "block"), url_rules.Rule("x.org/fr", "block"), url_rules.Rule("x.org/fr", "allow"), url_rules.Rule("com/*(a|b)+", "block"))


@pytest.mark.parametrize(("rules", "bound"), [(RULES, 16 << 20), (RULES, 0), (MORE, 16 << 20), ((), 0)])
def test_url_verdicts_equal_a_plain_scan_of_the_rules(spark, monkeypatch, rules, bound):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    long = ["http://a.com/" + "en/" * 50_000 + "x.zip", "http://" + "a." * 50_000 + "net/"]
    urls = URLS + long + URLS[5:9]
    df = spark.createDataFrame([(i, u, "x", "h", "p", "k", "r", "v", "t") for i, u in enumerate(urls)] + [(None, "http://q.net/", *"xhpkrvt")], PAGES)
    got = {r.page_id: tuple(r)[1:] for r in url_rules.verdicts(df, rules).collect()}
    assert got == {i: verdict(u, list(rules), list(url_rules.GENERAL)) for i, u in [*enumerate(urls), (None, "http://q.net/")]}


def test_tokens_stand_whole_in_what_fits():
    assert url_rules.Rule("example.net/en/", "block").tokens == ["en", "example", "net"]
    assert url_rules.Rule("example.net/en", "block").tokens == ["example", "net"]
    assert url_rules.Rule("*/a*b/c.zip$", "block").tokens == ["c", "zip"]
    assert url_rules.Rule("*/x", "block").tokens == []
    for wrong in ("net", "/x", "a*b/", "A.net/", "a/**", "a/?x"):
        with pytest.raises(ValueError, match="not a rule"):
            url_rules.Rule(wrong, "block")


def test_url_filters_of_nothing_and_clashing_ids(spark):
    assert url_rules.verdicts(spark.createDataFrame([], PAGES), RULES).collect() == []
    df = spark.createDataFrame([("1", "http://a.net/")], "Host string, url string")
    assert url_rules.verdicts(df, RULES, id_col="Host").first().asDict() == {"Host_": "1", "host": "a.net", "path": "/", "rule": "net/", "verdict": "block", "general_rule": None}
