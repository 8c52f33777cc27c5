"""Main text where nothing but repetition tells the template from the content."""

import random
import time

import pytest

from kinweft.llm import html_wrapper


def pages_of(host, seed, n, marked=lambda i: False):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    top, side, end = (" ".join(word() for _ in range(k)) for k in (4, 6, 8))
    rows, want = [], []
    for i in range(n):
        own = [" ".join(word() for _ in range(r.randint(5, 25))) for _ in range(r.randint(2, 6))]
        tag = "article" if marked(i) else "div class='x3'"
        body = "".join(f"<p>{p}</p>" for p in own)
        rows.append((f"{host}-{i}", f"https://{host}/p{i}", f"<html><body class='has-sidebar'><div class='x1'><div>{top}</div></div><{tag}>{body}<p>{side}</p></{tag.split()[0]}><div class='x2'><p>{end}</p></div></body></html>"))
        want.append(" ".join(own))
    return rows, want


def test_hosts_without_marks_and_telling_names(spark):
    rows, want = [], {}
    for k, marked in enumerate((lambda i: False, lambda i: i >= 8, lambda i: i % 2 == 0, lambda i: True)):
        made, texts = pages_of(f"h{k}.example", k, 10, marked)
        rows += made
        want |= {r[0]: t for r, t in zip(made, texts, strict=True)}
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for page, text in want.items():
        if page.startswith("h0") or page.startswith("h3"):
            assert got[page] == text, page
        else:  # two layouts: the text is whole, and what surrounds it is gone
            assert text in got[page] and len(got[page]) <= len(text) + 60, page


def test_a_mark_is_a_prior(spark):
    words = "one two three four five six seven eight nine ten " * 5
    rows = [(1, "https://a.example/", f"<body><main><article><p>Teaser</p></article><p>{words}</p></main></body>"), (2, "https://b.example/", f"<body class='no-comments'><article class='post no-comments'><p>{words}</p></article><p>Elsewhere</p></body>"), (3, "https://c.example/", f"<body><article>Short</article><div>{words}</div></body>")]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"Teaser {words}".strip(), 2: words.strip(), 3: f"Short {words}".strip()}


def best(a, b):
    """The size of a largest matching of two trees (label, children) that keeps labels, parents and order."""
    if a[0] != b[0]:
        return 0
    t = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + best(x, y))
    return 1 + t[-1][-1]


def flat(tree):
    labels, children = [], []

    def walk(node):
        labels.append(node[0])
        children.append([])
        me = len(labels) - 1
        children[me].extend([walk(c) for c in node[1]])
        return me

    walk(tree)
    return tuple(labels), tuple(map(tuple, children))


def test_alignment_is_a_largest_matching(monkeypatch):
    r = random.Random(5)

    def tree(depth):
        return (r.choice("aab"), [tree(depth - 1) for _ in range(r.randint(0, 4))] if depth else [])

    for n in range(300):
        a, b = ("r", [tree(3) for _ in range(3)]), ("r", [tree(3) for _ in range(3)])
        fa, fb = flat(a), flat(b)
        monkeypatch.setattr(html_wrapper, "CELLS", 300_000 if n < 200 else 3)
        found = html_wrapper.align((fa, fb))
        assert all(fa[0][i] == fb[0][j] for i, j in found.items()) and len(set(found.values())) == len(found)
        up = [{c: i for i, cs in enumerate(t[1]) for c in cs} for t in (fa, fb)]
        assert all(found[up[0][i]] == up[1][j] for i, j in found.items() if i)
        order = sorted(found)
        assert all(found[x] < found[y] for x, y in zip(order, order[1:], strict=False))
        assert len(found) == best(a, b) if n < 200 else len(found) <= best(a, b)


def test_long_lists_are_aligned_by_a_largest_matching_too(monkeypatch):
    r = random.Random(6)
    some = lambda n: ("r", [("div", [(r.choice("ab"), []) for _ in range(r.randint(0, 4))]) for _ in range(n)])
    a, b = some(620), some(600)
    pair = flat(a), flat(b)
    found = html_wrapper.align(pair)
    assert len(found) == best(a, b)
    # what is held in memory has no say in it
    monkeypatch.setattr(html_wrapper, "CELLS", 3)
    assert html_wrapper.align(pair) == found


def test_attributes_of_any_length_are_looked_at():
    page = html_wrapper.Page(f"<body><div style='background:url(data:{'A' * 100_000})' class='sidebar'>x</div><p>y</p></body>")
    assert [(words, place) for words, _, place, _ in page.blocks] == [("x", -1), ("y", 0)]


@pytest.mark.parametrize("text", ["<p " + x * (1_000_000 // len(x)) + ">y" for x in ("class ", " class=", " class='\"", ' class="x', " class = ", "class" + " " * 1000, " class='x'y", ' id="" class=x')])
def test_long_attributes_are_read_in_linear_time(text):
    began = time.monotonic()
    html_wrapper.Page(text)
    assert time.monotonic() - began < 8


@pytest.mark.parametrize("text", ["<a " * 350_000, '<a href="x>' * 100_000, "<a b='\">" * 150_000, "<b>" * 150_000 + "</i>" * 150_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<div></div>" * 50_000, "<div>" * 100_000 + "<li></li>" * 50_000, "<script>" + "</script " * 100_000, "<!--" * 250_000, "<!" * 500_000, "<p " + "class=" * 150_000 + ">", '<p class="' + "x " * 500_000 + '">y', "<" * 1_000_000, "&lt" * 300_000, "<svg>" * 200_000])
def test_a_page_is_read_in_linear_time(text):
    began = time.monotonic()
    html_wrapper.Page(text)
    assert time.monotonic() - began < 8


def test_long_lists_of_siblings_are_aligned_in_bounded_time():
    page = lambda seed, n: html_wrapper.Page("<div>" + "".join(f"<div class='c{random.Random(seed * n + i).randint(0, 9 * n)}'><p>{i}</p><span></span><ul><li>x</ul></div>" for i in range(n)) + "</div><footer>f</footer>")
    for n in (1000, 10_000):
        a, b = page(1, n).structure(), page(2, n).structure()
        began = time.monotonic()
        found = html_wrapper.align((a, b))
        assert time.monotonic() - began < 8 and 0 in found
    deep = html_wrapper.Page("<div>" * 20_000).structure(), html_wrapper.Page("<div>" * 19_000).structure()
    assert len(html_wrapper.align(deep)) == 19_001


def test_menus_whose_links_change_are_template(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    rows, want = [], {}
    for i in range(12):
        own = [" ".join(word() for _ in range(20)) + f" <a href='x'>{word()}</a>" for _ in range(3)]
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in (word() for _ in range(5)))
        rows.append((i, "http://m.example/", f"<body><div class='x1'><ul>{menu}</ul></div><div class='x2'>{''.join(f'<p>{p}</p>' for p in own)}</div></body>"))
        import re

        want[i] = re.sub("<[^>]*>", "", " ".join(own))
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
