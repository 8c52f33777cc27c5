"""Main text of web pages by wrapper induction over the pages of a host.

Pages become DOM trees.  Each host has one pivot page, and every page of the host is aligned with it by simple
tree matching, so work is linear in the pages and a hot host is spread over all tasks.  Nodes whose text is the
same on nearly all distinct pages of the host are its template; slots that vary are content.  All pages are aligned
and vote, those that mark their article (``article``, ``main``) too; an article is one slot, whose blocks may stand
anywhere in it.  A mark is a prior: what varies outside of it is content only where the marked part has less than
half of the text that is left.  A slot outside of articles that holds nothing but links on nearly all pages is a menu of
the template, whatever its links say.  Elements that by their name or class are menus, headers, footers, sidebars, notices,
adverts, forms or reader comments are never content, unless they are the page's body or its article itself.
"""

from __future__ import annotations

import html
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.llm.shared import durable, map_arrow

#: A node is template if one text stands there on this share of the host's distinct pages that have the node, of at
#: least so many.
CONSTANT_SHARE = 0.9
LEAST_PAGES = 3
#: Stands for the text of a block that is all links.
LINKS = 0
#: Pivots are broadcast up to so many bytes; beyond, they are joined by host and salt.
BROADCAST_BYTES = 16 << 20
SALTS = 32

_NAME = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*")
#: What ends a tag, or begins a quoted value in it.
_STOP = re.compile(r""">|=\s*["']""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-label|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe script select style svg template textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_CONTENT = frozenset("aside button dialog footer form head menu nav".split())
#: Elements that hold the page or its article: their classes say how it looks.
WHOLE = frozenset("article body html main".split())
#: Parts of class names, ids and roles that say that an element is not content.
NOISE = frozenset("ad ads advert advertisement adverts alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr menu menubar modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select")


#: Longer attributes, and longer pages, are not remembered.
ATTRIBUTE_CHARS, LONG_KEY = 1 << 16, 1 << 20
#: Scores that one alignment keeps to use again, and an eighth of the bytes of its tables' steps; beyond, they are made
#: anew.  The alignment is the same.
CELLS = 4_000_000


class _Memory(OrderedDict):
    """The last ``most`` results of a function, but for texts that are too long to keep."""

    def __init__(self, make, most: int, longest: int = LONG_KEY):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.popitem(last=False)
        made = self[key] = self.make(key)
        return made


def _attributes(raw: str) -> tuple[bool, str]:
    """Whether attributes say that an element is not content, and the class it has in the tree."""
    noise, label = False, ""
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            noise = True
        elif name in ("class", "id", "role"):
            noise = noise or not NOISE.isdisjoint(_PARTS.findall(value))
            if name != "id":
                label += "." + value
    return noise, label


def tags(text: str):
    """(start, end, name, attributes) of every tag, in one pass; the name of an end tag begins with a slash.

    Comments, declarations and processing instructions have an empty name.  A quoted value may hold ``>``, up to the
    first tag that would run to the end of the page that way; from there on the next ``>`` ends a tag.  Where no ``>``
    follows, ``<`` is text.
    """
    at, n, quotes = 0, len(text), True
    last = text.rfind(">")
    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", ""
            at = end
            continue
        if at > last:
            return
        if text.startswith(("<!", "<?"), at):
            end = text.index(">", at) + 1
            yield at, end, "", ""
            at = end
            continue
        m = _NAME.match(text, at)
        if m is None:
            at += 1
            continue
        end = m.end()
        while quotes:
            stop = _STOP.search(text, end)
            if stop is None:
                quotes = False
            elif stop[0] == ">":
                end = stop.end()
                break
            else:
                close = text.find(stop[0][-1], stop.end())
                quotes, end = close >= 0, close + 1
        if not quotes:
            end = text.index(">", m.end()) + 1
        yield at, end, m[0][1:].lower(), text[m.end() : end - 1]
        at = end


class Page:
    """The tree of a page outside its article, and its blocks of text; read in time linear in the page.

    ``labels`` and ``children`` describe the elements; a marked article is a leaf.  Blocks are
    (text, node, place, linked): place 2 in ``article``, 1 in ``main``, 0 elsewhere, -1 where nothing is content;
    ``linked`` if all of it stands in links.
    """

    attributes = _Memory(_attributes, 5000, ATTRIBUTE_CHARS)

    def __init__(self, text: str):
        self.labels: list[str] = ["#"]
        self.children: list[list[int]] = [[]]
        self.blocks: list[tuple[str, int, int, bool]] = []
        self._parse(text)

    def _parse(self, text: str) -> None:
        labels, children, blocks = self.labels, self.children, self.blocks
        stack: list[tuple[str, int, bool, int]] = [("#", 0, False, 0)]  # tag, node, noise, place
        where: dict[str, list[int]] = {}  # the depths of the open elements of each name
        inner: list[int] = []  # the depths of the open blocks
        current: list[str] = []
        linked = True
        at, n = 0, len(text)
        tag, node, noise, place = stack[0]

        def flush() -> None:
            nonlocal linked
            if current:
                words = "".join(current)
                if "&" in words:
                    words = html.unescape(words)
                if words := " ".join(words.split()):
                    blocks.append((words, node, -1 if noise else place, linked))
                current.clear()
            linked = True

        def add(some: str) -> None:
            nonlocal linked
            current.append(some)
            if linked and not where.get("a") and not some.isspace():
                linked = False

        def close(k: int) -> None:
            nonlocal tag, node, noise, place
            for name, *_ in reversed(stack[k:]):
                where[name].pop()
            while inner and inner[-1] >= k:
                inner.pop()
            del stack[k:]
            tag, node, noise, place = stack[-1]

        raw = ""
        for start, end, name, attrs in tags(text):
            if raw:  # text up to the end tag of an element whose content is no markup
                if name == "/" + raw:
                    raw = ""
                    at = end
                continue
            if start > at:
                add(text[at:start])
            at = end
            if not name:
                continue
            if name[0] == "/":
                name = name[1:]
                if name in BLOCK:
                    flush()
                open_ = where.get(name)
                # the end of an inline element does not end blocks around it
                if open_ and (name in BLOCK or not inner or open_[-1] > inner[-1]):
                    if inner and inner[-1] >= open_[-1]:
                        flush()
                    close(open_[-1])
                continue
            if name in VOID:
                if name == "br":
                    current.append(" ")
                elif name == "hr":
                    flush()
                continue
            if name in RAW:
                raw = name
                continue
            if name in BLOCK:
                flush()
                if inner and stack[inner[-1]][0] == "p":
                    close(inner[-1])
                if name in _CLOSES:
                    deepest = lambda names: max((where[x][-1] for x in names if where.get(x)), default=-1)
                    if (k := deepest(_CLOSES[name])) > deepest(_LISTS):
                        close(k)
            said, label = self.attributes[attrs] if attrs.strip() else (False, "")
            inside = 2 if name == "article" else max(place, 1) if name == "main" or ".main" in label else place
            said = said and name not in WHOLE and not (label and "content" in _PARTS.findall(label))
            bad = noise or said or name in NOT_CONTENT or name == "header" and place == 0
            if place == 0 and name in BLOCK:  # elements inside an article are no part of the wrapper
                labels.append(name + label)
                children.append([])
                children[node].append(len(labels) - 1)
                node = len(labels) - 1
            tag, noise, place = name, bad, inside
            where.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                inner.append(len(stack))
            stack.append((tag, node, noise, place))
        if not raw and at < n:
            add(text[at:])
        flush()

    def structure(self) -> tuple:
        return tuple(self.labels), tuple(map(tuple, self.children))


def _shapes(labels: tuple, children: tuple) -> list[int]:
    """The hash of every node's subtree; children come after their parents."""
    made = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        made[i] = hash((labels[i], tuple(made[c] for c in children[i])))
    return made


class _Level:
    """Nodes of the second tree under one path of labels, one of each shape, and the cells over their children.

    The cells of a node are one for no child and one for each child, and the nodes' cells stand side by side, so that a
    child of the first tree is held against the children of all of them at once.  Each node's scores begin so far above
    those of the node before that a running maximum starts anew there.
    """

    def __init__(self, lists: list[tuple], labels: tuple, shapes: list[int], column: dict[int, int]):
        self.column = column
        sizes = np.array([len(x) + 1 for x in lists])
        self.end = np.cumsum(sizes) - 1
        self.start = self.end - sizes + 1
        self.zero = np.repeat(np.arange(len(lists)) * (len(labels) + 1), sizes)
        self.made: dict[str, tuple] = {}
        self.found: dict[str, tuple[list[int], list[int]]] = {}
        for k, nodes in zip(self.start.tolist(), lists, strict=True):
            for cell, q in enumerate(nodes, k + 1):
                cells, there = self.found.setdefault(labels[q], ([], []))
                cells.append(cell)
                there.append(q)

    def under(self, label: str, labels: tuple, children: tuple, shapes: list[int]) -> tuple | None:
        """The cells of the children of one label, which column each is of the level below, and that level."""
        if label in self.found and label not in self.made:
            cells, nodes = self.found[label]
            column: dict[int, int] = {}
            lists = []
            for q in nodes:
                if shapes[q] not in column:
                    column[shapes[q]] = len(lists)
                    lists.append(children[q])
            self.made[label] = np.array(cells), np.array([column[shapes[q]] for q in nodes]), _Level(lists, labels, shapes, column)
        return self.made.get(label)


def _ends(x: tuple, y: tuple, sa: list[int], sb: list[int]) -> tuple[int, int]:
    """How many equal subtrees two lists of nodes begin and end with."""
    most = min(len(x), len(y))
    # what follows the varying part mostly keeps its distance from the end
    hi = next((k for k in range(most) if sa[x[-1 - k]] != sb[y[-1 - k]]), most)
    return next((k for k in range(most - hi) if sa[x[k]] != sb[y[k]]), most - hi), hi


def align(pair: tuple[tuple, tuple]) -> dict[int, int]:
    """Simple tree matching of two structures: the nodes of the first that have a partner in the second.

    Always a largest matching, whatever the size.  Equal subtrees at the ends of two lists of children are partners in
    some best alignment and go without a table.  Time grows with the pairs of nodes under equal paths of labels that are
    left, at worst with the product of the pages, as is in the nature of the best alignment of two lists.  Memory does
    not: of the tables' steps, two bits a cell, only some are kept, and the others are made again when they are needed.
    """
    (la, ca), (lb, cb) = pair
    if pair[0] == pair[1]:
        return {i: i for i in range(len(la))}
    sa, sb = _shapes(la, ca), _shapes(lb, cb)
    found: dict[int, int] = {}

    def tables(u: tuple, top: _Level, starts: list[tuple[int, np.ndarray]], stop: int) -> dict[tuple[_Level, int | None], list[bytes]]:
        """The steps of each child, for every level and shape that is held against it, from the last start up to ``stop``.

        Where steps are too many, those of the nodes of ``u`` so far are given up for a new start behind them, and those
        of what is below one node are given up.
        """
        first, score = starts[-1]
        places: dict[tuple[_Level, int | None], list[bytes]] = {}
        worths: dict[tuple[_Level, int], np.ndarray] = {}  # what a shape is worth at the cells of the level above
        held = kept = own = 0
        open_ = [[None, top, iter(u[first:stop]), []]]
        scores = [score]
        waiting: list[int] = []  # the children that the open nodes are
        row = None
        while True:
            shape, level, left, place = open_[-1]
            p = next(left, -1) if row is None else waiting.pop()
            if p < 0:
                if place is not None:
                    places[level, shape] = place
                open_.pop()
                row = scores.pop()[level.end] - level.zero[level.end] + 1
                if not open_:
                    return places
                continue
            below = level.under(la[p], lb, cb, sb)
            if below is None:  # nothing to be a partner of
                if place is not None:
                    place.append(b"")
                continue
            cells, column, down = below
            worth = worths.get((down, sa[p])) if row is None else None
            if worth is None:
                if row is None and ca[p]:
                    waiting.append(p)
                    open_.append([sa[p], down, iter(ca[p]), []])
                    scores.append(down.zero)
                    continue
                worth = np.full(len(level.zero), -1)
                worth[cells] = 1 if row is None else row[column]
                row = None
                if held + len(worth) > CELLS:
                    worths.clear()
                    held = 0
                worths[down, sa[p]] = worth
                held += len(worth)
            before = scores[-1]
            both = before[:-1] + worth[1:]
            now = before.copy()
            np.maximum(before[1:], both, out=now[1:])
            now = scores[-1] = np.maximum.accumulate(now)
            if place is None:
                continue
            step = np.zeros((2, len(now)), bool)  # whether the child is taken; whether it makes no difference
            np.equal(now[1:], both, out=step[0, 1:])
            np.equal(now, before, out=step[1])
            place.append(np.packbits(step, axis=1).tobytes())
            if level is top:
                own += len(place[-1])
                if own + kept <= 8 * CELLS or len(place) ** 2 <= 32 * len(u) or first + len(place) >= stop:
                    continue
                first += len(place)
                starts.append((first, now))
                place.clear()
                own = 0
            else:
                kept += len(place[-1])
                if kept <= 8 * CELLS:
                    continue
                for node in open_[1:]:
                    node[3] = None
            places.clear()
            worths.clear()  # what is met again is to be kept again
            held = kept = 0

    def match(u: tuple, v: tuple) -> None:
        """Partners among and below two lists of nodes by the tables' steps, from the ends on."""
        top = _Level([v], lb, sb, {})
        starts = [(0, top.zero)]
        stop, rest = len(u), len(v)
        while starts and rest:
            places = tables(u, top, starts, stop)
            first, _ = starts.pop()
            open_ = [(u, v, top, places[top, None], first, 0, first, 0, stop, rest)]
            while open_:
                x, y, level, place, skipped, cell, low, least, p, q = open_.pop()
                width = (len(level.zero) + 7) // 8
                while p > low and q > least:
                    steps = place[p - 1 - skipped]
                    at, bit = cell + q >> 3, 128 >> (cell + q & 7)
                    if steps and steps[at] & bit:
                        p, q = p - 1, q - 1
                        i, j = x[p], y[q]
                        found[i] = j
                        down = level.made[la[i]][2]
                        below = places.get((down, sa[i]))
                        if sa[i] == sb[j]:
                            equal.append((i, j))
                        elif below is None:
                            todo.append((i, j))
                        else:
                            lo, hi = _ends(ca[i], cb[j], sa, sb)
                            pairs_at_ends(ca[i], cb[j], lo, hi)
                            open_.append((ca[i], cb[j], down, below, 0, int(down.start[down.column[sb[j]]]), lo, lo, len(ca[i]) - hi, len(cb[j]) - hi))
                    elif not steps or steps[at + width] & bit:
                        p -= 1
                    else:
                        q -= 1
                if level is top:
                    stop, rest = first, q

    equal: list[tuple[int, int]] = []

    def pairs_at_ends(x: tuple, y: tuple, lo: int, hi: int) -> None:
        equal.extend(zip(x[:lo], y[:lo], strict=True))
        equal.extend(zip(x[len(x) - hi :], y[len(y) - hi :], strict=True))

    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[i] = j
        if la[i] != lb[j]:  # roots of different labels
            continue
        x, y = ca[i], cb[j]
        lo, hi = _ends(x, y, sa, sb)
        pairs_at_ends(x, y, lo, hi)
        u, v = x[lo : len(x) - hi], y[lo : len(y) - hi]
        there = {lb[q]: q for q in v}
        alike = [(p, there[la[p]]) for p in u if la[p] in there]
        mine = {la[p] for p in u}
        if len(mine) == len(u) and len(there) == len(v) and alike == sorted(alike, key=lambda z: z[1]):
            todo += alike  # labels are names, and there is one choice only
        elif alike:
            match(u, v)
    while equal:
        i, j = equal.pop()
        found[i] = j
        equal.extend(zip(ca[i], cb[j], strict=True))
    return found


class Wrapper:
    """Aligns pages with their hosts' pivots, remembering pivots and alignments of equal structures."""

    def __init__(self):
        self.pivots = _Memory(lambda text: Page(text).structure(), 200)
        self.aligned = _Memory(align, 200)

    def nodes(self, page: Page, pivot: str):
        """The pivot's nodes that have a partner in the page."""
        return self.aligned[page.structure(), self.pivots[pivot]].values()

    def slots(self, page: Page, pivot: str) -> list[tuple[str, int, int, int, bool]]:
        """(text, slot, number of the block in its node, place, linked) of every block; slot -1 without partner.

        Blocks of an article have the number -2, since they may stand anywhere in it.
        """
        partner = self.aligned[page.structure(), self.pivots[pivot]]
        out, last, k = [], -1, 0
        for text, node, place, linked in page.blocks:
            k = k + 1 if node == last else 0
            last = node
            out.append((text, partner.get(node, -1), -2 if place > 0 else k, place, linked))
        return out


def _digest(text: str) -> int:
    import xxhash

    return (xxhash.xxh3_64_intdigest(text) - (1 << 63)) or 1


def content(blocks: list[tuple[str, int, int, int, bool]], template: set[tuple[int, int, int]]) -> str:
    """The blocks that are content, joined by one space."""
    menu = lambda x: x[4] and x[3] == 0 and (x[1], x[2], LINKS) in template
    left = [x for x in blocks if x[3] >= 0 and not (template and ((x[1], x[2], _digest(x[0])) in template or menu(x)))]
    for place in (2, 1):
        marked = [x[0] for x in left if x[3] >= place]
        if marked and 2 * sum(map(len, marked)) >= sum(len(x[0]) for x in left):
            return " ".join(marked)
    return " ".join(x[0] for x in left)


def _with_pivots(pages: DataFrame, pivots: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    if extra is not None:
        pivots = pivots.join(extra, "host", "left")
    size = F.length("pivot") + (32 * F.greatest(F.size("template"), F.lit(0)) if extra is not None else F.lit(0))
    if pivots.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return pages.join(F.broadcast(pivots), "host", "left")
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.expr(f"cast(pmod(xxhash64(html), {SALTS}) as int)")).join(salted, ["host", "salt"], "left").drop("salt")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of ``pages``.

    ``text`` is the page's content: character references decoded, white space inside a block turned into one
    space and trimmed, blocks joined by one space in page order.  A null or empty page has the empty text.  Pages
    without a url share the empty host.  Empty pages have no part in a template; copies of a page count once for its host's template; repeated rows give
    repeated rows; other columns are ignored.  Nothing is cut, whatever the length.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    written = rows.where("html <> ''")
    pivots = durable(written.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), F.length("html"))).alias("pivot")), "pivots")

    def vote(batches):
        wrapper = Wrapper()
        for batch in batches:
            out: dict[tuple, None] = {}
            for h, text, pivot in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                page = Page(text)
                body = _digest("\n".join(x[0] for x in page.blocks))
                for slot in wrapper.nodes(page, pivot):
                    out[h, slot, -1, 0, body] = None
                for words, slot, k, place, linked in wrapper.slots(page, pivot):
                    if slot >= 0 and place >= 0:
                        out[h, slot, k, _digest(words), body] = None
                        if linked and place == 0:
                            out[h, slot, k, LINKS, body] = None
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "slot", "k", "text", "body"])

    votes = map_arrow(_with_pivots(written.select("host", "html"), pivots).select("host", "html", "pivot"), vote, "host string, slot int, k int, text long, body long")
    counted = votes.distinct().groupBy("host", "slot", "k", "text").agg(F.count("*").alias("n"))
    counted = durable(counted, "votes")
    several = counted.where("k = -1").select("host", "slot", F.col("n").alias("bodies")).where(F.col("bodies") >= LEAST_PAGES)
    constant = counted.where("k <> -1").join(several, ["host", "slot"]).where(F.col("n") >= CONSTANT_SHARE * F.col("bodies"))
    template = constant.groupBy("host").agg(F.collect_set(F.struct("slot", "k", "text")).alias("template"))

    def extract(batches):
        wrapper = Wrapper()
        for batch in batches:
            texts = []
            for text, pivot, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                page = Page(text)
                if template and pivot:
                    texts.append(content(wrapper.slots(page, pivot), {(x["slot"], x["k"], x["text"]) for x in template}))
                else:
                    texts.append(content([(t, -1, 0, place, linked) for t, _, place, linked in page.blocks], set()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["a", "b", "c", "d"])

    joined = _with_pivots(rows, pivots, template).select("page", "url", "html", "pivot", "template")
    kind = dict(pages.dtypes)
    return map_arrow(joined, extract, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long")
