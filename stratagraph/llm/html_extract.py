"""Main text of web pages by minimum cut.

A page's blocks are nodes between a source (article) and a sink
(boilerplate).  A classifier's costs are the terminal capacities; blocks next
to each other, and blocks of one parent element, are tied by smoothness
edges, the stronger the nearer they are in the element tree.  The maximum
flow separates the article from the rest at least cost.

The classifier is a logistic regression over what the elements around a block
are called, by whole words, and over the text itself: length, links,
punctuation, neighbours, place, and how much of the page's prose the elements
around it hold.  An element that holds most of a page is a wrapper, whatever
it is called.  The regression is fitted on the driver to the blocks of
``TRAIN_PAGES`` pages made from templates; no corpus row is used.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import pieces

#: Pages made from templates that the classifier is fitted to.
TRAIN_PAGES = 300
#: Cost of a cut between two blocks of one parent that stand side by side.
SMOOTH = 0.6
#: Words without links that make a block prose.
PROSE = 12
#: Share of a page's prose from which an element is a wrapper: with the heading or article inside, or without.
WRAPS, WRAPS_ALONE = 0.5, 0.7

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROP = set("script style noscript template svg annotation annotation-xml head title iframe object textarea select option button datalist canvas audio video".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes, and the elements that it doesn't reach beyond.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# --- fixed values: whole words in the names of elements ---
_KINDS = {
    "nav": "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc skip skiplink sitemap",
    "head": "header masthead topbar branding logo sitename tagline",
    "foot": "footer colophon copyright legal imprint contentinfo",
    "side": "aside sidebar sidebars related widget widgets recommend recommended recommendations popular trending rail complementary teaser teasers",
    "notice": "cookie cookies consent notice alert gdpr newsletter subscribe subscription signup popup modal overlay paywall disclaimer toast dialog",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner adsense",
    "form": "form search searchbox searchform login signin",
    "comment": "comment comments commentlist disqus respond discussion discussions reply replies",
    "share": "share sharing social follow",
    "article": "article main content post entry story",
}
_STATE_BEFORE, _STATE_AFTER = set("has no is with without not".split()), set("open opened closed on off enabled disabled allowed visible".split())
_WORDS: dict[str, int] = {}
for _bit, _names in enumerate(_KINDS.values()):
    for _name in _names.split():
        _WORDS[_name] = _WORDS.get(_name, 0) | 1 << _bit
_BIT = {k: 1 << i for i, k in enumerate(_KINDS)}
_OWN_PARTS = _BIT["head"] | _BIT["foot"]
FEATURES = [*_KINDS, "clearly_inside", "outside", "links", "words", "sentence", "heading", "item", "prose_around", "prose_share", "inside_most", "before_prose", "after_prose", "repeated", "one"]


@functools.lru_cache(4096)
def _kinds(tag: str, names: str) -> int:
    """What an element's tag, classes, id and role speak of, as bits; names of states (has-sidebar, menu-open) don't count."""
    if tag in ("html", "body"):
        return 0
    found = _WORDS.get(tag, 0)
    for name in names.split():
        words = re.findall(r"[a-z]+|[0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower())
        if len(words) > 1 and (words[0] in _STATE_BEFORE or words[-1] in _STATE_AFTER):
            continue
        for w in words:
            found |= _WORDS.get(w, 0)
    return found


class Element:
    """``words``: of all text in it without links; ``own``: of its headings and articles, what makes it a wrapper."""

    __slots__ = ("tag", "kinds", "parent", "words", "heads", "mask", "article")

    def __init__(self, tag: str, kinds: int, parent: int):
        self.tag, self.kinds, self.parent = tag, kinds, parent
        self.words, self.heads, self.mask, self.article = 0.0, 0, 0, False


class Block:
    """A run of text of one element; ``apart``: steps in the element tree from the block before it."""

    __slots__ = ("text", "links", "at", "tag", "apart", "words")

    def __init__(self, text: str, links: int, at: int, tag: str, apart: int):
        self.text, self.links, self.at, self.tag, self.apart = text, links, at, tag, apart
        self.words = (text.count(" ") + 1) * (1 - min(links / len(text), 1))


class _Blocks(HTMLParser):
    """Cuts a page into blocks of text, each with its innermost block element. Each step costs the same however deep it is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", 0, -1)]
        self.stack: list[tuple[str, int]] = []  # tag, element (that of the block element around for inline ones)
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.dropped = self.depth = self.low = self.before = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.stack[-1][1] if self.stack else 0
            self.blocks.append(Block(text, self.linked, at, self.elements[at].tag, self.before + self.depth - 2 * self.low))
            self.before = self.low = self.depth
        self.parts, self.linked = [], 0

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.dropped -= tag in _DROP
        if tag in _BLOCK:
            self.depth -= 1
            self.low = min(self.low, self.depth)

    def _pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")
        if tag in _BLOCK:
            while self.dropped and self.open["head"]:  # a head that isn't closed
                self._pop()
            self.flush()
            if self.open["p"]:  # a block element ends an open paragraph
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == "p":
                        self._pop_to(k)
                        break
                    if self.stack[k][0] in _BLOCK:
                        break
            ends, within = _CLOSES.get(tag, ((), ()))
            if any(self.open[x] for x in ends):
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] in within:
                        break
                    if self.stack[k][0] in ends:
                        self._pop_to(k)
        if tag in _VOID:
            return
        at = self.stack[-1][1] if self.stack else 0
        if tag in _BLOCK:
            named = {k: v or "" for k, v in attrs}
            self.elements.append(Element(tag, _kinds(tag, " ".join(named.get(k, "") for k in ("class", "id", "role"))), at))
            at = len(self.elements) - 1
            self.depth += 1
        self.stack.append((tag, at))
        self.open[tag] += 1
        self.dropped += tag in _DROP

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing but in a void element

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop_to(k)
                return
            if tag not in _BLOCK and self.stack[k][0] in _BLOCK and tag not in _DROP:
                return  # inline elements don't end beyond their block

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


class Page:
    """A page's blocks, and its elements from the root on, parents before children."""

    def __init__(self, html: str):
        parser = _Blocks()
        parser.feed(html)
        parser.close()
        parser.flush()
        self.blocks, self.elements = parser.blocks, parser.elements
        self._understand()

    def _understand(self) -> None:
        every, comment = self.elements, _BIT["comment"]
        for b in self.blocks:
            every[b.at].words += b.words
        titled = set()  # of the page's first heading the innermost element
        for b in self.blocks:
            if b.tag == "h1":
                titled.add(b.at)
                break
        for i, e in enumerate(every):
            e.heads = (i in titled) + (e.tag in ("article", "main") and not e.kinds & comment)
        for e in reversed(every[1:]):
            every[e.parent].words += e.words
            every[e.parent].heads += e.heads
        total, heads = every[0].words or 1.0, every[0].heads
        for e in every[1:]:
            up = every[e.parent]
            share = e.words / total
            wraps = (share >= WRAPS and e.heads > 0 and e.heads >= heads / 2) or (share >= WRAPS_ALONE and e.heads == heads and not e.kinds & comment)
            own = e.kinds & _BIT["article"] if wraps else e.kinds
            if up.article and e.tag in ("header", "footer"):  # the article's own
                own &= ~_OWN_PARTS
            e.mask = up.mask | own
            e.article = up.article or e.tag == "article"
        # the innermost element with half of the prose
        self.most = 0
        for i, e in enumerate(every):
            if e.words >= 0.5 * total and e.parent in (-1, self.most):
                self.most = i


def blocks(html: str) -> list[Block]:
    return Page(html).blocks


def features(page: Page) -> np.ndarray:
    found, every = page.blocks, page.elements
    inside, within = [False] * len(every), [False] * len(every)
    for i, e in enumerate(every[1:], 1):
        inside[i] = inside[e.parent] or (e.tag in ("article", "main") and not e.kinds & _BIT["comment"])
        within[i] = within[e.parent] or i == page.most
    within = [True] * len(every) if page.most == 0 else within
    some = any(inside[b.at] for b in found)
    total = every[0].words or 1.0
    prose = [i for i, b in enumerate(found) if b.words >= PROSE]
    first, last = (prose[0], prose[-1]) if prose else (0, len(found))
    often = Counter(b.text for b in found)
    size = [min(math.log1p(b.words), 5) / 5 for b in found]
    rows = []
    for i, b in enumerate(found):
        e = every[b.at]
        holder = every[e.parent] if e.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "pre", "blockquote") and e.parent > 0 else e
        around = [size[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(found)]
        rows.append([
            *(float(bool(e.mask & bit)) for bit in _BIT.values()), float(inside[b.at] and not e.mask & ~_BIT["article"]), float(some and not inside[b.at]), min(b.links / len(b.text), 1.0), min(math.log1p(b.text.count(" ") + 1), 5) / 5, float(b.text[-1] in ".!?\"'»”…:"),
            float(b.tag in ("h1", "h2", "h3", "h4")), float(b.tag in ("li", "dd", "td", "th") and b.links < 0.5 * len(b.text)), sum(around) / max(len(around), 1), min(holder.words / total, 1.0), float(within[b.at]), float(i < first), float(i > last), float(often[b.text] > 1), 1.0,
        ])
    return np.array(rows).reshape(len(rows), len(FEATURES))


def training_pages(count: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages made from templates, with the texts of their article blocks.

    A third of the longer articles lie in elements whose names say nothing, wrappers
    bear misleading names, and part of the boilerplate has no name either.
    """
    r = random.Random(seed)
    number = iter(range(1, 10**9))
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bcdfghlmnprst") for i in range(r.randint(2, 9)))

    def prose(low: int, high: int) -> str:
        return " ".join([f"{word().capitalize()}{next(number)}", *(word() for _ in range(r.randint(low, high)))]) + r.choice([".", ".", ".", "", "?"])

    def block(tag: str, name: str, inner: str) -> str:
        attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="x-{name} y"']) if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def maybe(name: str) -> str:
        return name if r.random() < 0.75 else r.choice(["", "row", "box1", "u-pad"])

    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{prose(0, 3)}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>"
    row = lambda: r.choice([" | ", " ", "<br>"]).join(f'<a href="/{word()}">{prose(0, 1)}</a>' for _ in range(r.randint(2, 7)))
    para = lambda: f"<p>{prose(3, 40)}</p>"
    out = []
    for _ in range(count):
        good: set[str] = set()

        def own(low: int, high: int, good=good) -> str:
            t = prose(low, high)
            good.add(" ".join(t.split()))
            return t

        bits = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{own(2, 10)}</{h}>"] + [r.choice([lambda: f"<p>{own(0, 90)}</p>", lambda: f"<p>{own(0, 2)}</p>", lambda: f"<p>{own(20, 120)}</p>", lambda: f"<p>{own(20, 120)}</p>", lambda: f"<h2>{own(1, 6)}</h2>", lambda: f"<blockquote>{own(5, 30)}</blockquote>", lambda: f"<ul><li>{own(2, 12)}</li><li>{own(2, 12)}</li></ul>", lambda: f"<table><tr><td>{own(1, 4)}</td><td>{own(1, 4)}</td></tr></table>"])() for _ in range(r.choice([0, 1, r.randint(1, 14), r.randint(1, 14), r.randint(1, 14)]))]
        junk = {
            "ad": lambda: block(r.choice(["div", "aside"]), r.choice(["ad", "ads", "advert", "sponsored", "promo-box"]), r.choice([prose(3, 25), para()])),
            "share": lambda: block("div", maybe(r.choice(["share", "social-links"])), r.choice([links(), prose(0, 3)])),
            "notice": lambda: block("div", r.choice(["cookie-notice", "newsletter", "consent", "alert", "gdpr"]), para()),
            "form": lambda: f"<form>{prose(1, 6)}<label>{prose(1, 3)}</label></form>",
            "side": lambda: r.choice([lambda: block(r.choice(["aside", "div"]), r.choice(["sidebar", "related", "widget", "popular"]), para()), lambda: block("div", maybe("related"), f"<h3>{prose(0, 3)}</h3>{links()}")])(),
            "comment": lambda: block(r.choice(["section", "div"]), r.choice(["comments", "comment-list", "discussion"]), f"<h3>{prose(1, 3)}</h3>" + "".join(block(r.choice(["div", "article", "li"]), "comment", r.choice([para(), para() + para()])) for _ in range(r.randint(1, 6)))),
        }
        for kind in r.sample(sorted(junk), r.randint(0, 2)):
            bits.insert(r.randint(1, len(bits)), junk[kind]())
        plain = ["", "", "information", "platform", "report-text", "x9f", "layout", "wide", "region-2", "has-sidebar", "no-sidebar", "comments-open", "menu-open", "stock"]
        body = r.choice([
            lambda x: f"<article>{x}</article>", lambda x: f"<main>{x}</main>", lambda x: block("div", r.choice(["content", "post", "entry", "article-body", "story"]), x), lambda x: f"<main><article>{x}</article></main>",
            lambda x: block("div", r.choice(plain), x), lambda x: block("section", r.choice(plain), x), lambda x: block("div", r.choice(plain), block("div", r.choice(plain), x)),
        ][: 7 if len(bits) > 5 else 4])("".join(bits))
        before = [r.choice([lambda: f"<nav>{links()}</nav>", lambda: block("div", maybe("menu"), links()), lambda: block("div", maybe("menu"), row()), lambda: f"<table><tr><td>{row()}</td></tr></table>"])()]
        if r.random() < 0.6:
            before.insert(0, r.choice([lambda: f"<header>{prose(1, 8)}</header>", lambda: block("div", maybe(r.choice(["header", "masthead"])), prose(0, 4))])())
        around = [junk[k]() for k in r.sample(sorted(junk), r.randint(0, 4))]
        cut = r.randint(0, len(around))
        foot = r.choice([lambda: f"<footer>&copy; {prose(2, 20)}</footer>", lambda: block("div", "footer", para()), lambda: block("div", "", f"&copy; {prose(0, 3)}")])()
        inner = "".join(around[:cut]) + body + "".join(around[cut:])
        if r.random() < 0.3:
            inner = block("div", r.choice([*plain, "sidebar-layout", "page comments"]), inner)
        whole = "".join(before) + inner + foot
        if r.random() < 0.3:
            whole = block("div", r.choice(["container menu-open", "page", "wrapper", "site has-sidebar"]), whole)
        out.append((f"<html><head><title>{prose(1, 5)}</title></head><body>{whole}</body></html>", good))
    return out


@functools.cache
def fitted() -> tuple[float, ...]:
    """The classifier's weights, by ``FEATURES``."""
    xs, ys = [], []
    for html, good in training_pages():
        page = Page(html)
        xs.append(features(page))
        ys += [float(b.text in good) for b in page.blocks]
    x, y = np.vstack(xs), np.array(ys)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method, with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.3 * w)
    return tuple(w.tolist())


def minimum_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: a positive gain speaks for it."""
    n = len(gain)
    s, t = n, n + 1
    to, cap, at = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, ab: float, ba: float) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(ab)
        at[b].append(len(to))
        to.append(a)
        cap.append(ba)

    for i, g in enumerate(gain):
        edge(s, i, g, 0.0) if g > 0 else edge(i, t, -g, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt, path, u = [0] * (n + 2), [], s
        while True:  # blocking flow, without recursion
            if u == t:
                low = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= low
                    cap[e ^ 1] += low
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                u, path = to[path[k] ^ 1], path[:k]
            while nxt[u] < len(at[u]):
                e = at[u][nxt[u]]
                if cap[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(at[u]):
                path.append(at[u][nxt[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -2
                u = to[path.pop() ^ 1]


def _ties(page: Page) -> list[tuple[int, int, float]]:
    ties, last = [], {}
    for i, b in enumerate(page.blocks):
        parent = page.elements[b.at].parent
        if i:
            ties.append((i - 1, i, SMOOTH / max(1, b.apart - 1)))
        if parent in last and last[parent] != i - 1:
            ties.append((last[parent], i, SMOOTH / 2))
        last[parent] = i
    return ties


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The article of a page: its blocks in order, joined by spaces; "" for none."""
    page = Page(html or "")
    if not page.blocks:
        return ""
    gain = features(page) @ np.array(weights or fitted())
    stays = minimum_cut(gain.tolist(), _ties(page))
    return " ".join(b.text for b, stay in zip(page.blocks, stays) if stay)


def extract_text(pages: DataFrame, html_col: str = "html", text_name: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the article's text as ``text_name``.

    A null or empty page, and one without an article, has the empty text.
    Each row stands for itself, so repeated rows and null ids change nothing.
    """
    from pyspark.sql.types import StructType

    weights, at = fitted(), pages.columns.index(html_col)
    fields = [f for f in pages.schema.fields if f.name not in (html_col, text_name)]
    rest = [i for i, f in enumerate(pages.schema.fields) if f.name not in (html_col, text_name)]
    schema = StructType(list(fields)).add(text_name, "string")

    def run(batches):
        for b in (piece for batch in batches for piece in pieces(batch, at)):
            texts = pa.array([main_text(h, weights) for h in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), texts], names=[*(f.name for f in fields), text_name])

    return pages.mapInArrow(run, schema)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
