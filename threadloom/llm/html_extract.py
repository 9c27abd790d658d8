"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements. Each element has features: its tag and attribute words, those of its
ancestors, depth, subtree density, share of link text, and how it compares with its siblings. Boosted trees
give each element the log odds of belonging to the article. Decoding is hierarchical: for each element the
best of keeping its whole subtree, dropping it, or deciding child by child is taken, so that no kept element
has a dropped ancestor's verdict against it.

No table labels nodes, so the trees are fitted on pages made for that: the text blocks of at most
``sample`` given pages, those of least id hash, are laid out anew by ``layout`` with known roles. The sample
bounds what reaches the driver; every page is extracted.

Scripts, styles, comments and the head never hold text. Character references are decoded. Blocks are joined by
one space, as is white space inside a block. A null or empty page has empty text; broken markup is read as
far as it goes. Repeated rows are extracted each. Without sample pages the layouts hold placeholder words.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import source

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|([^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "canvas", "object", "xmp"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr del ins".split())
#: Elements that an opening tag closes, and where the search for them stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH_ENDS = set(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Attribute words by role; the trees learn what each group means.
GROUPS = {
    "main": "article body content entry main post story text page blog news hentry prose read single topic",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumb crumbs toc tabs pagination pager skip topbar toolbar",
    "head": "header head masthead logo brand branding",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside rail widget widgets related recommended recommend more popular trending tags tagcloud archive archives also recent",
    "advert": "ad ads advert advertisement adverts banner promo promotion sponsor sponsored sponsoring advertorial affiliate outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay privacy disclaimer paywall warning toast message",
    "form": "form search login signup subscribe subscription newsletter contact register input field survey poll",
    "comment": "comment comments reply replies respond disqus discussion feedback review reviews commentlist responses",
    "share": "share sharing social follow twitter facebook buttons meta byline author date rating print",
}
GROUP_OF = {word: i for i, words in enumerate(GROUPS.values()) for word in words.split()}
TAGS = "article main section div p h1 h2 h3 ul li nav header footer aside form table td a blockquote pre figure button body".split()
TAG_OF = {t: i for i, t in enumerate(TAGS)}
N_GROUPS, N_TAGS = len(GROUPS), len(TAGS)


class Node:
    __slots__ = ("tag", "groups", "parent", "children", "parts", "depth", "size", "links", "count", "start")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.groups = 0
        if attributes:
            for values in ATTRIBUTE.findall(attributes):
                for word in WORDS.findall("".join(values).lower()):
                    place = GROUP_OF.get(word)
                    if place is not None:
                        self.groups |= 1 << place


def parse(page: str) -> list[Node]:
    """Block elements of a page in document order; ``parts`` holds texts and child blocks in order."""
    root = Node("body", "", None)
    nodes, stack = [root], [(root.tag, root)]
    # where each name, and where any block, stands in the stack: no tag searches it
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    position, end, links, head_ends = 0, len(page), 0, True

    def put(name: str, node: Node) -> None:
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append((name, node))

    def cut(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            if name not in INLINE:
                blocks.pop()

    def top(names) -> int:
        return max((places[name][-1] for name in names if places.get(name)), default=0)

    while position < end:
        match = TOKEN.match(page, position)
        if not match:
            # an unclosed tag: the rest holds no text
            break
        position = match.end()
        closing, name, attributes, text = match.groups()
        if text is not None:
            stack[-1][1].parts.append((html.unescape(text), links > 0))
            continue
        if name is None:
            continue
        tag = name.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in RAW or tag == "head":
            if attributes.rstrip().endswith("/"):
                continue
            if tag == "head" and not head_ends:
                continue
            stop = re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.I).search(page, position)
            if tag == "head" and not stop:
                head_ends = False
                continue
            position = stop.end() if stop else end
            continue
        if tag in ("html", "body"):
            continue
        node = stack[-1][1]
        if tag in VOID:
            node.parts.append((" ", False))
            continue
        if tag == "a":
            links += 1
        if tag in INLINE:
            if not attributes or tag == "a" or not ATTRIBUTE.search(attributes):
                put(tag, node)
                continue
        if tag in PARAGRAPH_ENDS and blocks and stack[blocks[-1]][0] == "p":
            cut(blocks[-1])
        if tag in CLOSES:
            closes, stops = CLOSES[tag]
            depth = top(closes)
            if depth > top(stops):
                cut(depth)
        parent = stack[-1][1]
        child = Node(tag, attributes, parent)
        parent.children.append(child)
        parent.parts.append(child)
        nodes.append(child)
        put(tag, child)
        if attributes.rstrip().endswith("/") and tag not in PARAGRAPH_ENDS:
            cut(len(stack) - 1)
    return nodes


def measures(nodes: list[Node]) -> np.ndarray:
    """One row of features per element."""
    for node in reversed(nodes):
        node.size = node.links = 0
        node.count = 1
        for part in node.parts:
            if isinstance(part, tuple):
                n = len(part[0].strip())
                node.size += n
                node.links += n if part[1] else 0
            else:
                node.size += part.size
                node.links += part.links
                node.count += part.count
    whole = max(1, nodes[0].size)
    above: dict[int, tuple[int, int]] = {}
    rows = np.zeros((len(nodes), 2 * N_GROUPS + 2 * N_TAGS + 14), np.float32)
    order: dict[int, int] = {}
    alike: dict[int, Counter] = {}  # tags of the children of each parent
    for i, node in enumerate(nodes):
        row, parent = rows[i], node.parent
        groups, tags = above[id(parent)] if parent is not None else (0, 0)
        own_tag = TAG_OF.get(node.tag)
        above[id(node)] = (groups | node.groups, tags | (1 << own_tag if own_tag is not None else 0))
        for k in range(N_GROUPS):
            row[k] = node.groups >> k & 1
            row[N_GROUPS + k] = groups >> k & 1
        at = 2 * N_GROUPS
        if own_tag is not None:
            row[at + own_tag] = 1
        for k in range(N_TAGS):
            row[at + N_TAGS + k] = tags >> k & 1
        at += 2 * N_TAGS
        siblings = parent.children if parent is not None else [node]
        if id(parent) not in alike:
            alike[id(parent)] = Counter(s.tag for s in siblings)
        place = order.get(id(parent), 0)
        order[id(parent)] = place + 1
        around = parent.size if parent is not None else node.size
        row[at:] = (
            node.depth,
            np.log1p(node.size),
            node.links / max(1, node.size),
            np.log1p(node.size / node.count),
            node.size / whole,
            np.log1p(node.count),
            np.log1p(len(node.children)),
            place / max(1, len(siblings)),
            np.log1p(len(siblings)),
            node.size / max(1, around),
            np.log1p(around / max(1, len(siblings))),
            alike[id(parent)][node.tag] / max(1, len(siblings)),
            sum(c.tag == "p" for c in node.children),
            parent.links / max(1, parent.size) if parent is not None else 0,
        )
    return rows


# --------------------------------------------------------------------------- boosted trees


class Trees:
    """Gradient-boosted trees for a yes or no label: equal-frequency bins, Newton steps, fixed depth."""

    def __init__(self, rounds: int = 100, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], shares)) for j in range(x.shape[1])]
        binned = self._binned(x)
        n_bins = self.bins
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        self.feature, self.cut, self.value = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                n_leaves = 1 << level
                best = np.full(n_leaves, -np.inf)
                feature, cut = np.zeros(n_leaves, np.int64), np.full(n_leaves, n_bins)
                for j in range(x.shape[1]):
                    if not len(self.cuts[j]):
                        continue
                    cell = leaf * n_bins + binned[:, j]
                    gs = np.bincount(cell, g, n_leaves * n_bins).reshape(n_leaves, n_bins).cumsum(1)
                    hs = np.bincount(cell, h, n_leaves * n_bins).reshape(n_leaves, n_bins).cumsum(1)
                    g_all, h_all = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (g_all - gs) ** 2 / (h_all - hs + self.ridge)
                    at = gain.argmax(1)
                    value = gain[np.arange(n_leaves), at]
                    better = value > best + 1e-9
                    best[better], feature[better], cut[better] = value[better], j, at[better]
                features.append(feature)
                cuts.append(cut)
                leaf = leaf * 2 + (binned[np.arange(len(y)), feature[leaf]] > cut[leaf])
            g_leaf = np.bincount(leaf, g, 1 << self.depth)
            h_leaf = np.bincount(leaf, h, 1 << self.depth)
            value = -self.rate * g_leaf / (h_leaf + self.ridge)
            margin += value[leaf]
            self.feature.append(features)
            self.cut.append(cuts)
            self.value.append(value)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.searchsorted(cuts, x[:, j], side="left")
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for features, cuts, value in zip(self.feature, self.cut, self.value):
            leaf = np.zeros(len(x), np.int64)
            for feature, cut in zip(features, cuts):
                leaf = leaf * 2 + (binned[rows, feature[leaf]] > cut[leaf])
            total += value[leaf]
        return total


# --------------------------------------------------------------------------- labelled layouts

MAIN = [
    ("article", ""), ("article", ""), ("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", ""), ("main", ""), ("main", "main"), ("div", "content"), ("div", "article-body"),
    ("div", "post-content"), ("section", "entry-content"), ("div", "story"), ("div", "main-text"), ("div", "single"),
    ("td", "page-text"), ("div", ""), ("section", ""), ("div", "prose"), ("div", "news-body"),
]
LINKS = [
    ("nav", ""), ("nav", ""), ("nav", ""), ("nav", ""), ("nav", "menu"), ("div", "navbar"), ("ul", "menu"), ("div", "navigation"), ("ul", "breadcrumbs"),
    ("div", "pagination"), ("ul", "related"), ("aside", "related"), ("div", "tags"), ("div", "popular"), ("div", "toc"),
    ("div", "sidebar"), ("aside", "sidebar"), ("div", "social"), ("ul", ""),
]
PROSE = [
    ("header", ""), ("header", ""), ("header", ""), ("footer", ""), ("footer", ""), ("footer", ""), ("footer", ""), ("aside", ""),
    ("aside", ""), ("form", ""), ("div", "ad"), ("div", "ad"), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("footer", "footer"),
    ("div", "footer"), ("div", "copyright"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"),
    ("div", "ad"), ("div", "ads"), ("aside", "advert"), ("div", "banner"), ("div", "promo"), ("section", "sponsored"),
    ("div", "cookie-notice"), ("div", "consent"), ("div", "notice"), ("section", "privacy-notice"), ("div", "popup"),
    ("div", "alert"), ("form", "search"), ("form", "newsletter"), ("div", "subscribe"), ("div", "login"),
    ("section", "comments"), ("div", "comment"), ("div", "comment-list"), ("ol", "comments"), ("div", "replies"),
    ("div", "disqus"), ("section", "reviews"), ("div", "share"), ("div", "byline"), ("div", "more"),
]


def layout(rng: random.Random, texts: list[str]) -> str:
    """A page whose elements are marked ``data-keep`` 1 (article), 0 (other) or nothing (holds both)."""

    def some(least: int, most: int) -> list[str]:
        return [html.escape(rng.choice(texts)) for _ in range(rng.randint(least, most))]

    def tag(name: str, word: str, keep: str, inner: str) -> str:
        kind = f' {rng.choice(("class", "class", "id"))}="{word}"' if word else ""
        mark = f' data-keep="{keep}"' if keep else ""
        return f"<{name}{kind}{mark}>{inner}</{name}>"

    def other() -> str:
        if rng.random() < 0.4:
            name, word = rng.choice(LINKS)
            items = ""
            for text in some(3, 9):
                link = f'<a href="/{rng.randint(1, 99)}">{text[: rng.randint(4, 40)]}</a>'
                items += tag("li", "", "0", link) if rng.random() < 0.7 else link + " "
            inner = items if name == "ul" or "<li" not in items else tag("ul", "", "0", items)
            return tag(name, word, "0", inner)
        name, word = rng.choice(PROSE)
        long = any(w in word for w in ("comment", "repl", "disqus", "review"))
        inner = ""
        for text in some(1, 6 if long else 2):
            text = text if long or rng.random() < 0.3 else text[: rng.randint(10, 200)]
            if "form" == name or rng.random() < 0.15:
                inner += tag("label", "", "", text[:40]) + "<input>" + tag("button", "", "0", text[:12])
            else:
                inner += tag(rng.choice(("p", "p", "div", "li" if name == "ol" else "p")), "", "0", text) if rng.random() < 0.7 else text
        return tag(name, word, "0", inner)

    name, word = rng.choice(MAIN)
    blocks = [tag("h1", "", "1", rng.choice(texts)[:90])] if rng.random() < 0.8 else []
    for text in some(1, 12) if rng.random() < 0.7 else some(1, 2):
        text = text if rng.random() < 0.8 else text[: rng.randint(20, 200)]
        kind = rng.random()
        if kind < 0.75:
            blocks.append(tag("p", "", "1", text))
        elif kind < 0.82:
            blocks.append(tag("h2", "", "1", text[:60]))
        elif kind < 0.9:
            blocks.append(tag("ul", "", "1", "".join(tag("li", "", "1", t[:120]) for t in some(2, 5))))
        elif kind < 0.95:
            blocks.append(tag("blockquote", "", "1", tag("p", "", "1", text)))
        else:
            blocks.append(tag("div", "", "1", text))
    mixed = rng.random() < 0.3
    if mixed:
        for _ in range(rng.randint(1, 2)):
            blocks.insert(rng.randint(1, len(blocks)), other())
    article = tag(name, word, "" if mixed else "1", "".join(blocks))
    if name == "td":
        article = f"<table><tr>{article}</tr></table>"
    before, after = "".join(other() for _ in range(rng.randint(1, 4))), "".join(other() for _ in range(rng.randint(1, 4)))
    body = before + article + after
    for _ in range(rng.randint(0, 2)):
        body = tag(rng.choice(("div", "div", "section")), rng.choice(("", "wrapper", "container", "page", "site", "row")), "", body)
    return f"<html><body>{body}</body></html>"


KEEP = re.compile(r'data-keep="([01])"')


def training_rows(texts: list[str], pages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = layout(rng, texts)
        # every marked element is a block, so marks and elements of the page are in the same order
        labels = [
            int(found.group(1)) if (found := KEEP.search(m.group(3))) else -1
            for m in TOKEN.finditer(page)
            if m.group(2) and not m.group(1) and m.group(2) not in INLINE | VOID | {"html", "body"}
        ]
        nodes = parse(page)
        if len(nodes) != len(labels) + 1:
            continue
        x, y = measures(nodes)[1:], np.array(labels)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


def block_texts(page: str) -> list[str]:
    """Texts of the innermost blocks of a page, to fill layouts with."""
    found = []
    for node in parse(page):
        text = " ".join("".join(p[0] for p in node.parts if isinstance(p, tuple)).split())
        if text:
            found.append(text)
    return found


def fit(pages: DataFrame, sample: int = 200, layouts: int = 600) -> Trees:
    """Trees fitted on ``layouts`` pages that are filled with the blocks of at most ``sample`` pages."""
    rows = pages.select("page_id", "html").filter("html IS NOT NULL")
    # ids first: each task sends the driver numbers, and pages only of the chosen ids
    ids = rows.select("page_id").filter("page_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    found = rows.join(F.broadcast(ids), "page_id").select("html")
    chosen = found.orderBy(F.xxhash64("html"), "html").limit(sample).collect()
    texts = [t[:2000] for row in chosen for t in block_texts(row["html"])]
    return Trees().fit(*training_rows(texts or ["text of a page"], layouts))


# --------------------------------------------------------------------------- decoding


def kept_elements(nodes: list[Node], margins: np.ndarray, mixing: float = 0.5) -> list[bool]:
    """The best consistent choice: a subtree is kept, dropped, or decided child by child at a cost."""
    place = {id(node): i for i, node in enumerate(nodes)}
    total = np.clip(margins, -6, 6)
    own = total.copy()
    best = np.zeros(len(nodes))
    choice = np.zeros(len(nodes), np.int8)  # 1 keep all, -1 drop all, 0 by child
    for i in range(len(nodes) - 1, -1, -1):
        children = [place[id(c)] for c in nodes[i].children]
        total[i] = own[i] + sum(total[c] for c in children)
        inside = sum(best[c] for c in children) + abs(own[i]) - mixing if children else -np.inf
        choice[i] = 1 if total[i] > 0 else -1
        best[i] = abs(total[i])
        if inside > best[i]:
            choice[i], best[i] = 0, inside
    kept = [False] * len(nodes)
    state = [0] * len(nodes)
    for i, node in enumerate(nodes):
        above = state[place[id(node.parent)]] if node.parent is not None else 0
        state[i] = above or int(choice[i])
        kept[i] = state[i] > 0 or (state[i] == 0 and own[i] > 0)
    return kept


def render(nodes: list[Node], kept: list[bool]) -> str:
    place = {id(node): i for i, node in enumerate(nodes)}
    out: list[str] = []
    stack: list = [iter([nodes[0]])]
    inside = [None]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            inside.pop()
            out.append(" ")
        elif isinstance(part, tuple):
            if kept[inside[-1]]:
                out.append(part[0])
        else:
            if part.tag not in INLINE:
                out.append(" ")
            stack.append(iter(part.parts))
            inside.append(place[id(part)])
            if part.tag in INLINE:
                stack[-1] = iter([*part.parts])
    return " ".join("".join(out).split())


def extracted(pages: DataFrame, trees: Trees, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text``; an input column of that name is replaced."""
    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            values = list(series)
            for low in range(0, len(values), 100):
                trees_of = [parse(v or "") for v in values[low : low + 100]]
                rows = [measures(nodes) for nodes in trees_of]
                margins = trees.margins(np.concatenate(rows))
                start = 0
                for nodes in trees_of:
                    out.append(render(nodes, kept_elements(nodes, margins[start : start + len(nodes)])))
                    start += len(nodes)
            yield pd.Series(out, dtype="object")

    return pages.withColumn("text", main_text(F.col(html_column)))


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """Article text of every page."""
    pages = source(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = extracted(pages, fit(pages))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
