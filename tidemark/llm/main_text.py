"""Main text of pages by a tree-structured graphical model.

A page's elements, and its runs of text as leaves, are the nodes of a tree; each is content (1) or not (0). A node has a
potential that is linear in its features (its name, words of its class, id and role, the same of what stands around it, sizes, shares of link text), and a pair of parent and
child one of its own for each group of elements. Messages pass from the leaves to the root and back (sum-product, all
pages of a chunk a level at a time); the product of what meets at a node is its exact marginal. Runs whose marginal
reaches one half are the text of the page.

The potentials are fitted by gradient ascent on the likelihood of labelled pages: a bounded sample of the pages whose
markup says where their article is, and pages laid out anew from the blocks of these (`layouts`), with other containers
and with menus, notices, adverts, forms, sidebars and comments around and within the article. What an element is called is a feature
like others, so the model also reads pages that have no article element, by what their containers are called and look like.

Defined cases: null and empty html, and pages without text, give an empty text; white space is what Python's split() takes as
such; br is white space within its block; scripts, styles, templates, frames, titles, selections and text fields are never text; tags that never end
take the rest of the page with them, as in a browser; a table without labelled pages is read by a model of
built-in sentences laid out; repeated rows and null ids are rows like others; other columns are ignored."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, table
from .markup import CLOSE, OPEN, TEXT, attributes, decoded, tokens

#: Most labelled pages that the model is fitted on, and characters of each at most; pages laid out anew from each.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 200, 40_000, 3
#: Places of the features, steps and rate of the fit, and its pull to zero.
SIZE, STEPS, RATE, DECAY = 1 << 13, 100, 0.1, 1e-4
#: Most features of what stands around a node.
WITHIN = 64
#: Characters of pages in one chunk.
CHUNK = 1 << 22

# Elements of HTML by what they do.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head select datalist svg math canvas object audio video map".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "option": ("select",)}
#: Elements alike in how their state hangs on their parent's; others are by themselves.
GROUPS = ("run", "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption figure dd dt dl", "li ul ol menu", "div section center main article td tr tbody table body html", "nav header footer aside form fieldset button label dialog")

CONTAINERS = ("content", "main", "article", "post", "entry", "story", "body", "text", "page-content", "main-content", "post-body", "entry-content", "article-body", "markdown", "prose")
AROUND = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "tabs", "toc", "pagination", "skip-links"),
    "header": ("header", "masthead", "site-header", "top-bar", "banner", "logo", "branding", "page-header"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "credits", "legal", "colophon"),
    "sidebar": ("sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "archive", "tags", "side-bar", "rail", "more-stories"),
    "notice": ("cookie", "notice", "consent", "alert", "gdpr", "popup", "modal", "message", "cookie-banner", "newsletter", "paywall", "overlay", "subscribe"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsbox", "banner-ad", "affiliate"),
    "form": ("form", "login", "search", "signup", "contact-form", "search-box", "subscribe-form", "register"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus", "user-comments", "reader-comments"),
    "share": ("share", "social", "sharing", "follow", "buttons", "social-links"),
}
SENTENCES = ("The river rises in the hills north of the town and runs south for forty miles.", "Most of the houses were built after the railway came.", "In winter the road is closed, and people go by boat.", "A school was opened there in 1904, with two rooms and one teacher.", "Nobody knows who painted the wall, though many have asked.", "Prices fell again last week.")

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GROUP = {name: i for i, names in enumerate(GROUPS) for name in names.split()}


def place(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SIZE


def called(name: str, marks: str) -> list[str]:
    """What an element is by its name and marks."""
    out = ["name " + name]
    for word in dict.fromkeys(w.lower() for w in _WORD.findall(marks)):
        out += ["called " + word, "begins " + word[:4], "ends " + word[-4:]]
    return out


class Kinds:
    """Kinds of nodes: name, marks and what they stand within, each with its group and the places of its features.

    What a node stands within are the features of the elements above it, WITHIN at most, the outer ones first."""

    def __init__(self):
        self.known: dict[tuple, tuple[int, int]] = {}
        self.sets: list[frozenset] = [frozenset()]
        self.set_ids: dict[frozenset, int] = {self.sets[0]: 0}
        self.groups: list[int] = []
        self.features: list[list[int]] = []
        self.marks: list[str] = []

    def of(self, name: str, marks: str, within: int) -> tuple[int, int]:
        """The kind of a node, and what its children stand within."""
        found = self.known.get((name, marks, within))
        if found is None:
            own = called(name, marks)
            around = self.sets[within]
            inner = around | {place("in " + x) for x in own} if name != "run" else around
            if len(inner) > WITHIN:
                inner = around
            if inner not in self.set_ids:
                self.set_ids[inner] = len(self.sets)
                self.sets.append(inner)
            found = self.known[name, marks, within] = len(self.groups), self.set_ids[inner]
            self.groups.append(_GROUP.get(name, len(GROUPS)))
            self.features.append([*dict.fromkeys(map(place, ["all", *own])), *sorted(around)])
            self.marks.append(marks)
        return found


class Tree:
    """The nodes of a page, parents before children: elements by kind (an index into a list of features), and runs of text."""

    def __init__(self, page: str, kinds: Kinds):
        self.parent, self.kind, self.inner, self.names, self.text, self.linked = [], [], [], [], {}, {}
        self.add(-1, "html", kinds)
        open_: list[tuple[str, int]] = []  # inline and block elements that are open, with their nodes
        where: dict[str, list[int]] = {}  # places in open_ by name
        node, links, hidden, parts, linked = 0, 0, 0, [], 0

        def end_run():
            nonlocal parts, linked
            if parts:
                if text := " ".join("".join(parts).split()):
                    self.text[len(self.parent)], self.linked[len(self.parent)] = text, linked
                    self.add(node, "run", kinds)
                parts, linked = [], 0

        def shut(at: int):
            """Closes the open elements from place at on."""
            nonlocal node, links, hidden
            for name, of in reversed(open_[at:]):
                where[name].pop()
                links -= name == "a"
                hidden -= name in HIDDEN
                if name not in INLINE:
                    end_run()
                    node = self.parent[of]
            del open_[at:]

        for kind, name, rest in tokens(page):
            if kind == TEXT:
                if not hidden:
                    text = decoded(rest)
                    parts.append(text)
                    linked += len(text) if links else 0
            elif kind == OPEN:
                if name in ENDS_P and where.get("p"):
                    shut(where["p"][-1])
                elif name in ENDS_ITSELF and where.get(name) and where[name][-1] > max((where[x][-1] for x in ENDS_ITSELF[name] if where.get(x)), default=-1):
                    shut(where[name][-1])
                elif name in ("dd", "dt") and where.get(other := "dt" if name == "dd" else "dd") and where[other][-1] > (where["dl"][-1] if where.get("dl") else -1):
                    shut(where[other][-1])
                elif name == "body" and where.get("head"):
                    shut(where["head"][0])
                elif name == "a" and where.get("a"):
                    shut(where["a"][-1])
                if name in ("br", "hr", "img", "input"):
                    parts.append(" ")
                if name in VOID or name == "html" or rest.endswith("/") and name in ("svg", "math"):
                    continue
                if name not in INLINE:
                    end_run()
                    node = self.add(node, name, kinds, self.marks(rest))
                where.setdefault(name, []).append(len(open_))
                open_.append((name, node))
                links += name == "a"
                hidden += name in HIDDEN
            elif kind == CLOSE and where.get(name):
                shut(where[name][-1])
        end_run()

    def add(self, parent: int, name: str, kinds: Kinds, marks: str = "") -> int:
        kind, inner = kinds.of(name, marks, self.inner[parent] if parent >= 0 else 0)
        self.parent.append(parent)
        self.names.append(name)
        self.kind.append(kind)
        self.inner.append(inner)
        return len(self.parent) - 1

    @staticmethod
    def marks(rest: str) -> str:
        """What an element is called: class, id and role, and whether it is hidden."""
        if not rest:
            return ""
        found = attributes(rest)
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        return " ".join(x[:200] for x in (found.get("class"), found.get("id"), found.get("role"), found.get("itemprop"), "hidden" * hidden) if x)


class Forest:
    """Trees of several pages as arrays: parents, depths, groups of elements and features of all nodes."""

    def __init__(self, trees: list[Tree], kinds: Kinds):
        sizes = [len(t.parent) for t in trees]
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.array(t.parent) + b * (np.array(t.parent) >= 0) for t, b in zip(trees, self.begin)] or [np.zeros(0, np.int64)])
        n = len(self.parent)
        self.texts = [(b + i, x) for t, b in zip(trees, self.begin) for i, x in t.text.items()]
        self.leaf = np.array([i for i, _ in self.texts], np.int64)
        size, linked = np.zeros(n), np.zeros(n)
        size[self.leaf] = [len(x) for _, x in self.texts]
        linked[self.leaf] = [x for t in trees for x in t.linked.values()]
        stops = np.zeros(n)
        stops[self.leaf] = [x[-1] in ".!?:;\"'”»)。" for _, x in self.texts]
        self.depth = np.zeros(n, np.int64)
        self.levels = self.by_depth(trees)
        self.families = [self.family(level) for level in self.levels]
        for level, (parents, starts) in zip(self.levels[:0:-1], self.families[:0:-1]):  # sizes of subtrees
            size[parents] += np.add.reduceat(size[level], starts)
            linked[parents] += np.add.reduceat(linked[level], starts)
        page = np.repeat(np.arange(len(trees)), sizes)
        share = size / np.maximum(1, size[self.begin[:-1]][page]) if n else size
        is_leaf = np.zeros(n, np.int64)
        is_leaf[self.leaf] = 1
        steps = [
            np.minimum(12, np.log2(1 + size).astype(np.int64)),
            np.minimum(4, (4 * linked / np.maximum(1, size)).astype(np.int64)),
            (share * 4).astype(np.int64),
            stops.astype(np.int64),
        ]
        group, ends = np.array(kinds.groups, np.int64), np.concatenate([[0], np.cumsum([len(f) for f in kinds.features])]).astype(np.int64)
        parts = np.array([x for f in kinds.features for x in f], np.int64)
        kind = np.concatenate([np.array(t.kind) for t in trees] or [np.zeros(0, np.int64)])
        self.group = group[kind] if n else kind
        found, bounds = gathered(parts, ends, kind) if n else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        more = [np.array([[place(f"{i} {leaf} {v}") for v in range(16)] for leaf in (0, 1)])[is_leaf, s] for i, s in enumerate(steps)]
        self.node = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), np.tile(np.arange(n), len(more))])
        self.feature = np.concatenate([found, *more])

    def family(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parents of a level's nodes, and where the children of each begin; in the order of the page they stand together."""
        of = self.parent[level]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
        return of[starts], starts

    def by_depth(self, trees: list[Tree]) -> list[np.ndarray]:
        at = 0
        for t in trees:
            depth = [0] * len(t.parent)
            for i, p in enumerate(t.parent):
                if p >= 0:
                    depth[i] = depth[p] + 1
            self.depth[at : at + len(depth)] = depth
            at += len(depth)
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if len(order) else [order]


class Model:
    """Weights of the features for state 1, and of (group, parent's state, child's state)."""

    def __init__(self):
        self.own, self.pair = np.zeros(SIZE), np.zeros((len(GROUPS) + 1, 2, 2))

    def beliefs(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the nodes (n x 2), and joint ones of (parent, child) for each child (n x 2 x 2; roots: zeros)."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.node, self.own[forest.feature], minlength=n)
        up = np.zeros((n, 2))  # what each node tells its parent
        pair = self.pair[forest.group]
        below = own.copy()
        for level, (parents, starts) in zip(forest.levels[:0:-1], forest.families[:0:-1]):
            up[level] = np.logaddexp(pair[level, :, 0] + below[level, None, 0], pair[level, :, 1] + below[level, None, 1])
            below[parents] += np.add.reduceat(up[level], starts)
        joint, all_ = np.zeros((n, 2, 2)), below.copy()
        for level in forest.levels[1:]:
            rest = all_[forest.parent[level]] - up[level]  # of the parent, without this child
            both = rest[:, :, None] + pair[level] + below[level, None, :]
            all_[level] = np.logaddexp(both[:, 0], both[:, 1])
            both -= both.max((1, 2), keepdims=True)
            joint[level] = np.exp(both)
            joint[level] /= joint[level].sum((1, 2), keepdims=True)
        all_ -= all_.max(1, keepdims=True)
        single = np.exp(all_)
        return single / single.sum(1, keepdims=True), joint

    def slope(self, forest: Forest, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the likelihood of these states: observed less expected counts."""
        single, joint = self.beliefs(forest)
        own = np.bincount(forest.feature, (states - single[:, 1])[forest.node], minlength=SIZE)
        child = np.flatnonzero(forest.parent >= 0)
        group, n = forest.group[child], self.pair.size
        seen = np.bincount(4 * group + 2 * states[forest.parent[child]] + states[child], minlength=n)
        due = [np.bincount(group, joint[child, a, b], minlength=n // 4) for a in (0, 1) for b in (0, 1)]
        return own, seen.reshape(self.pair.shape) - np.stack(due, 1).reshape(self.pair.shape)

    def fit(self, forest: Forest, states: np.ndarray) -> None:
        """Ascends the likelihood, each weight by steps that its own past slopes scale (Adam)."""
        values, moments, pages = [self.own, self.pair], [[0.0, 0.0], [0.0, 0.0]], max(1, len(forest.begin) - 1)
        for step in range(1, STEPS + 1):
            for i, slope in enumerate(self.slope(forest, states)):
                slope = slope / pages - DECAY * values[i]
                m, v = moments[i]
                moments[i] = m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
                values[i] += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def labelled(page: str, kinds: Kinds) -> tuple[Tree, list[int]] | None:
    """The tree of a page whose markup says where the article is, and the states of its nodes."""
    tree = Tree(page, kinds)
    inside = [False] * len(tree.parent)
    for i, p in enumerate(tree.parent):
        name = tree.names[i]
        inside[i] = name == "article" or p >= 0 and inside[p] and name not in ("nav", "aside", "form", "footer", "button")
    content, size = [0] * len(inside), [0] * len(inside)
    for i in range(len(inside) - 1, -1, -1):
        if i in tree.text:
            size[i] += len(tree.text[i])
            content[i] += len(tree.text[i]) * inside[i]
        if tree.parent[i] >= 0:
            content[tree.parent[i]] += content[i]
            size[tree.parent[i]] += size[i]
    if "article" not in tree.names or not content[0]:
        return None
    return tree, [int(2 * c >= s) if s else int(inside[i]) for i, (c, s) in enumerate(zip(content, size))]


def layouts(blocks: list[str], others: list[str], seed: int) -> str:
    """A page with blocks as its article, and others around and within it; the article is marked by its content alone.

    Its container goes by many names; class="x-own" stands on what is content and is taken off by stated()."""
    draw = np.random.default_rng(seed)
    pick = lambda x: x[int(draw.integers(len(x)))]
    text = lambda: pick(others)
    short = lambda: " ".join(text().split()[: int(draw.integers(1, 5))])

    def named(name: str) -> str:
        word = pick(AROUND[name])
        return f' {pick(("class", "class", "id"))}="{word}"'

    def around(name: str) -> str:
        links = lambda n: "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(n))
        some, tag = int(draw.integers(1, 7)), pick(("div", "div", "section", "aside" if name in ("sidebar", "advert") else "div"))
        if name == "menu":
            return pick((f"<nav><ul>{links(some)}</ul></nav>", f"<div{named(name)}><ul>{links(some)}</ul></div>", f"<ul{named(name)}>{links(some)}</ul>"))
        if name == "header":
            inner = pick((f"<h1>{short()}</h1>", f"<div>{short()}</div><p>{text()}</p>", f"<p>{short()}</p>"))
            return pick((f"<header>{inner}</header>", f"<header{named(name)}>{inner}</header>", f"<div{named(name)}>{inner}</div>"))
        if name == "footer":
            inner = pick((f"<p>&copy; {short()}</p>", f"&copy; {text()}", f"<p>{text()}</p><p>{short()}</p>"))
            return pick((f"<footer>{inner}</footer>", f"<footer{named(name)}>{inner}</footer>", f"<div{named(name)}>{inner}</div>"))
        if name == "sidebar":
            inner = pick((f"<h3>{short()}</h3><ul>{links(some)}</ul>", f"<h3>{short()}</h3><p>{text()}</p>", f"<p>{text()}</p><p>{text()}</p>"))
            return pick((f"<aside>{inner}</aside>", f"<{tag}{named(name)}>{inner}</{tag}>"))
        if name == "comments":
            each = lambda: f'<{pick(("div", "li", "article", "p"))} class="{pick(("comment", "comment-body", "reply", "comment-item"))}">{pick((f"<p>{text()}</p>", text(), f"<b>{short()}</b> <p>{text()}</p>"))}'
            inner = f"<h3>{short()}</h3>" * int(draw.integers(2)) + "".join(re.sub(r"^<(\w+)(.*)$", r"<\1\2</\1>", each(), flags=re.S) for _ in range(some))
            return f"<{tag}{named(name)}>{inner}</{tag}>"
        if name == "form":
            inner = f"<label>{short()}</label><input type=text><button>{short()}</button>"
            return pick((f"<form>{inner}</form>", f"<form{named(name)}><p>{text()}</p>{inner}</form>", f"<div{named(name)}><p>{text()}</p><form>{inner}</form></div>"))
        inner = pick((text(), f"<p>{text()}</p>", f"<p>{text()}</p><p>{short()}</p>", f'<a href="/x">{text()}</a>', short(), f"<ul>{links(some)}</ul>"))
        if name == "notice" and draw.random() < 0.3:
            return f"<dialog{named(name)}>{inner}</dialog>" if draw.random() < 0.5 else f'<div role="{pick(("alert", "dialog"))}">{inner}</div>'
        return f"<{tag}{named(name)}>{inner}</{tag}>"

    def own(block: str, i: int) -> str:
        form = int(draw.integers(12))
        if i == 0 and form < 8:
            return f"<h{1 + form % 2} x-own>{block}</h{1 + form % 2}>"
        if form == 0 and len(block) > 60:
            half = len(block) // 3
            return f"<ul x-own><li>{block[:half]}</li><li>{block[half:]}</li></ul>"
        return {1: f"<div x-own>{block}</div>", 2: f"<blockquote x-own><p>{block}</p></blockquote>", 3: f"<h3 x-own>{' '.join(block.split()[:4])}</h3><p x-own>{block}</p>", 4: f'<p x-own>{block} <a href="/y">{block[:20]}</a>.</p>'}.get(form, f"<p x-own>{block}</p>")

    inner = [own(b, i) for i, b in enumerate(blocks)]
    for name in ("advert", "share", "sidebar", "notice", "comments", "form"):
        if draw.random() < 0.2:
            inner.insert(int(draw.integers(1, len(inner) + 1)) if name != "comments" else len(inner), around(name))
    word, whole = pick(CONTAINERS), "".join(inner)
    whole = pick((f"<article>{whole}</article>", f"<main>{whole}</main>", f"<main><article>{whole}</article></main>", f'<div class="{word}">{whole}</div>', f'<div id="{word}">{whole}</div>', f'<section class="{word}">{whole}</section>', f'<div role="main">{whole}</div>', f'<table><tr><td class="{word}">{whole}</td></tr></table>', f"<div><div>{whole}</div></div>"))
    before = [around(x) for x in ("notice", "header", "menu", "advert", "form", "sidebar", "share") if draw.random() < 0.4]
    after = [around(x) for x in ("comments", "sidebar", "advert", "share", "form", "notice", "menu", "footer") if draw.random() < 0.4]
    if draw.random() < 0.5:
        return f"<html><body>{''.join(before)}<div class='{pick(('wrapper', 'container', 'row', 'layout', 'page', 'site'))}'>{whole}{''.join(after)}</div></body></html>"
    return f"<html><body>{''.join(before)}{whole}{''.join(after)}</body></html>"


def stated(page: str, kinds: Kinds) -> tuple[Tree, list[int]]:
    """The tree and states of a page of layouts()."""
    own = Kinds()
    marked, tree = Tree(page.replace(" x-own>", ' class="x-own">'), own), Tree(page.replace(" x-own>", ">"), kinds)
    inside = [False] * len(tree.parent)
    content, size = [0] * len(inside), [0] * len(inside)
    for i, p in enumerate(tree.parent):
        inside[i] = own.marks[marked.kind[i]] == "x-own" or p >= 0 and inside[p]
    for i in range(len(inside) - 1, -1, -1):
        n = len(tree.text.get(i, ""))
        size[i], content[i] = size[i] + n, content[i] + n * inside[i]
        if tree.parent[i] >= 0:
            content[tree.parent[i]] += content[i]
            size[tree.parent[i]] += size[i]
    return tree, [int(2 * c >= s) if s else int(inside[i]) for i, (c, s) in enumerate(zip(content, size))]


def fitted(pages: list[str], copies: int = LAYOUTS) -> Model:
    """A model of labelled pages, and of pages laid out from their blocks; pages that aren't labelled are passed over."""
    kinds = Kinds()
    found = [x for x in (labelled(p, kinds) for p in pages) if x]
    articles = [[t.text[i] for i in t.text if s[i]] for t, s in found]
    others = [x for t, s in found for i, x in t.text.items() if len(x.split()) > 3][:5000] or list(SENTENCES)
    articles = [a for a in articles if a] or [list(SENTENCES)] * 20
    escaped = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
    others = [escaped(x) for x in others]
    for i, a in enumerate(articles):
        for j in range(copies):
            # the whole article, its first blocks, or many of a few words each
            few = a if j % 3 == 1 else a[: 1 + i % 4] if j % 3 == 0 else re.findall(r"\S+(?: \S+){0,%d}" % (i % 5), " ".join(a))[: 4 << i % 5]
            found.append(stated(layouts([escaped(x) for x in few], others, 1000 * i + j), kinds))
    model = Model()
    model.fit(Forest([t for t, _ in found], kinds), np.array([x for _, s in found for x in s], np.int64))
    return model


def main_texts(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page."""
    kinds = Kinds()
    forest = Forest([Tree(p, kinds) for p in pages], kinds)
    good = model.beliefs(forest)[0][forest.leaf, 1] >= 0.5
    of = np.searchsorted(forest.begin, forest.leaf, "right") - 1
    out: list[list[str]] = [[] for _ in pages]
    for i, (_, text), keep in zip(of.tolist(), forest.texts, good.tolist()):
        if keep:
            out[i].append(text)
    return [" ".join(x) for x in out]


def learned(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Model:
    """A model of at most sample different pages with an article element, taken in the order of a hash of their html.

    The hashes are ordered first, so only the pages that are taken go to the driver."""
    column = F.col(html)
    some = pages.filter(column.contains("<article") & (F.length(column) <= SAMPLE_CHARS)).select(column.alias("html"), F.xxhash64(column).alias("draw"))
    last = some.select("draw").distinct().orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    taken = some.filter(F.col("draw") <= F.lit(last)).groupBy("draw").agg(F.first("html").alias("html")) if last is not None else some.limit(0)
    return fitted([r.html for r in sorted(taken.collect(), key=lambda r: r.draw)])


def extracted(pages: DataFrame, model: Model | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep of pages, with text: their main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or learned(pages, html))

    def run(batches):
        for batch in batches:
            texts, at = [x or "" for x in batch.column("_html").to_pylist()], 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= CHUNK:
                    size += len(texts[to])
                    to += 1
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(main_texts(shared.value, texts[at:to]), pa.string())], names=[*keep, "text"])
                at = to

    rows = pages.select(*[f"`{c}`" for c in keep], F.col(html).alias("_html"))
    return rows.mapInArrow(run, rows.select(*[f"`{c}`" for c in keep], F.lit(None).cast("string").alias("text")).schema)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
