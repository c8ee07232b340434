"""HTML extraction: a tree-structured graphical model labels DOM nodes content or not.

A page becomes a tree of block elements, with its runs of text as leaves. Each node has a
label; potentials of a node depend on its own features, potentials of a parent and child
on both labels and on whether the child is text. Messages passed from the leaves up and
from the root down (sum-product) give every node's probability of being content; runs
above one half are the page's text. All trees of a batch pass their messages together,
level by level.

The potentials are trained by gradient steps on the exact likelihood of labelled pages.
These are laid out by `labelled_pages` from parts that pages are made of, each marked as
kept or not, in many orders, forms and lengths.

Text: character references are decoded, white space in a run is one space, runs are
trimmed and joined by two line feeds in page order. `br` is white space. Nothing is
dropped or capped by length.

Defined cases: a null or empty page, or one without content, gives an empty text. Broken
markup is closed as browsers do for paragraphs, list items and table cells; a head ends
at the first tag or text it cannot hold; stray end tags are ignored. Scripts, styles,
templates, titles, frames and the choices and entries of forms have no text of the page. Identical rows get identical results, other columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements by their part in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr noscript object param canvas"
    # Formulas and drawings stand in a line of text.
    " math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mspace msub msup msubsup munder mover"
    " munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml"
    " svg g text tspan textpath path circle ellipse rect line polyline polygon use defs symbol marker image lineargradient"
    " radialgradient stop clippath mask pattern filter foreignobject".split()
)
SILENT = frozenset("script style template head title iframe select datalist textarea".split())
# What a head may hold; anything else ends it, as `</head>` may be left out.
HEAD = frozenset("base basefont bgsound link meta title script style template noscript noframes".split())
# Parts of a drawing that describe it and are not shown.
UNSEEN = frozenset(("desc", "metadata"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TAGS = (
    "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "td",
    "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "label", "button", "details",
    "address", "dialog", "menu",
)
NAMES = {
    "menu": "nav navbar menu menus navigation breadcrumb breadcrumbs toc pagination pager tabs toolbar skip sitemap",
    "head": "header masthead topbar logo brand banner hero",
    "foot": "footer copyright legal colophon credits imprint",
    "side": "sidebar aside side rail widget widgets related recommended recommendations popular trending",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer warning paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted banner",
    "talk": "comment comments reply replies respond discussion disqus feedback",
    "ask": "form login signup subscribe newsletter search share social follow contact",
    "text": "article content main post entry story text body prose",
    "hidden": "hidden invisible offscreen",
}
_NAMES = {k: v.split() for k, v in NAMES.items()}
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_SHAPES = 5
WIDTH = len(TAGS) + 1 + len(NAMES) + _SHAPES + 1

SEED = 5
PAGES = 300
STEPS = 300
RATE = 0.1
DECAY = 2e-4


class _Tree(HTMLParser):
    """Parents, features and texts of a page's nodes, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.features, self.texts, self.keep = [-1], [(0, ())], [None], [None]
        self.links, self.size = [0], [0]
        self.stack: list[tuple[str, int]] = []
        self.here, self.silent, self.anchors = 0, 0, 0
        self.run: list[str] = []
        self.run_links = 0

    def _text_ends(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self._node(None, (), text)
                self.links[-1] = self.run_links
                self.size[-1] = len(text)
            self.run, self.run_links = [], 0

    def _node(self, tag: str | None, names: tuple, text: str | None) -> None:
        self.parent.append(self.here)
        self.features.append((len(TAGS) if tag not in _TAG_AT else _TAG_AT[tag], names))
        self.texts.append(text)
        self.keep.append(None)
        self.links.append(0)
        self.size.append(0)

    def _pop(self, depth: int) -> None:
        if any(node >= 0 for _, node in self.stack[depth:]):
            self._text_ends()
        for tag, node in self.stack[depth:]:
            self.silent -= node == _SILENT
            self.anchors -= tag == "a"
            if node >= 0:
                self.here = self.parent[node]
        del self.stack[depth:]
        blocks = [node for _, node in self.stack if node >= 0]
        self.here = blocks[-1] if blocks else 0

    def _head_ends(self) -> None:
        """Closes an open head, unless the place is inside a silent element of it."""
        for k in range(len(self.stack) - 1, -1, -1):
            tag, node = self.stack[k]
            if tag == "head":
                self._pop(k)
            if node == _SILENT:
                break

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and self.silent:
            self._head_ends()
        if tag == "head" and any(t != "html" for t, _ in self.stack):
            return
        if tag == "br":
            self.run.append(" ")
            return
        silent = tag in SILENT or (tag in UNSEEN and any(t == "svg" for t, _ in self.stack))
        if tag not in INLINE:
            open_tags = [t for t, _ in self.stack]
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k] in scope:
                        break
                    if open_tags[k] in ends:
                        self._pop(k)
                        break
            elif "p" in open_tags and not silent and tag not in VOID:
                self._pop(len(open_tags) - 1 - open_tags[::-1].index("p"))
        if tag in VOID:
            if tag not in INLINE:
                self._text_ends()
            return
        node = -1
        if silent:
            self.silent, node = self.silent + 1, _SILENT
        elif tag not in INLINE:
            self._text_ends()
            given = dict(attrs)
            self._node(tag, _named(given), None)
            node = self.here = len(self.parent) - 1
            if "data-keep" in given:
                self.keep[node] = given["data-keep"] == "1"
        self.anchors += tag == "a"
        self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break

    def handle_data(self, data):
        if self.silent and not data.isspace():
            self._head_ends()
        if not self.silent:
            self.run.append(data)
            if self.anchors:
                self.run_links += len(data)


_SILENT = -2
_TAG_AT = {t: k for k, t in enumerate(TAGS)}


def _named(attrs: dict) -> tuple:
    """Which groups of names an element's class, id and role fall in."""
    text = " ".join(attrs.get(a) or "" for a in ("class", "id", "role"))
    found = set()
    for word in _WORDS.findall(text):
        word = word.lower()
        for k, names in enumerate(_NAMES.values()):
            if word in names or any(len(n) > 5 and n in word for n in names):
                found.add(k)
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
        found.add(list(_NAMES).index("hidden"))
    return tuple(sorted(found))


def parsed(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree._text_ends()
    return tree


def _matrix(trees: list[_Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Features, parents, which nodes are text, and the nodes of each level below the roots."""
    base = np.cumsum([0, *[len(t.parent) for t in trees]])
    parent = np.concatenate([np.asarray(t.parent) + b for t, b in zip(trees, base)]) if trees else np.zeros(0, int)
    root = base[:-1]
    parent[root] = root
    n = len(parent)
    x = np.zeros((n, WIDTH))
    flat = [f for t in trees for f in t.features]
    x[np.arange(n), [f[0] for f in flat]] = 1
    for k, (_, names) in enumerate(flat):
        for name in names:
            x[k, len(TAGS) + 1 + name] = 1
    size = np.array([v for t in trees for v in t.size], float)
    links = np.array([v for t in trees for v in t.links], float)
    is_text = size > 0
    texts = [s for t in trees for s in t.texts]
    at, depth = len(TAGS) + 1 + len(NAMES), np.zeros(n, int)
    levels = []
    # A parent comes before its children, so depths fill in order.
    order = np.arange(n)
    inner = order[parent != order]
    for k in inner.tolist():
        depth[k] = depth[parent[k]] + 1
    if len(inner):
        by_depth = inner[np.argsort(depth[inner], kind="stable")]
        cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
        levels = np.split(by_depth, cuts)
    for level in reversed(levels):
        size += np.bincount(parent[level], size[level], n)
        links += np.bincount(parent[level], links[level], n)
    x[:, at] = is_text
    x[:, at + 1] = np.minimum(links / np.maximum(size, 1), 1)
    x[:, at + 2] = [bool(s) and ("©" in s or "all rights reserved" in s.lower()) for s in texts]
    x[:, at + 3] = (size < 1) & ~is_text
    x[:, at + 4] = depth <= 2
    x[:, -1] = 1
    return x, parent, is_text, levels


def _add(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds rows of values to rows of ``to``, which may be named more than once."""
    low, high = at.min(), at.max() + 1
    for k in (0, 1):
        to[low:high, k] += np.bincount(at - low, values[:, k], high - low)


def marginals(unary: np.ndarray, tie: np.ndarray, parent: np.ndarray, is_text: np.ndarray, levels: list[np.ndarray]):
    """P(content) of nodes, and P(labels of parent and child) of all nodes that have a parent."""
    up = np.zeros((len(unary), 2))
    up[:, 1] = unary
    message = np.zeros_like(up)
    for level in reversed(levels):
        kind = is_text[level].astype(int)
        joint = tie[kind] + up[level][:, None, :]
        message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        _add(up, parent[level], message[level])
    down = np.zeros_like(up)
    pairs = np.zeros((len(unary), 2, 2))
    for level in levels:
        above = (up + down)[parent[level]] - message[level]
        joint = tie[is_text[level].astype(int)] + above[:, :, None]
        full = joint + up[level][:, None, :]
        full -= full.max(axis=(1, 2), keepdims=True)
        full = np.exp(full)
        pairs[level] = full / full.sum(axis=(1, 2), keepdims=True)
        down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
    total = up + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60))), pairs


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages of which each part is marked by `data-keep`: 1 content, 0 not."""
    rng, pool = random.Random(seed), ["an", "ore", "lines", "t", "cedar", "motions", "build", "under", "sea", "tolerant"]

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choices(pool, k=rng.randint(lo, max(lo, hi // 3)))).capitalize() + rng.choice([".", "!", ""])

    def some(lo: int, hi: int, make) -> str:
        return "".join(make() for _ in range(rng.randint(lo, hi)))

    def links(tag: str = "li") -> str:
        return some(2, 7, lambda: f'<{tag}><a href="/x">{words(1, 3)}</a></{tag}>')

    def named(*choices: str) -> str:
        name = rng.choice(choices)
        return rng.choice([f'class="{name}"', f'id="{name}"', f'class="x-{name} y"'])

    def paragraphs(lo: int = 1, hi: int = 8) -> str:
        return some(lo, hi, lambda: rng.choice([
            f"<p>{words(1, 80)}</p>", f"<p>{words(3, 60)}<br><p>{words(1, 50)}", f"<p><b>{words(5, 50)}",
            f'<p>{words(8, 60)} <a href="/y">{words(1, 4)}</a> {words(2, 20)}</p>', f"<h2>{words(1, 6)}</h2>",
            f"<ul><li>{words(2, 20)}</li><li>{words(2, 20)}</li></ul>", f"<blockquote>{words(6, 40)}</blockquote>",
            f"<pre>{words(4, 30)}</pre>", f"<table><tr><td>{words(1, 5)}<td>{words(1, 5)}</table>", f"<div>{words(5, 60)}</div>",
        ]))

    def bad(body: str) -> str:
        return re.sub(r"^<(\w+)", r'<\1 data-keep="0"', body)

    menus = [lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<div {named('menu', 'nav', 'breadcrumb')}>{links('span')}</div>",
             lambda: f"<ul {named('navbar', 'menu', 'pagination')}>{links()}</ul>", lambda: f'<div role="navigation">{links("div")}</div>']
    heads = [lambda: f"<header><h1>{words(1, 4)}</h1><p>{words(1, 9)}</p></header>",
             lambda: f"<div {named('header', 'masthead', 'topbar')}><a href='/'>{words(1, 3)}</a> {words(1, 12)}</div>"]
    feet = [lambda: f"<footer>&copy; {words(1, 4)} &middot; {words(2, 20)}</footer>", lambda: f"<footer><p>{words(3, 30)}</p></footer>",
            lambda: f"<div {named('footer', 'copyright', 'legal')}><p>{words(3, 30)}</p><ul>{links()}</ul></div>"]
    sides = [lambda: f"<aside><h3>{words(1, 3)}</h3>{some(1, 4, lambda: f'<p>{words(4, 40)}</p>')}</aside>",
             lambda: f"<div {named('sidebar', 'widget', 'related', 'rail')}><h4>{words(1, 3)}</h4><ul>{links()}</ul><p>{words(3, 30)}</p></div>",
             lambda: f"<section {named('related', 'recommended', 'popular')}><h2>{words(1, 3)}</h2><p>{words(6, 40)}</p></section>"]
    notices = [lambda: f"<div {named('cookie', 'consent', 'notice', 'popup', 'alert')}><p>{words(4, 40)}</p><button>{words(1, 2)}</button></div>",
               lambda: f"<div {named('cookie-banner', 'notice', 'disclaimer')}>{words(4, 40)}</div>",
               lambda: f'<dialog><p>{words(4, 30)}</p></dialog>', lambda: f'<div style="display:none"><p>{words(4, 40)}</p></div>',
               lambda: f"<p {named('notice', 'warning')}>{words(3, 30)}</p>"]
    adverts = [lambda: f"<div {named('ad', 'ads', 'advert', 'sponsored', 'promo')}>{words(2, 40)}</div>",
               lambda: f"<div {named('advertisement', 'ad')}><p>{words(4, 30)}</p><a href='/b'>{words(1, 3)}</a></div>",
               lambda: f"<p {named('ad', 'sponsor')}>{words(2, 30)}</p>", lambda: f"<aside {named('ad', 'promo')}>{words(2, 30)}</aside>"]
    asks = [lambda: f"<form><label>{words(1, 3)}</label><input><p>{words(2, 20)}</p><button>{words(1, 2)}</button></form>",
            lambda: f"<div {named('newsletter', 'subscribe', 'share', 'login', 'search')}><p>{words(2, 20)}</p><button>{words(1, 2)}</button></div>"]
    talks = [lambda: f"<section {named('comments', 'discussion')}><h3>{words(1, 2)}</h3>" + some(1, 4, lambda: f"<div {named('comment', 'reply')}><p>{words(3, 50)}</p></div>") + "</section>",
             lambda: f"<div {named('comments', 'responses comment-list')}><ol>" + some(1, 4, lambda: f"<li><b>{words(1, 2)}</b><p>{words(3, 50)}</p></li>") + "</ol></div>",
             lambda: f"<article {named('comment')}><p>{words(3, 50)}</p></article>"]
    body = [lambda inner: f'<article data-keep="1">{inner}</article>', lambda inner: f'<article data-keep="1" {named("post", "entry")}>{inner}</article>',
            lambda inner: f'<main data-keep="1">{inner}</main>', lambda inner: f'<main><article data-keep="1">{inner}</article></main>',
            lambda inner: f'<div data-keep="1" {named("content", "article", "post", "entry-content", "story-body", "main-text")}>{inner}</div>',
            lambda inner: f'<div {named("wrapper", "container")}><div data-keep="1" {named("content", "article-body")}>{inner}</div></div>',
            lambda inner: f'<section data-keep="1">{inner}</section>']
    pages = []
    for _ in range(count):
        inside = rng.random() < 0.35
        inner = rng.choice([f"<h1>{words(1, 10)}</h1>", f"<header><h1>{words(1, 10)}</h1></header>", f"<h1>{words(1, 10)}</h1>", ""]) + paragraphs()
        if inside:
            inner += bad(rng.choice([*adverts, *talks, *asks, *sides, *notices])()) + rng.choice(["", paragraphs(1, 3)])
        before = [bad(rng.choice(group)()) for group in (menus, heads, notices, adverts, sides, asks) if rng.random() < 0.5]
        after = [bad(rng.choice(group)()) for group in (talks, sides, adverts, asks, feet, menus, notices) if rng.random() < 0.5]
        rng.shuffle(before)
        rng.shuffle(after)
        pages.append(f"<html><head><title>{words(1, 6)}</title></head><body>{''.join(before)}{rng.choice(body)(inner)}{''.join(after)}</body></html>")
    return pages


def _labels(tree: _Tree) -> np.ndarray:
    """A node takes the mark of its nearest marked ancestor; a holder of content is content."""
    keep: list[bool | None] = []
    for k, own in enumerate(tree.keep):
        keep.append(own if own is not None else (keep[tree.parent[k]] if k else None))
    label = np.array([v is True for v in keep], float)
    for k in range(len(keep) - 1, 0, -1):
        if label[k] and keep[tree.parent[k]] is None:
            label[tree.parent[k]] = 1
    return label


def train(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features, and potentials of (text child, parent label, child label)."""
    trees = [parsed(p) for p in (labelled_pages() if pages is None else pages)]
    x, parent, is_text, levels = _matrix(trees)
    truth = np.concatenate([_labels(t) for t in trees])
    child = np.concatenate(levels)
    wanted = np.zeros((2, 2, 2))
    np.add.at(wanted, (is_text[child].astype(int), truth[parent[child]].astype(int), truth[child].astype(int)), 1)
    weights, tie = np.zeros(WIDTH), np.zeros((2, 2, 2))
    moments = [np.zeros_like(v) for v in (weights, weights, tie, tie)]
    for step in range(1, STEPS + 1):
        share, pairs = marginals(x @ weights, tie, parent, is_text, levels)
        met = np.stack([pairs[child][is_text[child] == kind].sum(axis=0) for kind in (False, True)])
        slopes = (x.T @ (truth - share) / len(x) - DECAY * weights, (wanted - met) / len(x) - DECAY * tie)
        for k, (target, slope) in enumerate(zip((weights, tie), slopes)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * slope
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * slope**2
            target += RATE * moments[2 * k] / (1 - 0.9**step) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return weights, tie


def texts_of(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The content of each page."""
    trees = [parsed(p or "") for p in pages]
    x, parent, is_text, levels = _matrix(trees)
    share, _ = marginals(x @ model[0], model[1], parent, is_text, levels)
    out, at = [], 0
    for tree in trees:
        chosen = [t for t, p in zip(tree.texts, share[at : at + len(tree.texts)]) if t and p > 0.5]
        out.append("\n\n".join(chosen))
        at += len(tree.texts)
    return out


def content(html: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """The main text of a page."""

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for lo in range(0, len(column), 50):
            out += texts_of(column.slice(lo, 50).to_pylist(), model)
        return pa.array(out, pa.string())

    return extract(html)
