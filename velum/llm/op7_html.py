"""Operator 7: main text of web pages by boosted trees over DOM nodes.

A page is parsed into its block elements and text blocks. Each becomes a row
of features: tag, attribute tokens of the node and of its ancestors, depth,
text and link density of its subtree, counts and lengths of its siblings, its
place in the page. Gradient-boosted trees give each node the log-odds that its
subtree holds main text, and hierarchical decoding picks the best labelling
in which a node without main text has no descendant with some and a node with
main text has at least one such child (a maximum over the tree, exact).

The trees are trained here, once per process, on pages that ``make_page``
generates from many layouts with a fixed seed (``TRAIN_PAGES``); no corpus page
is used for training.

Cases: a null or empty html gives an empty text; repeated rows are treated
alike; an empty table gives an empty result; other columns are carried if
named in ``keep``. Unclosed, truncated and misnested markup is parsed as far
as it goes; whole pages are read, whatever their length.
"""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import table
from velum.llm import arrow

TRAIN_PAGES, TREES, DEPTH, RATE, BINS, SEED = 600, 40, 4, 0.3, 32, 11

SKIPPED = {"script", "style", "head", "template", "noscript", "svg", "iframe", "object", "select", "textarea", "math", "canvas", "audio", "video", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "#root"}

TAGS = ["p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "button", "table", "td", "article", "main", "section", "div", "blockquote", "pre", "figure", "figcaption", "dl", "body"]
TOKENS = {
    "menu": "nav navbar navigation menu topbar breadcrumb breadcrumbs toolbar pagination pager skip",
    "head": "header masthead banner logo top hero",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside widget rail secondary complementary",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp commercial",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay privacy paywall warning toast",
    "comment": "comment comments reply replies discussion disqus respond feedback reader",
    "share": "share sharing social related recommended more tags tag meta byline author subscribe newsletter signup login search form",
    "main": "article post content entry story main body text maincontent articlebody hentry page prose",
}
_TOKEN_OF = {w: k for k, ws in TOKENS.items() for w in ws.split()}
_KINDS = list(TOKENS)
_INSIDE = {"nav": 1, "footer": 2, "header": 2, "aside": 4, "form": 8, "article": 16, "main": 16, "button": 32}
_TAG_NO = {t: k for k, t in enumerate(TAGS)}
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "flags", "text", "link_chars", "depth", "above", "inside", "at")

    def __init__(self, tag, parent, flags=0):
        self.tag, self.parent, self.children, self.flags = tag, parent, [], flags
        self.text, self.link_chars = None, 0
        self.depth = parent.depth + 1 if parent else 0
        self.above = parent.above | parent.flags if parent else 0
        self.inside = (parent.inside if parent else 0) | _INSIDE.get(tag, 0)
        self.at = 0  # place in the list of nodes


class Builder(HTMLParser):
    """Block elements and text blocks (tag '#text') as a tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.skip, self.links, self.buffer, self.linked = [], 0, [], 0

    def flush(self):
        if self.buffer:
            text = _SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                leaf = Node("#text", self.at)
                leaf.text, leaf.link_chars = text, min(self.linked, len(text))
                self.at.children.append(leaf)
            self.buffer, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1] and tag not in VOID:
                self.skip.append(tag)
            elif tag == "body" and self.skip[0] == "head":
                self.skip = []
            else:
                return
        if tag in SKIPPED:
            self.skip.append(tag)
            return
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.buffer.append(" ")
            return
        if tag in INLINE or (tag in VOID and tag != "hr"):
            self.links += tag == "a"
            return
        self.flush()
        if tag in CLOSES_P:
            self.close_open({"p"}, SCOPE | {"td", "th", "li", "div", "article", "section"})
        if tag in OWN_KIND:
            self.close_open(OWN_KIND[tag], SCOPE)
        if tag == "hr":
            return
        flags = 0
        for name, value in attrs:
            if value and name in ("class", "id", "role", "aria-label", "itemprop"):
                for w in _SPLIT.findall(value):
                    k = _TOKEN_OF.get(w.lower())
                    if k:
                        flags |= 1 << _KINDS.index(k)
        node = Node(tag, self.at, flags)
        self.at.children.append(node)
        self.at = node

    def close_open(self, tags, stop):
        n = self.at
        while n.parent and n.tag not in stop:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE or tag in VOID:
            return
        self.flush()
        n = self.at
        while n.parent:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse(html: str) -> list[Node]:
    """The tree's nodes in page order, parents before children."""
    cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", html)  # a page that ends inside a tag
    b = Builder()
    b.feed(html[: cut.start()] if cut else html)
    b.close()
    b.flush()
    out, stack = [], [b.root]
    while stack:
        n = stack.pop()
        n.at = len(out)
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def features(parsed: list[list[Node]]) -> np.ndarray:
    """A row for each node of each page."""
    tag, up_tag, flags, above, inside, rest = [], [], [], [], [], []
    for nodes in parsed:
        n = len(nodes)
        chars, links, tags, paras, stops, blocks, before = ([0] * n for _ in range(7))
        so_far = 0
        for i, x in enumerate(nodes):
            before[i] = so_far
            t = x.text
            if t is not None:
                chars[i], links[i], blocks[i] = len(t), x.link_chars, 1
                stops[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
                so_far += len(t)
            else:
                tags[i], paras[i] = 1, x.tag in ("p", "h1", "h2")
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent.at
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            paras[p] += paras[i]
            stops[p] += stops[i]
            blocks[p] += blocks[i]
        total = max(1, chars[0])
        order = [(0, 1, 1, 0.0, 0.0)] * n
        for x in nodes:
            kids = x.children
            if kids:
                many, kid_chars, kid_links, same = len(kids), 0, 0, {}
                for c in kids:
                    kid_chars += chars[c.at]
                    kid_links += links[c.at]
                    same[c.tag] = same.get(c.tag, 0) + 1
                for k, c in enumerate(kids):
                    order[c.at] = (k, many, same[c.tag], kid_chars / many, kid_links / max(1, kid_chars))
        for i, x in enumerate(nodes):
            t = x.text
            e = x.parent if t is not None and x.parent else x  # a text block has its element's tag and attributes
            up = e.parent
            tag.append(_TAG_NO.get(e.tag, -1))
            up_tag.append(_TAG_NO.get(up.tag, -1) if up else -1)
            flags.append(e.flags)
            above.append(e.above)
            inside.append(e.inside)
            pos, many, same, mean_chars, mean_links = order[i]
            c = chars[i]
            last = (t[-1] in ".!?:;\"'»”", "©" in t or "|" in t, t.count(" ") + 1) if t is not None else (0, 0, 0)
            rest.append((t is not None, x.depth, c, links[i] / max(1, c), c / (tags[i] + 1), tags[i], paras[i], stops[i] / max(1, c) * 100, blocks[i], c / total, before[i] / total, pos, many, pos / many, same, mean_chars, mean_links, *last))
    n, k, m = len(rest), len(TAGS), len(_KINDS)
    rows = np.zeros((n, 2 * k + 2 * m + 6 + 20), np.float32)
    for at, which in ((0, tag), (k, up_tag)):
        which = np.array(which, np.int64)
        hit = np.flatnonzero(which >= 0)
        rows[hit, at + which[hit]] = 1
    for at, bits, width in ((2 * k, flags, m), (2 * k + m, above, m), (2 * k + 2 * m, inside, 6)):
        rows[:, at : at + width] = np.array(bits, np.int64)[:, None] >> np.arange(width) & 1
    if n:
        rows[:, 2 * k + 2 * m + 6 :] = np.array(rest, np.float32)
    return rows


class Trees:
    """Gradient boosting for logistic loss on binned features, level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1).astype(np.int64)
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        self.trees = []
        m = x.shape[1]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split, where = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                local = node - first
                best = np.full(width, 1e-6)
                for j in range(m):
                    b = len(self.cuts[j]) + 1
                    if b < 2:
                        continue
                    key = local * b + binned[:, j]
                    gs = np.bincount(key, g, width * b).reshape(width, b).cumsum(1)
                    hs = np.bincount(key, h, width * b).reshape(width, b).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1))[:, :-1]
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better] = top[better]
                    split[first : first + width][better] = j
                    where[first : first + width][better] = self.cuts[j][k[better]]
                right = x[np.arange(len(y)), split[node]] > where[node]
                node = 2 * node + 1 + right
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            f = f + value[leaf]
            self.trees.append((split, where, value))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, where, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, split[node]] > where[node])
            f += value[node - (2**DEPTH - 1)]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The best consistent labelling: main only under main, and a main element has a main child."""
    n = len(nodes)
    gain = [0.0] * n  # best sum over the subtree given that the node is main; not main: 0 for all of it
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.text is not None:
            gain[i] = odds[i]
        elif x.children:
            kids = [gain[c.at] for c in x.children]
            gain[i] = odds[i] + max(sum(k for k in kids if k > 0), max(kids))
        else:
            gain[i] = -np.inf
    label = [False] * n
    label[0] = gain[0] > 0
    for i, x in enumerate(nodes):
        if label[i] and x.children:
            kids = [(gain[c.at], c.at) for c in x.children]
            top = max(kids)
            for k, j in kids:
                label[j] = k > 0 or (j == top[1] and top[0] > -np.inf)
    return label


def _words(r: random.Random, n: int) -> str:
    syllables = "an be co de en er fa ing is ka lo men no or pre qu re st th ti un ver wa".split()
    out = []
    while len(out) < n:
        k = r.randint(3, 18)
        s = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(min(k, n - len(out)))]
        if len(s) > 4 and r.random() < 0.5:
            s[len(s) // 2] += ","
        s[0] = s[0].capitalize()
        s[-1] += r.choice(".....!?") if len(out) + len(s) < n or r.random() < 0.9 else ""
        out += s
    return " ".join(out)


def make_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout, and its main text blocks."""
    main: list[str] = []
    pick = r.choice
    odds = lambda p: r.random() < p
    bare = odds(0.15)  # a layout without telling names or tags

    def attr(*names):
        if bare or odds(0.1):
            return pick(["", f' class="c{r.randint(1, 99)}"'])
        name = pick(names) + pick(["", "", "-inner", "-wrap", "_box"])
        return pick([f' class="{name}"', f' id="{name}"', f' class="x {name}"', f' class="{name} row"'])

    def good(text):
        main.append(text)
        return text

    def link_list(n, tag="ul"):
        items = "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 4)).rstrip(".")}</a>' + pick(["</li>", "</li>", ""]) for i in range(n))
        return f"<{tag}>{items}</{tag}>"

    def boiler(kind):
        short = lambda a=3, b=14: _words(r, r.randint(a, b))
        div = pick(["div", "div", "section"])
        if kind == "nav":
            tag = "div" if bare else pick(["nav", "nav", "div"])
            return f"<{tag}{attr('nav', 'menu', 'navbar', 'topmenu-menu') if tag == 'div' or odds(0.4) else ''}>{link_list(r.randint(3, 9))}</{tag}>"
        if kind == "header":
            tag = "div" if bare else pick(["header", "header", "div"])
            return f"<{tag}{attr('header', 'masthead', 'banner', 'site-header') if tag == 'div' or odds(0.4) else ''}>{pick(['<h1>%s</h1>', '<p>%s</p>', '%s', '<div>%s</div>']) % short(1, 8)}{pick(['', boiler('nav')])}</{tag}>"
        if kind == "footer":
            tag = "div" if bare else pick(["footer", "footer", "div"])
            inner = pick([f"&copy; {r.randint(2000, 2026)} {short()}", f"<p>&copy; site.example.com &middot; {short()}</p>", f"<p>{short(4, 25)}</p>{link_list(r.randint(2, 5))}", f"&copy; blog.example.net &middot; {short()}"])
            return f"<{tag}{attr('footer', 'bottom', 'site-footer', 'copyright') if tag == 'div' or odds(0.4) else ''}>{inner}</{tag}>"
        if kind == "side":
            tag = "div" if bare else pick(["aside", "aside", "div"])
            return f"<{tag}{attr('sidebar', 'side', 'widget', 'rail') if tag == 'div' or odds(0.5) else ''}>{pick(['<h3>%s</h3>', '<h2>%s</h2>', '<p>%s</p>']) % short(1, 4)}{pick([link_list(r.randint(2, 7)), f'<p>{short(5, 40)}</p>'])}</{tag}>"
        if kind == "ad":
            return f"<{div}{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner')}>{pick(['%s', '<p>%s</p>', '<a href=x>%s</a>']) % short(2, 30)}</{div}>"
        if kind == "notice":
            return f"<{div}{attr('cookie-notice', 'consent', 'alert', 'notice', 'gdpr', 'paywall')}><p>{short(5, 40)}</p>{pick(['', '<button>Ok</button>', '<a href=x>More</a>'])}</{div}>"
        if kind == "form":
            return f"<form{attr('search', 'newsletter', 'login', 'subscribe')}><label>{short(1, 4)}</label><input name=q>{pick(['', f'<p>{short(4, 16)}</p>'])}<button>{short(1, 2)}</button></form>"
        if kind == "share":
            return f"<{div}{attr('share', 'social', 'related', 'tags', 'byline')}>{pick([link_list(r.randint(2, 6)), short(2, 8), f'<h3>{short(1, 3)}</h3>' + link_list(3)])}</{div}>"
        if kind == "comments":
            each = "".join(pick([f"<li{attr('comment', 'reply')}><p>{short(1, 3)}</p><p>{short(5, 60)}</p></li>", f"<div{attr('comment')}>{short(1, 2)}<p>{short(4, 70)}</p></div>"]) for _ in range(r.randint(1, 6)))
            return f"<{div}{attr('comments', 'discussion', 'responses-comments', 'comment-list')}><h{3}>{short(1, 3)}</h3>{pick(['<ol>%s</ol>', '%s', '<ul>%s</ul>']) % each}</{div}>"
        return ""

    def body():
        out = []
        if odds(0.85):
            level = pick(["h1", "h1", "h2"])
            out.append(f"<{level}>{good(_words(r, r.randint(2, 12)))}</{level}>")
        loose = odds(0.2)
        for _ in range(pick([1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            text = _words(r, pick([3, 8, 20, 40, 80, 160]))
            if kind < 0.72:
                form = pick(["<p>%s</p>"] * 5 + ["<p><b>%s</b></p>", "<p><b>%s<br>", "<p>%s", "<p><a href=x>Lo</a> %s</p>"] + (["<div>%s</div>"] if loose else []))
                out.append(form % text)
                good("Lo " + text if "Lo<" in form else text)
            elif kind < 0.8:
                out.append(f"<h{r.randint(2, 4)}>{good(_words(r, r.randint(1, 7)).rstrip('.'))}")
                out[-1] += f"</h{out[-1][2]}>"
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{good(_words(r, r.randint(2, 20)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{good(text)}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{good(_words(r, r.randint(1, 6)))}</td>" for _ in range(4)) + "</tr></table>")
            elif kind < 0.94:
                out.append(f"<pre>{good(_words(r, r.randint(4, 30)))}</pre>")
            elif kind < 0.97:
                out.append(boiler(pick(["ad", "share", "side", "notice"])))
            else:
                out.append(f"<figure><img src=x><figcaption>{good(_words(r, r.randint(3, 12)))}</figcaption></figure>")
        return "".join(out)

    page = ['<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>']
    if odds(0.3):
        page.append(f"<div{attr('page', 'wrapper', 'container')}>")
    for kind, p in (("notice", 0.25), ("header", 0.45), ("nav", 0.8), ("ad", 0.4), ("form", 0.15), ("share", 0.1)):
        if odds(p):
            page.append(boiler(kind))
    if odds(0.25):
        page.append(boiler("side"))
    box = "div" if bare else pick(["article", "article", "main", "div", "div", "section"])
    open_box = f"<{box}{attr('article', 'post', 'content', 'entry-content', 'story', 'main', 'articleBody') if box in ('div', 'section') or odds(0.3) else ''}>"
    if odds(0.25):
        open_box = f"<{pick(['main', 'div'])}{attr('content', 'main')}>" + open_box
    inner = body()
    if odds(0.2):
        inner += boiler(pick(["share", "comments", "ad"]))
    page.append(open_box + inner + f"</{box}>")
    for kind, p in (("share", 0.25), ("comments", 0.35), ("side", 0.3), ("ad", 0.25), ("form", 0.15), ("nav", 0.1), ("notice", 0.15), ("footer", 0.8)):
        if odds(p):
            page.append(boiler(kind))
    if odds(0.9):
        page.append("</body></html>")
    return "".join(page), main


_model: list[Trees] = []


def labelled(html: str, main: list[str]) -> tuple[list[Node], np.ndarray]:
    """A generated page's nodes with their true labels."""
    nodes = parse(html)
    y = np.zeros(len(nodes))
    want = list(main)
    for i, x in enumerate(nodes):
        if x.text is not None and want and x.text == _SPACE.sub(" ", want[0]).strip():
            want.pop(0)
            while x is not None:
                y[x.at] = 1
                x = x.parent
    return nodes, y


def model() -> Trees:
    """The trees, trained when first asked for in a process."""
    if not _model:
        r = random.Random(SEED)
        xs, ys = [], []
        for _ in range(TRAIN_PAGES):
            nodes, y = labelled(*make_page(r))
            xs.append(nodes)
            ys.append(y)
        _model.append(Trees(features(xs), np.concatenate(ys)))
    return _model[0]


def extract_texts(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(h) for h in pages]
    if not parsed:
        return []
    odds = trees.log_odds(features(parsed))
    out, at = [], 0
    for nodes in parsed:
        label = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(x.text for x, on in zip(nodes, label) if on and x.text is not None))
    return out


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out_col``: the main text of each whole page, blocks joined by two line feeds."""
    trees = model()
    return arrow.add_columns(pages, html_col, f"`{out_col}` string", lambda texts: [pa.array(extract_texts(texts, trees), pa.string())], keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
