"""Operator 10: main text of HTML pages by gradient-boosted trees over DOM-node features.

A page becomes a tree of its block elements; inline markup belongs to the block around it, and a
run of bare text under body is a block without a name.  Each
block has features of its subtree (text, link and punctuation density, counts of paragraphs, list
items and headings), its attributes' tokens, its depth and its siblings.  Boosted trees give the
chance that it belongs to the main text; a dynamic program over the tree then takes the likeliest
labelling in which no block is kept below one that is dropped.

The trees are fitted to pages made here from a seed (``make_page``), with layouts of many kinds;
no page of the input is needed, so a page's text does not depend on the other pages.

Defined results: null and empty html, and pages without main text, give an empty text; rows stand
alone, so repeated rows, ties and further columns change nothing; unclosed and stray tags are
read as browsers read them; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import small_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|data-main|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
TOKEN = re.compile(r"[a-z]+")
INLINE = frozenset("math mi mo mn ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mtable mtr mtd semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of a page.
SILENT = frozenset("script style template title textarea select svg iframe head button annotation annotation-xml".split())
#: Elements that leave the head open; any other, or text, closes it.
IN_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript template".split())
#: The tag of a run of bare text under body.
RUN = "#run"
RAW = frozenset("script style textarea title iframe template".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

#: Attribute tokens by what they tell of an element.
TOKENS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs topnav pagination pager toc links tabs skip",
    "head": "header masthead banner logo brand topbar top",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside widget rail secondary complementary related recommended popular trending more",
    "talk": "comment comments reply replies respond disqus discussion thread responses feedback commentlist",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sponsorship adsense dfp commercial",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer warning announcement",
    "share": "share sharing social follow tweet facebook subscribe newsletter signup",
    "form": "form search login register input contact",
    "main": "article content main post entry story body text page blog news prose maincontent articlebody",
    "hidden": "hidden visuallyhidden collapsed invisible offscreen",
    "meta": "meta byline author date tags tag category categories caption timestamp info",
}
TOKENS = {k: frozenset(v.split()) for k, v in TOKENS.items()}
KINDS = tuple(TOKENS)
TAG_KINDS = {"p": 0, RUN: 0, "div": 1, "section": 2, "article": 3, "main": 4, "nav": 5, "header": 6, "footer": 7, "aside": 8, "form": 9, "ul": 10, "ol": 10, "menu": 10, "dl": 10, "li": 11, "dt": 11, "dd": 11, "h1": 12, "h2": 13, "h3": 13, "h4": 13, "h5": 13, "h6": 13, "table": 14, "tbody": 14, "tr": 14, "thead": 14, "td": 15, "th": 15, "blockquote": 16, "pre": 17, "figure": 18, "figcaption": 18, "body": 19, "html": 19}


class Node:
    __slots__ = ("tag", "parent", "depth", "kids", "kinds", "own", "link", "punct", "mark", "chars", "links", "puncts", "blocks", "items", "heads", "tags", "place")

    def __init__(self, tag: str, parent: int, depth: int, kinds: int, mark):
        self.tag, self.parent, self.depth, self.kinds, self.mark = tag, parent, depth, kinds, mark
        self.kids: list[int] = []
        self.own = self.link = self.punct = self.place = 0


def _kinds(attrs: str) -> tuple[int, str | None]:
    """Bits of the token groups in class, id and role, and for what is not displayed; the label of a
    made page."""
    bits, mark = 0, None
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "data-main":
            mark = value
        elif name == "hidden" or name == "style":
            if name == "hidden" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bits |= 1 << KINDS.index("hidden")
        else:
            for t in TOKEN.findall(value):
                for i, k in enumerate(KINDS):
                    if t in TOKENS[k]:
                        bits |= 1 << i
    return bits, mark


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Block elements, and text pieces by block in page order; None ends a line of text."""
    nodes, pieces = [Node("html", -1, 0, 0, None)], []
    stack: list[tuple[str, int]] = [("html", 0)]
    at, anchors, silent = 0, 0, 0
    run = 0  # the open run of bare text
    size = len(page)

    def add(name: str, bits: int, mark) -> int:
        nonlocal run
        up = stack[-1][1]
        node = Node(name, up, nodes[up].depth + 1, bits, mark)
        node.place = len(nodes[up].kids)
        nodes[up].kids.append(len(nodes))
        nodes.append(node)
        run = 0
        return len(nodes) - 1

    def text(a: int, b: int) -> None:
        nonlocal run
        if a < b and stack[-1][0] == "head" and page[a:b].strip():
            pop(len(stack) - 1)
        if a < b and not silent:
            s = page[a:b]
            if "&" in s:
                s = _html.unescape(s)
            n, own = len(s.split()), stack[-1][1]
            if not own:
                if n and not run:
                    run = add(RUN, 0, None)
                own = run
            node = nodes[own]
            pieces.append((own, s))
            if n:
                long_ = len(s.strip())
                node.own += long_
                node.punct += s.count(".") + s.count(",") + s.count("!") + s.count("?") + s.count(";")
                if anchors:
                    node.link += long_

    def pop(n: int) -> None:
        nonlocal anchors, silent
        while len(stack) > n:
            name = stack.pop()[0]
            anchors -= name == "a"
            silent -= name in SILENT
            if name not in INLINE:
                pieces.append((0, None))

    while at < size:
        i = page.find("<", at)
        if i < 0:
            break
        m = TAG.match(page, i)
        if m is None:
            # a bare sign is text
            j = page.find("<", i + 1)
            text(at, j if j >= 0 else size)
            at = j if j >= 0 else size
            continue
        text(at, i)
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not close and stack[-1][0] == "head" and name not in IN_HEAD:
            pop(len(stack) - 1)
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            else:
                if name in ("p", "br"):
                    pieces.append((0, None))
            continue
        if name in VOID:
            if name != "wbr":
                pieces.append((0, None))
            continue
        if name in ("html", "body"):
            if name == "body":
                pop(1)
            continue
        if name == "head" and len(nodes) > 1:
            continue
        if name in CLOSED_BY_BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in ("td", "th", "table", "caption") or stack[k][0] not in INLINE:
                    break
        if name in CLOSES:
            ends, bounds = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in ends:
                    pop(k)
                    if name != "tr" and name != "tbody":
                        break
        if name in RAW:
            j = re.compile(f"</{name}", re.I).search(page, at)
            k = page.find(">", j.end()) if j else -1
            at = size if k < 0 else k + 1
            continue
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            anchors += name == "a"
            continue
        bits, mark = _kinds(attrs) if attrs.strip() else (0, None)
        add(name, bits, mark)
        pieces.append((0, None))
        silent += name in SILENT
        stack.append((name, len(nodes) - 1))
    text(at, size)
    return nodes, pieces


WIDTH = 2 * len(KINDS) + 38


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each block."""
    for n in nodes:
        n.chars, n.links, n.puncts, n.tags = n.own, n.link, n.punct, 1
        n.blocks, n.items, n.heads = int(n.tag in ("p", RUN)), int(n.tag == "li"), int(n.tag in ("h1", "h2", "h3", "h4"))
    for n in reversed(nodes[1:]):
        p = nodes[n.parent]
        p.chars += n.chars
        p.links += n.links
        p.puncts += n.puncts
        p.tags += n.tags
        p.blocks += n.blocks
        p.items += n.items
        p.heads += n.heads
    x = np.zeros((len(nodes), WIDTH), np.float32)
    total = max(1, nodes[0].chars)
    above = [0] * len(nodes)
    tags_above = [0] * len(nodes)
    start = [0] * len(nodes)
    k = len(KINDS)
    for i, n in enumerate(nodes):
        p = nodes[n.parent] if i else n
        if i:
            above[i] = above[n.parent] | p.kinds
            tags_above[i] = tags_above[n.parent] | 1 << TAG_KINDS.get(p.tag, 20)
            start[i] = start[n.parent] + sum(nodes[j].chars for j in p.kids[: n.place][-8:])
        row = x[i]
        for b in range(k):
            row[b] = n.kinds >> b & 1
            row[k + b] = above[i] >> b & 1
        up = tags_above[i]
        before = nodes[p.kids[n.place - 1]] if i and n.place else None
        after = nodes[p.kids[n.place + 1]] if i and n.place + 1 < len(p.kids) else None
        row[2 * k :] = (
            TAG_KINDS.get(n.tag, 20), n.depth, len(n.kids), n.place, len(p.kids),
            np.log1p(n.chars), np.log1p(n.own), n.links / max(1, n.chars), n.link / max(1, n.own), n.chars / n.tags,
            n.puncts / max(1, n.chars) * 100, n.blocks, n.items, n.heads, n.chars / total,
            n.blocks / n.tags, n.items / n.tags, n.chars / max(1, p.chars), p.links / max(1, p.chars), p.blocks,
            np.log1p(p.chars), TAG_KINDS.get(p.tag, 20), p.chars / total,
            TAG_KINDS.get(before.tag, 20) if before else -1, np.log1p(before.chars) if before else -1, before.links / max(1, before.chars) if before else -1,
            TAG_KINDS.get(after.tag, 20) if after else -1, np.log1p(after.chars) if after else -1, after.links / max(1, after.chars) if after else -1,
            up >> 3 & 1, up >> 4 & 1, up >> 5 & 1, up >> 6 & 1, up >> 7 & 1, up >> 8 & 1, up >> 9 & 1, up >> 10 & 1, n.place / max(1, len(p.kids) - 1),
        )
    return x


class Boosted:
    """Boosted regression trees on the logistic loss, over features cut into bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        n, width = b.shape
        wide = bins
        flat = b + np.arange(width) * wide
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        self.depth, self.trees = depth, []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            # nodes of a complete tree by number; feature -1: no split, all go left
            feature, cut_ = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64)
            at = np.zeros(n, np.int64)
            for node in range(2**depth - 1):
                own = np.nonzero(at == node)[0]
                if len(own) > 4:
                    gs = np.bincount(flat[own].ravel(), np.repeat(g[own], width), width * wide).reshape(width, wide).cumsum(1)
                    hs = np.bincount(flat[own].ravel(), np.repeat(h[own], width), width * wide).reshape(width, wide).cumsum(1)
                    G, H = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    gain[(hs < least) | (H - hs < least)] = 0
                    best = int(np.argmax(gain))
                    if gain.ravel()[best] > 1e-3:
                        feature[node], cut_[node] = divmod(best, wide)
                right = (b[own, feature[node]] > cut_[node]) if feature[node] >= 0 else np.zeros(len(own), bool)
                at[own] = 2 * node + 1 + right
            leaf = at - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            f += value[leaf]
            self.trees.append((feature, cut_, value))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the odds."""
        b = self._bin(x)
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut_, value in self.trees:
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                k = feature[at]
                at = 2 * at + 1 + ((b[rows, k] > cut_[at]) & (k >= 0))
            out += value[at - (2**self.depth - 1)]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which a kept block's ancestors are kept; the root always is.
    A block counts by its own text (and a little for itself)."""
    n = len(nodes)
    up, drop = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        w = 0.25 + min(4.0, nodes[i].own / 60)
        z = float(odds[i])
        keep = -w * float(np.logaddexp(0, -z))
        none = -w * float(np.logaddexp(0, z))
        for j in nodes[i].kids:
            keep += max(up[j], drop[j])
            none += drop[j]
        up[i], drop[i] = keep, none
    kept = [False] * n
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and up[i] > drop[i]
    return kept


def assemble(pieces: list[tuple[int, str | None]], kept: list[bool], root: bool) -> str:
    out = []
    for i, s in pieces:
        if s is None:
            out.append(" ")
        elif kept[i] and (i or root):
            out.append(s)
    return " ".join("".join(out).split())


# ---- pages to learn from

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro sa ti ve xo za ren tion ment keit ado que sch the and of in ly ing".split()


def make_page(seed: int) -> str:
    """A page of some layout; blocks with data-main="1" are its main text, those with 0 are not."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(a: int = 4, b: int = 18) -> str:
        w = [word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(a, b))]
        if r.random() < 0.1:
            w[r.randrange(len(w))] = f'<a href="/{word()}">{word()} {word()}</a>'
        if r.random() < 0.1:
            w[r.randrange(len(w))] = r.choice(["<b>%s</b>", "<em>%s</em>", "<i>%s</i>", "<code>%s</code>", "%s&amp;", "&quot;%s&quot;"]) % word()
        return " ".join(w).capitalize() + r.choice(["."] * 6 + ["!", "?", ""])

    def prose(n: int) -> str:
        return " ".join(sentence() for _ in range(max(1, n)))

    def attr(*names: str, p: float = 0.85) -> str:
        if r.random() > p:
            return r.choice(["", f' class="{word()}"'])
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice([f"{name}-{word()}", f"{word()} {name}", f"{word()}-{name}", f"site-{name}", f"{name}s" if name[-1] != "s" else name])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(n: int) -> str:
        return "".join(f"<li><a href='/{word()}'>{word()}{' ' + word() if r.random() < 0.3 else ''}</a>" + r.choice(["</li>", "</li>", ""]) for _ in range(n))

    def p(s: str) -> str:
        return r.choice([f"<p>{s}</p>"] * 6 + [f"<p>{s}", f"<p><b>{s}<br>", f'<p class="{word()}">{s}</p>'])

    def nav() -> str:
        inner = r.choice([f"<ul>{links(r.randint(3, 9))}</ul>", " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(r.randint(3, 8)))])
        return r.choice([f"<nav data-main=0>{inner}</nav>"] * 2 + [f'<div{attr("nav", "menu", "navbar", "breadcrumb", "topnav")} data-main=0>{inner}</div>', f'<nav{attr("menu", "navigation")} data-main=0>{inner}</nav>'])

    def header() -> str:
        inner = r.choice(["", f"<h1>{word()} {word()}</h1>", f"<p>{sentence(2, 6)}</p>", f'<a href="/">{word()}</a>']) + (nav() if r.random() < 0.5 else "")
        return r.choice([f"<header data-main=0>{inner}</header>", f'<div{attr("header", "masthead", "topbar", "banner")} data-main=0>{inner}</div>'])

    def footer() -> str:
        inner = r.choice([f"&copy; {word()} {r.randint(1999, 2026)} &middot; {sentence(2, 8)}", f"<p>{sentence(3, 12)}</p><ul>{links(4)}</ul>", f"<p>{prose(2)}</p>"])
        return r.choice([f"<footer data-main=0>{inner}</footer>"] * 2 + [f'<div{attr("footer", "copyright", "legal", "colophon")} data-main=0>{inner}</div>'])

    def unseen() -> str:
        t = r.choice(["div", "div", "p", "section", "span"])
        t = "div" if t == "span" else t
        mark = r.choice([" hidden", ' style="display:none"', ' style="visibility: hidden"', ' class="hidden"', ' class="visuallyhidden"'])
        return f"<{t}{mark} data-main=0>{r.choice([prose(r.randint(1, 3)), f'<b>{word()}</b> {sentence()}'])}</{t}>"

    def fallback() -> str:
        return r.choice([f"<noscript data-main=0><p>{sentence(4, 10)}</p></noscript>", f"<noscript data-main=0><img src=x>{sentence(3, 8)}</noscript>", f"<object data-main=0>{sentence(2, 8)}</object>", f"<canvas data-main=0>{sentence(2, 8)}</canvas>", f"<video data-main=0>{sentence(3, 8)}</video>"])

    def ad() -> str:
        inner = r.choice([prose(r.randint(1, 3)), f"<p>{prose(r.randint(1, 3))}</p>", f'<a href="/{word()}">{sentence(3, 8)}</a>', f"<h3>{sentence(2, 4)}</h3><p>{prose(2)}</p>"])
        return f'<{(t := r.choice(["div", "div", "aside", "section"]))}{attr("ad", "ads", "advert", "sponsored", "promo", "advertisement", p=0.97)} data-main=0>{inner}</{t}>'

    def notice() -> str:
        return f'<{(t := r.choice(["div", "div", "section", "aside"]))}{attr("cookie", "consent", "notice", "gdpr", "alert", "popup", p=0.97)} data-main=0>{r.choice([p(prose(r.randint(1, 3))), prose(r.randint(1, 2))])}{r.choice(["", "<button>ok</button>"])}</{t}>'

    def side() -> str:
        inner = "".join(r.choice([f"<h3>{sentence(1, 4)}</h3><ul>{links(r.randint(2, 6))}</ul>", f"<h3>{sentence(1, 4)}</h3><p>{prose(r.randint(1, 3))}</p>", f"<div><p>{prose(r.randint(1, 2))}</p></div>", p(prose(2))]) for _ in range(r.randint(1, 3)))
        return r.choice([f"<aside data-main=0>{inner}</aside>"] * 2 + [f'<div{attr("sidebar", "widget", "related", "rail", "side", p=0.97)} data-main=0>{inner}</div>', f'<aside{attr("sidebar", "related")} data-main=0>{inner}</aside>'])

    def form() -> str:
        return f'<form{attr("search", "newsletter", "login", "form", p=0.5)} data-main=0>{r.choice(["", f"<p>{sentence(3, 9)}</p>"])}<label>{word()} {word()}</label><input name="q">{r.choice(["", f"<div>{sentence(2, 7)}</div>"])}<button>{word()}</button></form>'

    def share() -> str:
        return f'<div{attr("share", "social", "tags", "meta", p=0.95)} data-main=0>{"".join(f"<a href=#>{word()}</a> " for _ in range(r.randint(2, 5)))}</div>'

    def talk() -> str:
        one = lambda: r.choice([f"<li>{p(prose(r.randint(1, 4)))}</li>", f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><b>{word()}</b>{p(prose(r.randint(1, 4)))}</div>', f"<article class=comment>{p(prose(r.randint(1, 4)))}</article>"])
        inner = r.choice(["", f"<h2>{sentence(1, 3)}</h2>", f"<h3>{r.randint(1, 9)} {word()}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        return f'<{(t := r.choice(["section", "div", "div", "ol"]))}{attr("comments", "comment", "discussion", "responses", "replies", "commentlist", p=0.99)} data-main=0>{inner}</{t}>'

    def block() -> str:
        return r.choices([lambda: p(prose(r.randint(1, 6))), lambda: f"<h2>{sentence(1, 6)}</h2>", lambda: f"<ul>{''.join(f'<li>{sentence(2, 14)}</li>' for _ in range(r.randint(2, 5)))}</ul>", lambda: f"<ol>{''.join(f'<li>{sentence(2, 14)}' for _ in range(r.randint(2, 5)))}</ol>", lambda: f"<blockquote>{r.choice([prose(2), p(prose(2))])}</blockquote>", lambda: f"<pre>{sentence()}\n  {sentence()}</pre>", lambda: f"<table><tr><th>{word()}<th>{word()}</tr><tr><td>{sentence(1, 6)}</td><td>{sentence(1, 6)}</td></tr></table>", lambda: f"<figure><img src=x><figcaption>{sentence(2, 9)}</figcaption></figure>", lambda: f"<div>{p(prose(r.randint(1, 4)))}</div>", lambda: p(word().capitalize() + "."), lambda: f"<p>{prose(2)}<br>{prose(2)}</p>"], [14, 2, 1, 1, 1, 0.5, 0.7, 0.4, 1, 1.5, 0.7])[0]()

    def article() -> str:
        head = r.choice([f"<h1>{sentence(2, 9)}</h1>"] * 4 + [f"<h2>{sentence(2, 9)}</h2>", "", f"<header><h1>{sentence(2, 9)}</h1></header>"])
        body = [block() for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25]))]
        for f in (ad, share, side, notice, form, unseen, fallback):
            if r.random() < 0.12:
                body.insert(r.randint(0, len(body)), f())
        inner = head + "".join(body)
        if r.random() < 0.06:
            inner += talk()
        kind = r.random()
        if kind < 0.5:
            return f"<article data-main=1>{inner}</article>"
        if kind < 0.6:
            return f'<main data-main=1>{inner}</main>'
        if kind < 0.65:
            return f"<main data-main=1><article>{inner}</article></main>"
        t = r.choice(["div", "div", "section"])
        return f'<{t}{attr("content", "article", "post", "entry", "story", "main", "text", p=0.9)} data-main=1>{inner}</{t}>'

    main = article()
    before = [f() for f, q in ((notice, 0.15), (header, 0.5), (nav, 0.75), (form, 0.12), (ad, 0.5)) if r.random() < q]
    after = [f() for f, q in ((unseen, 0.1), (fallback, 0.1), (share, 0.15), (ad, 0.2), (talk, 0.35), (side, 0.35), (form, 0.15), (notice, 0.15)) if r.random() < q]
    if r.random() < 0.2:
        r.shuffle(after)
    if r.random() < 0.1:
        before.append(side())
    middle = "".join(before) + main + "".join(after) + (footer() if r.random() < 0.85 else "")
    if r.random() < 0.35:
        t = r.choice(["div", "div", "main", "section"])
        cut_ = r.randint(0, len(before))
        middle = "".join(before[:cut_]) + f'<{t}{attr("wrapper", "container", "page", "row", "layout", "content")}>' + "".join(before[cut_:]) + main + "".join(after) + f"</{t}>" + footer()
    return f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title><style>p{{margin:0}}</style></head><body><script>var t='</p>';</script>{middle}</body></html>"


def labels_of(nodes: list[Node]) -> np.ndarray:
    """1 for blocks in a main part, or that hold one."""
    y = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        y[i] = float(n.mark) if n.mark in ("0", "1") else y[n.parent] if i else 0
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] and nodes[i].mark == "1":
            j = nodes[i].parent
            while j >= 0:
                y[j] = 1
                j = nodes[j].parent
    return y


@lru_cache(maxsize=2)
def model(pages: int = 700, seed: int = 11) -> Boosted:
    xs, ys = [], []
    for s in range(pages):
        nodes, _ = parse(make_page(seed * 1_000_003 + s))
        xs.append(features(nodes)[1:])
        ys.append(labels_of(nodes)[1:])
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def extract_batch(trees: Boosted, pages: list[str | None]) -> list[str]:
    parsed = [parse(x) if x else ([], []) for x in pages]
    rows = [features(nodes) for nodes, _ in parsed if nodes]
    odds = trees.odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes, pieces in parsed:
        if not nodes:
            out.append("")
            continue
        z = odds[at : at + len(nodes)]
        at += len(nodes)
        # there is nothing to tell bare text from where the body has no other blocks
        bare = all(n.tag in (RUN, "head") for n in nodes[1:])
        out.append(assemble(pieces, [True] * len(nodes) if bare else decode(nodes, z), bare))
    return out


def main_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """All columns of pages but the html, with its main text."""
    trees = model()
    cols = [c for c in pages.columns if c not in (column, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = extract_batch(trees, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.string())], names=[*batch.schema.names[1:], into])

    small_batches(pages.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in pages.select(*cols).dtypes)
    return pages.select(column, *cols).mapInArrow(run, f"{schema + ', ' if schema else ''}`{into}` string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return x.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLES: dict = {}
