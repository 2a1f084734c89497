"""Main-text extraction: gradient-boosted trees over DOM nodes, and a hierarchical decoding.

Trees give each block element the odds of holding main text, from its tag, its attribute tokens (hashed, with learned odds) and those
above it, depth, text and link density of its subtree, and its siblings. Decoding then chooses the most
likely set of elements in which nothing is kept under an element that is dropped. The tables have no labels
for pages, so the trees are trained on pages made here: layouts of many kinds whose parts are known.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.llm.common import field, sigmoid, spread
from pathlake.llm.dom import INLINE, NAMING, Node, joined, parse, parse_runs

#: Tags that are a feature each. The others are told by their kind, or not at all.
TAGS = ("article", "main", "section", "div", "p", "h", "li", "ul", "table", "blockquote", "nav", "header", "footer", "aside", "form", "head", "dialog", "span", "#text")
RARE = ("noscript", "object", "canvas", "details", "address", "pre", "figure")
CODES = {tag: i for i, tag in enumerate(("body", *TAGS))}
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Attribute tokens are hashed to so many slots; what each says for or against main text is learned.
SLOTS = 1 << 12


def _kind(tag: str) -> str:
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return "h"
    if tag in INLINE:
        return "span"
    return {"ol": "ul", "dl": "ul", "dd": "li", "dt": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "pre": "blockquote", "address": "blockquote", "xmp": "blockquote", "figure": "div", "center": "div", "object": "div", "canvas": "div", "noscript": "div", "details": "div"}.get(tag, tag)


@lru_cache(maxsize=1 << 14)
def _slots(said: str) -> tuple[int, ...]:
    return tuple({zlib.crc32(x.lower().encode()) & (SLOTS - 1) for x in TOKEN.findall(said)})


def slots(node: Node) -> tuple[int, ...]:
    """The slots of the distinct tokens in an element's naming attributes; a tag that is no kind of its own is one too."""
    rare = node.tag if node.tag in RARE else ""
    return _slots(" ".join([rare, *[node.attrs.get(k, "") for k in NAMING]])) if rare or node.attrs else ()


def token_odds(pages: list[list[Node]], labels: list[float]) -> np.ndarray:
    """For each slot how much oftener it stands in main-text elements than in others, as log odds drawn towards 0 where it is rare."""
    hits = np.zeros((2, SLOTS))
    total = np.zeros(2)
    for n, y in zip([x for nodes in pages for x in nodes], labels):
        total[int(y)] += 1
        hits[int(y), list(slots(n))] += 1
    seen = hits.sum(0)
    return (np.log((hits[1] + 0.5) / (total[1] + 1)) - np.log((hits[0] + 0.5) / (total[0] + 1))) * seen / (seen + 4)


def node_features(nodes: list[Node], length: int, odds: np.ndarray) -> np.ndarray:
    """One row of numbers a node."""
    n = len(nodes)
    own = np.array([x.own for x in nodes], float)
    links = np.array([x.links for x in nodes], float)
    paras = np.array([x.tag == "p" for x in nodes], float)
    size, text, link, p = np.ones(n), own.copy(), links.copy(), paras.copy()
    inline = np.array([x.inline for x in nodes], float)
    for x in reversed(nodes[1:]):
        k = x.parent.number
        for a in (size, text, link, p, inline):
            a[k] += a[x.number]
    good, bad = np.zeros(n), np.zeros(n)
    for x in nodes:
        for slot in slots(x):
            if odds[slot] > 0:
                good[x.number] += odds[slot]
            else:
                bad[x.number] -= odds[slot]
    kind = [_kind(x.tag) for x in nodes]
    above = np.zeros((n, 8))  # tokens for and against above; and article, main, nav, header, footer or aside, form above
    order, same = np.zeros(n, int), np.ones(n, int)  # each child's position and how many of its siblings have its tag
    for x in nodes:
        tags = Counter(c.tag for c in x.children)
        for at, c in enumerate(x.children):
            order[c.number], same[c.number] = at, tags[c.tag]
    rows, near = [], np.full((n, 2), -2)  # near: the kinds of the siblings before and after
    total = max(1.0, text[0])
    for x in nodes:
        i = x.number
        if x.parent:
            k = x.parent.number
            a = above[k].copy()
            a[0] += good[k]
            a[1] += bad[k]
            if (c := {"article": 2, "main": 3, "nav": 4, "header": 5, "footer": 6, "aside": 6, "form": 7}.get(kind[k])) is not None:
                a[c] = 1
            above[i] = a
            sib = x.parent.children
            share = text[i] / max(1.0, text[k])
            beside = [text[sib[j].number] if 0 <= (j := order[i] + d) < len(sib) else 0.0 for d in (-1, 1)]
            near[i] = [CODES.get(kind[sib[j].number], -1) if 0 <= (j := order[i] + d) < len(sib) else -2 for d in (-1, 1)]
            parent = [CODES.get(kind[k], -1), good[k], bad[k], math.log1p(own[k]), math.log1p(p[k]), link[k] / max(1.0, text[k]), *near[i], *near[k]]
        else:
            sib, share, beside, parent = [x], 1.0, [0.0, 0.0], [-2, 0.0, 0.0, 0.0, 0.0, 0.0, *near[i], *near[i]]
        rows.append(
            [
                *(kind[i] == t for t in TAGS),
                good[i],
                bad[i],
                *above[i],
                *parent,
                math.log1p(beside[0]),
                math.log1p(beside[1]),
                x.depth,
                math.log1p(text[i]),
                math.log1p(own[i]),
                link[i] / max(1.0, text[i]),
                links[i] / max(1.0, own[i]),
                size[i] / (1 + text[i]) * 100,
                p[i],
                inline[i],
                len(x.children),
                order[i] / len(sib),
                len(sib),
                same[i],
                share,
                text[i] / total,
                x.start / max(1, length),
            ]
        )
    return np.array(rows, np.float32)


class Trees:
    """Gradient-boosted regression trees for a logistic loss, on binned columns."""

    BINS = 32

    def __init__(self, rounds: int = 100, depth: int = 6, rate: float = 0.3, least: float = 0.4):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least

    def _sums(self, bins: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of gradients and weights of some rows, by column and bin."""
        out, g, h = np.empty((2, len(bins), self.BINS)), g[rows], h[rows]
        for j, b in enumerate(bins):
            at = b[rows]
            out[0, j], out[1, j] = np.bincount(at, g, self.BINS), np.bincount(at, h, self.BINS)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = sigmoid(f)
            g, h = y - p, p * (1 - p)
            n_nodes = 2 ** (self.depth + 1) - 1
            col, cut, value = np.full(n_nodes, -1), np.zeros(n_nodes, np.float32), np.zeros(n_nodes, np.float32)
            rows = {0: np.arange(len(y))}
            sums = {0: self._sums(bins, rows[0], g, h)}
            for node in range(n_nodes):
                if node not in rows:
                    continue
                here = rows.pop(node)
                gs, hs = g[here].sum(), h[here].sum()
                value[node] = self.rate * gs / (hs + 1.0)
                if node >= 2**self.depth - 1:
                    f[here] += value[node]
                    continue
                whole = sums.pop(node)
                gl, hl = whole.cumsum(2)[:, :, :-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < self.least) | (hs - hl < self.least)] = -1
                j, k = divmod(int(gain.argmax()), self.BINS - 1)
                if gain[j, k] <= 1e-3:
                    f[here] += value[node]
                    continue
                col[node], cut[node] = j, edges[j][k]
                right = bins[j][here] > k
                rows[2 * node + 1], rows[2 * node + 2] = here[~right], here[right]
                if 2 * node + 1 < 2**self.depth - 1:  # of two children the smaller is summed, the other is what is left
                    small, large = (2 * node + 1, 2 * node + 2) if 2 * right.sum() > len(right) else (2 * node + 2, 2 * node + 1)
                    sums[small] = self._sums(bins, rows[small], g, h)
                    sums[large] = whole - sums[small]
            self.trees.append((col, cut, value))
        return self

    def _one(self, tree, x):
        col, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            c = col[at]
            go = c >= 0
            right = x[np.arange(len(x)), np.maximum(c, 0)] >= cut[at]
            at = np.where(go, 2 * at + 1 + right, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self._one(t, x)
        return f


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """The most likely choice of nodes in which every node above a kept one is kept.

    keep[i] is the best log odds of i's subtree with i kept; without i nothing under it is kept and the subtree counts 0.
    """
    gain = np.minimum(margin, 12.0).astype(float)
    # a wrapper without text of its own costs little to keep for what it holds
    for x in nodes:
        if x.own == 0 and x.children and not any(c.tag == "#text" for c in x.children):
            gain[x.number] = max(gain[x.number], -0.5)
    total = gain.copy()
    for x in reversed(nodes[1:]):
        if total[x.number] > 0:
            total[x.parent.number] += total[x.number]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for x in nodes[1:]:
        keep[x.number] = keep[x.parent.number] and total[x.number] > 0
    return keep


def assemble(runs: list[tuple[Node, list[tuple[Node, str]]]], keep: np.ndarray) -> str:
    """The kept text: each run is a block, without the parts of dropped inline nodes."""
    blocks = (joined([(x, t) for x, t in parts if keep[x.number]]) for node, parts in runs if keep[node.number])
    return "\n\n".join(t for t in blocks if t)


# --- training pages ---------------------------------------------------------------------------------------

#: What pages made for training call their parts, in class, id or role.
NAMES = {
    "main": "article content post entry main body story text page blog hentry markdown prose post-content article-body entry-content post-body main-content story-body articleBody page-content blog-post news-text the-content",
    "title": "title entry-title headline post-title page-title heading",
    "own-head": "entry-header post-header article-header story-header",
    "wrap": "container wrapper page row col layout inner site app root grid section wrap outer",
    "menu": "menu main-menu navbar nav navigation topNav breadcrumb breadcrumbs toc pagination pager tabs toolbar skip-link",
    "notice": "ad ads advert ad-slot advertisement sponsored sponsor promo promo-box cookie-banner cookies notice alert consent gdpr popup modal overlay banner-ad taboola outbrain",
    "side": "sidebar side widget related related-posts recommended newsletter subscribe signup share sharing social tags byline meta-info author-box most-read",
    "comments": "comments comment-list respond disqus_thread reply comment-body comment replies",
    "form": "search login newsletter search-form signup contact-form",
    "head": "header masthead site-header banner logo topbar page-header",
    "foot": "footer site-footer foot copyright legal bottom colophon",
    "inline": "highlight term dfn nowrap caps lead date reference-text citation mw-reflink hljs token keyword smallcaps first-letter",
    "refs": "references reflist footnotes notes bibliography sources",
}
#: Landmark roles of the parts.
ROLES = {"main": "main", "menu": "navigation", "side": "complementary", "form": "search", "head": "banner", "foot": "contentinfo", "notice": "alert"}


def _page(rng: random.Random) -> str:
    """A page whose main-text elements carry the attribute data-y."""
    words = lambda a, b: " ".join("".join(rng.choices("aeioulnrstdm", k=rng.randint(1, 9))) for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=14: words(a, b).capitalize() + rng.choice("...?!")
    para = lambda: " ".join(sentence() for _ in range(rng.randint(1, 8)))
    y = " data-y"
    link = lambda a=1, b=3: f'<a href="/{words(1, 1)}">{words(a, b)}</a>'
    end_p = lambda: rng.choice(("</p>", "</p>", "</p>", ""))

    def cls(part: str) -> str:
        name = rng.choice(NAMES[part].split())
        name = rng.choice(("", "", "", "js-", "c-", "theme-")) + name + rng.choice(("", "", "", "-1", " clearfix", "__box", f" {words(1, 1)}"))
        if part in ROLES and rng.random() < 0.12:
            return f' role="{ROLES[part]}"' + (f' class="{name}"' if rng.random() < 0.4 else "")
        return f' {rng.choice(("class", "class", "class", "id"))}="{name}"'

    def menu():
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        return rng.choice((f"<nav><ul>{items}</ul></nav>", f"<nav{cls('menu')}><ul>{items}</ul></nav>", f"<div{cls('menu')}><ul>{items}</ul></div>", f"<nav>{' | '.join(link() for _ in range(5))}</nav>", f"<div{cls('menu')}>{link()} &gt; {link()} &gt; {words(1, 3)}</div>", f"<ul{cls('menu')}>{items}</ul>"))

    def listed():
        """A menu that nothing names."""
        return f"<ul>{''.join(f'<li>{link(1, 2)}</li>' for _ in range(rng.randint(3, 9)))}</ul>"

    def notice():
        tag = rng.choice(("div", "div", "section", "aside", "dialog"))
        return rng.choice((f"<div{cls('notice')}>{sentence()}</div>", f"<aside>{sentence()}</aside>", f"<{tag}{cls('notice')}><p>{para()}{end_p()}</{tag}>", f"<div{cls('notice')}><p>{sentence()}</p></div>", f"<p{cls('notice')}>{sentence()}</p>", f"<dialog open><p>{para()}</p></dialog>"))

    def side():
        tag = rng.choice(("aside", "div", "section"))
        inner = f"<h3>{words(1, 4)}</h3>" + rng.choice(("<ul>" + "".join(f"<li>{link(2, 6)}</li>" for _ in range(5)) + "</ul>", f"<p>{para()}</p>", "".join(f"<p>{link(3, 7)}</p>" for _ in range(4)), f"<div><p>{para()}</p><p>{sentence()}</p></div>"))
        return f"<{tag}{'' if tag == 'aside' and rng.random() < 0.5 else cls('side')}>{inner}</{tag}>"

    def comments():
        one = lambda: f"<{(t := rng.choice(('div', 'li', 'article')))}{cls('comments')}><p>{para()}</p></{t}>"
        tag = rng.choice(("div", "section"))
        return f"<{tag}{cls('comments')}><h3>{words(1, 2)}</h3>{''.join(one() for _ in range(rng.randint(1, 6)))}</{tag}>"

    def form():
        label = rng.choice((f"<p>{sentence(1, 5)}</p>", f"<div>{words(1, 3)}</div>", words(1, 4), f"<h3>{words(1, 3)}</h3><p>{para()}</p>"))
        return f"<form{rng.choice(('', cls('form')))}>{label}<input name=q><button>{words(1, 1)}</button></form>"

    def head():
        inner = rng.choice((f"<h1>{words(1, 3)}</h1>{menu()}", f"<p>{sentence(2, 6)}</p>{menu()}", f"<div{cls('head')}>{link()}</div>", f"<h2>{words(2, 5)}</h2>", f"<h1>{link(1, 3)}</h1><p>{sentence(3, 9)}</p>"))
        return rng.choice((f"<header>{inner}</header>", f"<div{cls('head')}>{inner}</div>", menu()))

    def foot():
        inner = rng.choice((f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{sentence()}</p>", f"<p>{para()}</p>", "".join(f"<p>{link()}</p>" for _ in range(3)), f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>"))
        return rng.choice((f"<footer>{inner}</footer>", f"<footer{cls('foot')}>{inner}</footer>", f"<div{cls('foot')}>{inner}</div>"))

    def spans(t: str) -> str:
        """A sentence in which words stand in named inline elements, some of them adverts."""
        out = t.split()
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(out))
            out[k] = rng.choice((f"<span{y}{cls('inline')}>{out[k]}</span>", f"<em{y}{cls('inline')}>{out[k]}</em>", f'<a{y} href="/x"{cls("inline")}>{out[k]}</a>', f"<math><mi>{words(1, 1)}</mi><mo>=</mo><mn>7</mn></math>"))
        if rng.random() < 0.35:
            out.insert(rng.randint(0, len(out)), f"<{(t := rng.choice(('span', 'a', 'ins')))}{cls(rng.choice(('notice', 'notice', 'side')))}>{words(1, 6)}</{t}>")
        return " ".join(out)

    def block():
        k = rng.random()
        if k < 0.57:
            t = para() if rng.random() < 0.8 else sentence(1, 5)
            if rng.random() < 0.06:  # a very long one beside the others
                t = " ".join([t, para()] * rng.randint(2, 60))
            if rng.random() < 0.3:
                t = f"{sentence()} {link(1, 4)} {t}"
            if rng.random() < 0.15:
                t = f"<b>{t}<br>"
            elif rng.random() < 0.2:
                t = spans(t)
            return f"<p{y}{cls('main') if rng.random() < 0.08 else ''}>{t}{end_p()}"
        if k < 0.66:
            return f"<h{(h := rng.randint(2, 4))}{y}>{words(1, 7)}</h{h}>"
        if k < 0.72:
            return f"<ul{y}>{''.join(f'<li{y}>{sentence(2, 9)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if k < 0.76:
            return f"<blockquote{y}>{rng.choice((sentence(), f'<p{y}>{para()}</p>'))}</blockquote>"
        if k < 0.79:
            return f"<table{y}>{''.join(f'<tr{y}><td{y}>{words(1, 3)}</td><td{y}>{words(1, 3)}</td></tr>' for _ in range(3))}</table>"
        if k < 0.82:
            return f"<div{y}>{rng.choice((para, sentence))()}</div>"
        if k < 0.86:
            return rng.choice((f"<pre{y}>{words(1, 9)}</pre>", f"<pre{y}><code>{words(3, 40)}</code></pre>", f"<xmp{y}>{words(1, 9)}</xmp>"))
        if k < 0.89:
            return f"<address{y}>{rng.choice((sentence(), words(2, 9), f'{words(1, 4)}, {words(1, 3)}', f'{words(1, 3)}<br>{words(1, 3)}'))}</address>"
        if k < 0.92:
            return f"<p{y}>{rng.choice((link(1, 9), link(4, 12), f'<b>{link(2, 6)}</b>'))}{end_p()}"
        if k < 0.948:  # a list of links that belongs to what is told
            return rng.choice(("", f"<p{y}>{words(1, 4).capitalize()}:{end_p()}")) + f"<ul{y}>{''.join(f'<li{y}>{link(1, 6)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if k < 0.957:
            return f"<figure{y}><img src=x><figcaption{y}>{sentence()}</figcaption></figure>"
        if k < 0.985:
            t = rng.choice(("noscript", "noscript", "noscript", "object", "canvas", "details"))
            return f"<{t}{y}>{''.join(f'<p{y}>{rng.choice((para, sentence))()}</p>' for _ in range(rng.randint(1, 2)))}</{t}>"
        return f"<dl{y}>{''.join(f'<dt{y}>{words(1, 3)}<dd{y}>{sentence()}' for _ in range(rng.randint(1, 4)))}</dl>"

    def refs():
        one = lambda: rng.choice((f"{sentence()}", f"{words(1, 3)}. {link(2, 6)}", f'<a href="#r">^</a> <span{y}{cls("inline")}>{sentence()} {link()}</span>', link(2, 7)))
        return f"<h2{y}>{words(1, 1)}</h2><ol{y}{rng.choice(('', cls('refs')))}>" + "".join(f'<li{y} id="cite_note-{i}">{one()}</li>' for i in range(rng.randint(1, 6))) + "</ol>"

    def article(plain: bool):
        body = [block() for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.25:  # a very short article
            body = [f"<p{y}>{sentence(1, 6)}{end_p()}" for _ in range(rng.randint(1, 2))]
        if rng.random() < 0.07:  # no paragraphs but a sentence a div
            body = [f"<div{y}>{sentence(4, 16)}</div>" for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.04:  # a list is what the page is about
            body = [f"<{(t := rng.choice(('ul', 'ol')))}{y}>" + "".join(f"<li{y}>{rng.choice((link(1, 6), link(1, 6) + ' ' + sentence()))}</li>" for _ in range(rng.randint(3, 12))) + f"</{t}>"]
        if rng.random() < 0.06:  # no paragraphs: text between line breaks
            body = [f"{para()}<br><br>{para()}<br>"]
        if rng.random() < 0.1:
            body.append(refs())
        for make, odds in ((notice, 0.2), (side, 0.1), (form, 0.05)):
            if rng.random() < odds:
                body.insert(rng.randint(0, len(body)), make())
        title = f"<h1{y}{cls('title') if rng.random() < 0.25 else ''}>{words(2, 9)}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.2:  # the article's own header holds its title
            tag = rng.choice(("header", "header", "div"))
            title = f"<{tag}{y}{cls('own-head') if tag == 'div' or rng.random() < 0.6 else ''}>{title}</{tag}>"
        inner = title + "".join(body)
        if rng.random() < 0.2:
            inner = f"{title}<div{y}{cls('main')}>{''.join(body)}</div>"
        if rng.random() < 0.15:
            inner += foot()
        if rng.random() < 0.15:
            inner += comments()
        main = cls("main")
        if plain:
            return inner
        return rng.choice((f"<article{y}>{inner}</article>", f"<article{y}{main}>{inner}</article>", f"<main{y}>{inner}</main>", f"<main{y}><article{y}>{inner}</article></main>", f"<div{y}{main}>{inner}</div>", f"<div{y}{main}>{inner}</div>", f"<section{y}{main}>{inner}</section>", f"<div{y}>{inner}</div>", f"<table{y}><tr{y}><td>{rng.choice((menu, listed))()}</td><td{y}>{inner}</td></tr></table>", inner, inner))

    def loose():
        """Text that no element of its own holds."""
        return rng.choice((" | ".join(words(1, 2) for _ in range(rng.randint(3, 7))), " | ".join(link() for _ in range(rng.randint(3, 6))), f"{link()} &gt; {link()}", f"&copy; {words(1, 4)}", f"{words(1, 3)} {link()} {link()}"))

    def scriptless():
        """What a page says above its parts to those without scripts."""
        return f"<noscript>{rng.choice((sentence(), f'<p>{sentence()}</p>', f'<div{cls('notice')}>{sentence()}</div>'))}</noscript>"

    before = [make() for make, odds in ((scriptless, 0.05), (head, 0.8), (menu, 0.6), (notice, 0.6), (form, 0.2)) if rng.random() < odds]
    after = [make() for make, odds in ((side, 0.5), (comments, 0.4), (notice, 0.2), (form, 0.15), (foot, 0.8)) if rng.random() < odds]
    bare = rng.random() < 0.14  # nothing but the article
    if bare:
        before = after = []
    middle = article(bare and rng.random() < 0.6)
    if not bare and rng.random() < 0.3:
        middle = f"<div{y}{rng.choice(('', cls('wrap')))}>{''.join([side()] * (rng.random() < 0.4))}{middle}{''.join([side()] * (rng.random() < 0.4))}</div>"
    page, body_y = f"{''.join(before)}{middle}{''.join(after)}", y
    if not bare and rng.random() < 0.15 and middle.startswith(("<article", "<main", "<section", "<div")) and middle.endswith(("</article>", "</main>", "</section>", "</div>")):
        # directly in the body, which is not the article's own then
        page, body_y = rng.choice((f"{loose()} {page}", f"{page} {loose()}", f"{loose()} {page} {loose()}")), ""
    for _ in range(rng.choice((0, 0, 0, 1, 2)) if not bare else 0):
        page = f"<div{body_y}{rng.choice(('', cls('wrap')))}>{page}</div>"
    if rng.random() < 0.1:  # the whole page is one form
        page = f'<form{body_y} method=post action="/{words(1, 1)}" id="{rng.choice(("form1", words(1, 1), "aspnetForm"))}"><div><input type=hidden name=s></div>{page}</form>'
    return f"<!DOCTYPE html><html{y}><head><title>{words(2, 5)}</title></head><body{body_y}>{page}</body></html>"


def _labels(nodes: list[Node]) -> list[float]:
    """1 for nodes that carry the mark or hold one that does."""
    kept = ["data-y" in n.attrs for n in nodes]
    for n in reversed(nodes[1:]):
        kept[n.parent.number] |= kept[n.number]
    return [float(k or not i) for i, k in enumerate(kept)]


@dataclass
class Model:
    trees: Trees
    odds: np.ndarray

    def margin(self, pages: list[tuple[list[Node], int]]) -> np.ndarray:
        """Log odds of all nodes of some pages (nodes, length), one page after the other."""
        return self.trees.margin(np.concatenate([node_features(nodes, length, self.odds) for nodes, length in pages]))


@lru_cache(maxsize=1)
def model(pages: int = 3200, seed: int = 4) -> Model:
    """The trees and token odds, trained on pages made from the seed: the same in every process."""
    rng = random.Random(seed)
    made = [_page(rng) for _ in range(pages)]
    parsed = [parse(html)[0] for html in made]
    y = [v for nodes in parsed for v in _labels(nodes)]
    odds = token_odds(parsed, y)
    x = np.concatenate([node_features(nodes, len(html), odds) for nodes, html in zip(parsed, made)])
    return Model(Trees().fit(x, np.array(y)), odds)


def extract(html: str | None, by: Model | None = None) -> str:
    return extract_many([html], by)[0]


def extract_many(pages: list[str | None], by: Model | None = None) -> list[str]:
    """Main text of each page; nodes of all pages are scored together."""
    by = by or model()
    parsed = [parse_runs(h or "") for h in pages]
    if not parsed:
        return []
    margin = by.margin([(nodes, len(h or "")) for (nodes, _), h in zip(parsed, pages)])
    out, at = [], 0
    for nodes, runs in parsed:
        out.append(assemble(runs, decode(nodes, margin[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row: blocks of the main text in page order, two newlines between them.

    White space inside a block becomes one space; nothing else is dropped or cut. Null html counts as empty and gives an
    empty text, as does a page without main text. Repeated rows are extracted each; an empty table gives no rows; other
    columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model())  # some kB

    def run(batches):
        for b in batches:
            html, text = b.column(2), []
            for lo in range(0, b.num_rows, 64):
                text += extract_many(html.slice(lo, 64).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return spread(rows).mapInArrow(run, T.StructType([field(rows, "page_id"), field(rows, "url"), T.StructField("text", T.StringType())]))
