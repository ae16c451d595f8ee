"""Main text of web pages: boosted trees over DOM-node features with hierarchical decoding.

Each block element and text run of a page gets log odds of belonging to the article from boosted trees over its subtree's
density, its attribute tokens, depth, place and siblings. A choice of nodes is valid only if the parent of a chosen node
is chosen; the valid choice with the highest sum is found by one pass up the tree and one down, so an ancestor and a
descendant never contradict each other. The trees are trained on generated pages whose labels are known.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.boosting import Trees, fit_trees
from docgraph.llm.common import map_slices
from docgraph.llm.dom import MARK, TEXT, Node, attribute_tokens, parse

#: Attribute tokens that speak against and for the article.
AGAINST = frozenset(
    "ad ads advert advertisement adsense sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs header masthead footer foot sidebar aside rail widget "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup login form search share sharing social related recommended more comments comment reply replies discussion respond "
    "copyright legal disclaimer pagination pager tags toolbar skip topbar bottom".split()
)
FOR = frozenset("article content main body post entry story text page prose blog news articlebody maincontent".split())
GROUPS = {
    "p": 1, "h1": 2, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "ul": 4, "ol": 4, "dl": 4, "li": 5, "dt": 5, "dd": 5, "nav": 6, "menu": 6, "header": 7, "footer": 8, "aside": 9, "form": 10, "fieldset": 10,
    "article": 11, "main": 12, "section": 13, "div": 14, "table": 15, "tr": 15, "td": 15, "th": 15, "tbody": 15, "blockquote": 16, "pre": 16, "figure": 17, "figcaption": 17, "body": 18, "html": 18, "#page": 18, TEXT: 19, "address": 20, "center": 21,
}
DIGITS = re.compile(r"\d+")
YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
_BAD_TAGS = frozenset((6, 7, 8, 9, 10))
_CELLS, _ROWS, _DIVISION = frozenset(("td", "th")), frozenset(("table", "tbody", "thead", "tr")), GROUPS["div"]
N_FEATURES = 38


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node; an element's counts are those of its subtree."""
    n = len(nodes)
    out = np.zeros((n, N_FEATURES))
    total = max(1, nodes[0].chars)
    against, for_, inside_bad, inside_good, in_bad_tag, in_good_tag = ([0] * n for _ in range(6))
    group = [GROUPS.get(x.tag, 0) for x in nodes]
    for k in range(n - 1, 0, -1):  # a table whose cells hold blocks lays the page out: its parts are like divisions
        up = nodes[k].parent
        if nodes[up].tag in _CELLS and nodes[k].tag != TEXT or nodes[up].tag in _ROWS and group[k] == _DIVISION:
            group[up] = _DIVISION
    same: dict[tuple[int, str], int] = {}
    order: dict[int, int] = {}
    place = [0] * n
    for k, x in enumerate(nodes):
        same[x.parent, x.tag] = same.get((x.parent, x.tag), 0) + 1
        place[k] = order[x.parent] = order.get(x.parent, -1) + 1
    previous: dict[int, int] = {}
    for k, x in enumerate(nodes):
        up = x.parent
        if x.attrs:
            tokens = attribute_tokens(x.attrs)
            against[k], for_[k] = sum(t in AGAINST for t in tokens), sum(t in FOR for t in tokens)
        if up >= 0:
            inside_bad[k], inside_good[k] = inside_bad[up] or against[up], inside_good[up] or for_[up]
            in_bad_tag[k], in_good_tag[k] = in_bad_tag[up] or group[up] in _BAD_TAGS, in_good_tag[up] or group[up] in (11, 12)
        parent = nodes[up] if up >= 0 else x
        before = previous.get(up)
        prior = nodes[before] if before is not None else None
        previous[up] = k
        t = x.text
        g = group[k]
        out[k] = (
            g, group[up] if up >= 0 else 0, x.depth, x.chars, x.link_chars / max(1, x.chars), x.tags, x.chars / (1 + x.tags), x.children,
            x.chars / max(1, parent.chars), x.chars / total, place[k] / max(1, parent.children - 1), parent.children, same[up, x.tag],
            x.begin / total, (x.begin + x.chars) / total, against[k], for_[k], inside_bad[k] > 0, inside_good[k] > 0, in_bad_tag[k], in_good_tag[k],
            t.count(",") + t.count("."), len(t.split()) if t else 0, len(t) - len(DIGITS.sub("", t)), g in _BAD_TAGS, g in (11, 12), g == 1, g in (2, 3),
            parent.link_chars / max(1, parent.chars), prior.chars if prior else -1, prior.link_chars / max(1, prior.chars) if prior else -1,
            group[before] if before is not None else -1, against[before] if before is not None else 0, "©" in t,
            x.rules, nodes[-1].rules - x.rules, x.rules > (prior.rules if prior else parent.rules), bool(YEAR.search(t)),
        )
    return out


def context(scores: np.ndarray, parents: np.ndarray, leaves: np.ndarray, chars: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """What the first trees think of a node's surroundings, one row a node: its parent and its siblings before and after, and how
    much of the page's article they see before it. ``parents`` and ``pages`` number nodes and pages of the whole slice."""
    n = len(scores)
    out = np.zeros((n, 14))
    if not n:
        return out
    order = np.argsort(parents, kind="stable")
    s, family = scores[order], parents[order]
    begins = np.append(True, family[1:] != family[:-1])
    group = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, n))
    place, rest = np.arange(n) - first[group], size[group] - 1 - (np.arange(n) - first[group])
    none = -9.0

    def shifted(k: int) -> np.ndarray:
        moved = np.full(n, none)
        at = np.arange(n) + k
        inside = (at >= 0) & (at < n)
        moved[inside] = np.where(group[at[inside]] == group[inside], s[at[inside]], none)
        return moved

    chosen = (s > 0).astype(np.float64)
    upto = np.cumsum(chosen)
    start = upto[first] - chosen[first]
    before = upto - chosen - start[group]
    total = np.add.reduceat(chosen, first)[group]
    apart = 1000.0 * group
    most = np.maximum.accumulate(s + apart) - apart
    back = 1000.0 * group[::-1].max() - 1000.0 * group[::-1]
    most_after = (np.maximum.accumulate(s[::-1] + back) - back)[::-1]
    by_group = np.stack([
        shifted(-1), shifted(1), shifted(-2), shifted(2), before, total - before - chosen, (np.add.reduceat(s, first) / size)[group],
        np.where(place > 0, np.append(none, most[:-1]), none), np.where(rest > 0, np.append(most_after[1:], none), none),
    ], 1)
    out[order, :9] = by_group
    out[:, 9] = scores
    out[:, 10] = np.where(parents >= 0, scores[np.maximum(parents, 0)], none)
    weight = np.where(leaves & (scores > 0), chars, 0).astype(np.float64)
    sofar = np.cumsum(weight)
    edge = np.append(0, np.flatnonzero(np.diff(pages)) + 1)
    of_page = np.cumsum(np.append(0, np.diff(pages) > 0))
    base = (sofar - weight)[edge][of_page]
    whole = np.maximum(np.add.reduceat(weight, edge)[of_page], 1)
    out[:, 11], out[:, 12] = (sofar - weight - base) / whole, weight / whole
    at = np.flatnonzero(leaves)
    if len(at):
        same = np.append(False, pages[at[1:]] == pages[at[:-1]])
        out[at, 13] = np.where(same, np.append(none, scores[at[:-1]]), none)
    return out


@dataclass
class Model:
    """Trees over a node's own features, and trees that see their opinion of its surroundings as well."""

    own: Trees
    around: Trees

    def scores(self, pages: list[list[Node]]) -> np.ndarray:
        """Log odds of all nodes of ``pages``."""
        if not pages:
            return np.zeros(0)
        x = np.concatenate([features(nodes) for nodes in pages])
        return self.around.scores(np.hstack([x, around(self.own.scores(x), pages)]))


def around(scores: np.ndarray, pages: list[list[Node]]) -> np.ndarray:
    sizes = [len(nodes) for nodes in pages]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = [x for nodes in pages for x in nodes]
    page = np.repeat(np.arange(len(pages)), sizes)
    up = np.array([x.parent for x in flat])
    parents = np.where(up >= 0, up + offsets[page], -1 - page)
    return context(scores, parents, np.array([x.tag == TEXT for x in flat]), np.array([x.chars for x in flat]), page)


def decode(scores: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """The valid choice with the highest sum of log odds. A choice without a text run is empty."""
    gain = scores.copy()
    gain[0] += 1e9  # the page itself is always chosen
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag != TEXT and not nodes[k].chars:
            gain[k] = -1.0
        if gain[k] > 0:
            gain[nodes[k].parent] += gain[k]
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = True
    for k in range(1, len(nodes)):
        chosen[k] = chosen[nodes[k].parent] and gain[k] > 0
    return chosen


def extract(pages: list[str | None], model: Model) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    scores = model.scores(parsed)
    out, at = [], 0
    for nodes in parsed:
        chosen = decode(scores[at : at + len(nodes)], nodes)
        at += len(nodes)
        out.append(" ".join(x.text for x, y in zip(nodes, chosen) if y and x.tag == TEXT))
    return out


#: Names that sites give to the parts of a page, by kind; some pages use invented names instead.
NAMES = {
    "nav": ["nav", "menu", "navbar", "links", "topnav", "breadcrumb", "tabs"], "header": ["header", "masthead", "top", "brand", "banner", "site-title"],
    "footer": ["footer", "foot", "credits", "copyright", "legal", "colophon"], "aside": ["sidebar", "widget", "related", "rail", "more", "recommended", "secondary"],
    "ad": ["ad", "ads", "advert", "sponsor", "promo", "sponsored", "advertisement"], "notice": ["cookie", "notice", "consent", "alert", "message", "popup", "gdpr"],
    "form": ["search", "subscribe", "login", "contact", "signup", "newsletter"], "comments": ["comments", "discussion", "replies", "responses", "thread", "respond"],
    "main": ["content", "main", "post", "entry", "story", "article", "text", "post-body", "entry-content", "page"],
}
FAMILIES = ("semantic", "classes", "ids", "manual", "tables", "bare", "grid")
SHARES = {"semantic": 5, "classes": 3, "ids": 2, "manual": 2, "tables": 1.5, "bare": 1.5, "grid": 1.5}
#: Class names that say how wide a part is and nothing of what it holds.
COLUMNS = ["col-8", "col-md-9", "span8", "col-4", "col-md-3", "row", "container", "col", "unit", "grid-6", "cell", "box", "left", "right", "center", "wide", "w-50", "layout-2"]
MONTHS = "January March May 3. Mai juin 12 de abril agosto".split()


class Pages:
    """Generated pages with labels, in families of layouts: sectioning elements, divisions with classes or with ids, tables
    used for layout, manuals with long side menus and code, columns named by their width, and bare pages. The words are invented."""

    def __init__(self, seed: int, families: tuple[str, ...] = FAMILIES) -> None:
        self.r, self.families = random.Random(seed), families
        syllables = "an ar be co da de el en er es ge ha il in is ka la le li lo ma me mi na ne no on or pa qu ra re ri ro sa se sh si so ta te th ti to ue ur va ve vi za zu é ü ñ".split()
        self.words = ["".join(self.r.choices(syllables, k=self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(3000)]

    def sentence(self, least: int = 3, most: int = 24) -> str:
        words = [w + "," if self.r.random() < 0.1 else w for w in self.r.choices(self.words, k=self.r.randint(least, most))]
        words = [w.upper() if self.r.random() < 0.01 else w for w in words]
        return " ".join(words).capitalize() + self.r.choice(".......!?:")

    def title(self, least: int = 1, most: int = 7) -> str:
        return self.sentence(least, most)[:-1]

    def prose(self, most: int = 6) -> str:
        text = " ".join(self.sentence(self.r.choice((1, 3))) for _ in range(self.r.randint(1, most))) if self.r.random() < 0.82 else self.sentence(1, self.r.choice((1, 2, 5)))
        kind = self.r.random()
        if kind < 0.12:
            text += f' <a href="/{self.r.choice(self.words)}">{self.title(1, 4)}</a> {self.sentence()}'
        elif kind < 0.2:
            text = self.r.choice(("<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<strong>{}</strong> ")).format(text)
        elif kind < 0.25:
            text = text.replace(" ", self.r.choice(("&nbsp;", " &amp; ", "<br>", " &mdash; ")), 1)
        return text

    def maybe(self, p: float, text: str) -> str:
        return text if self.r.random() < p else ""

    def link(self) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.title(1, 4)}</a>'

    def links(self, n: int, nested: bool = False) -> str:
        kind = self.r.random()
        if nested or kind < 0.7:
            end = self.r.choice(("</li>", "</li>", ""))
            return "<ul>" + "".join(f"<li>{self.link()}{self.links(self.r.randint(1, 3)) if nested and self.r.random() < 0.3 else ''}{end}" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ", "<br>", " &raquo; ")).join(self.link() for _ in range(n))

    def inner(self, kind: str) -> str:
        """What a part of the page that is no article holds."""
        r = self.r
        short = lambda: r.choice((self.sentence(2, 14), f"<p>{self.sentence(3, 30)}</p>"))
        if kind == "nav":
            return self.links(r.randint(2, 9))
        if kind == "header":
            return self.maybe(0.5, f"<h{r.randint(1, 3)}>{self.title(1, 4)}</h1>") + self.maybe(0.5, self.links(4)) + self.maybe(0.6, short()) or self.title()
        if kind == "footer":
            return self.maybe(0.5, r.choice(("&copy; ", "&#169; 2020 ", "Copyright "))) + self.title(1, 5) + " " + self.maybe(0.7, short()) + self.maybe(0.5, self.links(3))
        if kind == "aside":
            return self.maybe(0.6, f"<h3>{self.title(1, 3)}</h3>") + r.choice((self.links(4), short(), short() + self.links(3), f"<p>{self.prose(3)}</p>"))
        if kind == "ad":
            return r.choice((short(), self.prose(2), f'<a href="/x">{self.sentence()}</a>', f"<h4>{self.title(1, 3)}</h4>{short()}"))
        if kind == "notice":
            return short() + self.maybe(0.4, f"<button>{self.title(1, 2)}</button>") + self.maybe(0.2, self.link())
        if kind == "form":
            return f"<label>{self.title(1, 4)}</label><input name=q>{self.maybe(0.5, short())}{self.maybe(0.3, '<select><option>a<option>b</select>')}<button>{self.title(1, 2)}</button>"
        one = r.choice(("<div{}>{}</div>", "<li{}>{}</li>", "<article{}>{}</article>", "<p{}>{}</p>"))
        body = lambda: self.maybe(0.5, f"<b>{r.choice(self.words)}</b> ") + (self.sentence() if one[1] == "p" else f"<p>{self.prose(3)}</p>")
        return self.maybe(0.6, f"<h3>{self.title(1, 3)}</h3>") + "".join(one.format(r.choice(("", ' class="comment"', ' class="reply"')), body()) for _ in range(r.randint(1, 5)))

    def name(self, kind: str) -> str:
        base = self.r.choice(NAMES[kind] if self.r.random() < 0.97 else self.words)
        return self.r.choice((base, base, f"{base}-{self.r.choice(self.words)}", f"site-{base}", f"{base}{self.r.randint(1, 9)}", base.capitalize(), f"{self.r.choice(self.words)} {base}"))

    def part(self, family: str, kind: str) -> str:
        """A part that is no article, in a family's way."""
        inner = self.inner(kind)
        if kind == "form":
            return f'<form{self.maybe(0.6, f""" class="{self.name(kind)}" """)} data-main="0">{inner}</form>'
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "comments": "section"}.get(kind, "div") if family in ("semantic", "manual") else "div"
        if kind == "notice" and self.r.random() < 0.3:
            tag = self.r.choice(("section", "p"))
        if kind == "ad" and self.r.random() < 0.25:
            tag = self.r.choice(("aside", "section", "ins"))
        if family in ("tables", "bare") and kind in ("nav", "aside", "header", "footer"):
            if family == "tables":
                return f'<table data-main="0"{self.maybe(0.5, " width=100%")}><tr><td{self.maybe(0.4, " bgcolor=#eee")}>{inner}</table>'
            if kind == "footer" and self.r.random() < 0.6:
                line = self.r.choice((f"Last {self.r.choice(('changed', 'updated', 'modified'))} {self.date()}", f"last changed {self.r.randint(1995, 2025)}", f"{self.title(1, 3)} {self.links(1)}", self.links(3), f"&copy; {self.title(1, 3)}"))
                return "<hr>" + self.r.choice(('<address data-main="0">{}</address>', '<p data-main="0">{}</p>', '<center data-main="0">{}</center>', '<p data-main="0"><i>{}</i></p>', '<div data-main="0"><small>{}</small></div>')).format(line)
            if kind == "nav" and self.r.random() < 0.5:
                return f'<{(tag := self.r.choice(("p", "center", "div")))} data-main="0">{self.r.choice((" | ", " ", " - ")).join(self.link() for _ in range(self.r.randint(2, 7)))}</{tag}>' + self.maybe(0.5, "<hr>")
            return self.r.choice(('<{0} data-main="0">{1}</{0}>', '<hr><{0} data-main="0">{1}</{0}>')).format(self.r.choice(("nav" if kind == "nav" else "div", kind if kind != "nav" else "ul")), inner)
        if family == "grid" and kind in ("nav", "aside", "header", "footer"):
            return f'<{(tag := self.r.choice(("div", "div", "div", "section")))} class="{self.r.choice(COLUMNS)}" data-main="0">{inner}</{tag}>'
        needs = tag in ("div", "section", "p", "ins")
        label = f' {"id" if family == "ids" else "class"}="{self.name(kind)}"' if needs or self.r.random() < 0.4 else ""
        return f'<{"div" if tag == "ins" else tag}{label} data-main="0">{inner}</{"div" if tag == "ins" else tag}>'

    def date(self) -> str:
        return f"{self.r.randint(1, 28)} {self.r.choice(MONTHS)} {self.r.randint(1995, 2025)}"

    def byline(self) -> str:
        r = self.r
        who = f"{r.choice(('By', 'by', 'Von', 'Par', 'Por', 'Posted by', 'Written by'))} {self.title(1, 2)}"
        line = r.choice((who, f"{who}, {self.date()}", f"{who} | {self.date()}", self.date(), f"{who} &middot; {r.randint(2, 20)} min"))
        return r.choice(('<p{1} data-main="1">{0}</p>', '<div{1} data-main="1">{0}</div>', '<address data-main="1">{0}</address>', '<p data-main="1"><em>{0}</em></p>')).format(line, self.maybe(0.5, f' class="{r.choice(("byline", "meta", "author", "date", "info"))}"'))

    def code(self) -> str:
        r = self.r
        lines = [" " * r.choice((0, 0, 2, 4)) + r.choice(("{} = {}({})", "{} {} --{}", "$ {} {} {}", "if {} &lt; {}: {}", "{}.{}({});")).format(*r.choices(self.words, k=3)) for _ in range(r.randint(1, 9))]
        return f'<pre data-main="1">{self.maybe(0.3, "<code>")}' + "\n".join(lines) + "</pre>"

    def article(self, family: str) -> str:
        r, title = self.r, self.title(2, 12)
        blocks = [self.maybe(0.9, f'<h{r.choice((1, 1, 1, 2))} data-main="1">{title}</h1>'), self.maybe(0.25, self.byline())]
        for _ in range(r.choice((0, 1, 2, 3, 3, 4, 5, 6, 9, 14))):
            kind = r.random()
            if family == "manual" and r.random() < 0.25:
                blocks.append(self.code())
                continue
            if kind < 0.7:
                blocks.append(f'<p data-main="1">{self.prose()}' + self.maybe(0.8, "</p>"))
            elif kind < 0.78:
                blocks.append(f'<h{r.randint(2, 4)} data-main="1">{self.title()}</h2>')
            elif kind < 0.85:
                blocks.append('<ul data-main="1">' + "".join(f"<li>{self.sentence()}{self.maybe(0.7, '</li>')}" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.88:
                blocks.append(f'<blockquote data-main="1"><p>{self.prose(3)}</p></blockquote>')
            elif kind < 0.91:
                blocks.append(f'<div data-main="1">{self.prose()}</div>')
            elif kind < 0.94:
                blocks.append(f'<p data-main="1"><b>{self.prose(2)}<br>')  # never closed
            elif kind < 0.97 or family == "manual":
                blocks.append(r.choice((f'<pre data-main="1">{self.title()}\n  {self.title()}</pre>', f'<dl data-main="1"><dt>{self.title()}<dd>{self.sentence()}</dl>', f'<table data-main="1"><tr><th>{self.title()}<td>{self.title()}</table>')))
            else:
                blocks.append(f'<figure data-main="1"><img src=x><figcaption>{self.sentence()}</figcaption></figure>')
            if r.random() < 0.12:
                blocks.append(self.part(family, r.choice(("ad", "aside", "notice", "form"))))
        if not any(blocks):
            blocks = [f'<p data-main="1">{self.prose()}</p>']
        return "".join(blocks) + self.maybe(0.12, self.part(family, "comments")) + self.maybe(0.08, self.part(family, "aside"))

    def page(self) -> str:
        r = self.r
        family = r.choices(self.families, [SHARES[f] for f in self.families])[0]
        inner = self.article(family)
        if family in ("semantic", "manual"):
            main = r.choice(("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<article class="{1}">{0}</article>')).format(inner, self.name("main"))
        elif family in ("classes", "ids"):
            main = f'<div {"id" if family == "ids" else "class"}="{self.name("main")}">{inner}</div>'
        elif family == "grid":
            main = f'<div class="{r.choice(COLUMNS)}">{inner}</div>'
        else:
            main = f"<table><tr><td>{inner}</table>" if family == "tables" else inner
        if r.random() < 0.12:  # in any layout the article may have nothing around it, or something without a name
            main = r.choice(("{}", "<div>{}</div>", '<div class="{1}">{0}</div>')).format(inner, r.choice(COLUMNS))
        for _ in range(r.choice((0, 0, 1, 2))):
            main = f'<div class="{r.choice(("wrapper", "container", "layout", "inner", r.choice(self.words)))}">{main}</div>'
        before = [self.part(family, k) for k, p in (("header", 0.35), ("nav", 0.8), ("notice", 0.3), ("ad", 0.5), ("form", 0.25), ("aside", 0.3)) if r.random() < p]
        if family == "manual":
            before.append(f'<div class="{self.name("aside")}" data-main="0">{self.links(r.randint(6, 25), True)}</div>')
        after = [self.part(family, k) for k, p in (("comments", 0.35), ("aside", 0.25), ("ad", 0.25), ("nav", 0.2), ("form", 0.2), ("notice", 0.2), ("footer", 0.85)) if r.random() < p]
        if r.random() < 0.5:
            r.shuffle(before)
        if r.random() < 0.1:
            before = []
        script = self.maybe(0.5, f"<script>var a = '<p>{r.choice(self.words)}</p>' < 2;</script>") + self.maybe(0.3, "<!-- x > y -->")
        return f"<!DOCTYPE html><html><head><title>{self.title()}</title>{script}</head><body>{''.join(before)}{main}{script}{''.join(after)}</body></html>"


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for text runs under a mark for the article, and for elements that hold one."""
    y = np.zeros(len(nodes))
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag == TEXT and nodes[k].mark:
            y[k] = 1
        if y[k]:
            y[nodes[k].parent] = 1
    return y


def generated(n: int, seed: int, families: tuple[str, ...] = FAMILIES) -> list[tuple[str, str]]:
    """(page without marks, main text)."""
    maker, out = Pages(seed, families), []
    for _ in range(n):
        page = maker.page()
        nodes = parse(page, True)
        out.append((MARK.sub("", page), " ".join(x.text for x in nodes if x.tag == TEXT and x.mark)))
    return out


@lru_cache(maxsize=2)
def trained(n_pages: int = 1600, seed: int = 5, families: tuple[str, ...] = FAMILIES) -> Model:
    """Trees from ``n_pages`` generated pages; the same on every call."""
    maker = Pages(seed, families)
    pages = [parse(maker.page(), True) for _ in range(n_pages)]
    x, y = np.concatenate([features(nodes) for nodes in pages]), np.concatenate([labels(nodes) for nodes in pages])
    weight = np.concatenate([[1.0 if n.tag == TEXT else 0.7 for n in nodes] for nodes in pages])
    own = fit_trees(x, y, weight, n_trees=30, rate=0.3, sample=0.4)
    return Model(own, fit_trees(np.hstack([x, around(own.scores(x), pages)]), y, weight, n_trees=110, depth=5, rate=0.15, sample=0.4))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Null or blank html, and pages without an article, have an empty text. White space, references to it included,
    becomes one space. Null page_id and url stay null; repeated rows are read one by one; other columns are not read.
    An empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def read(batch: pa.RecordBatch) -> dict:
        texts = extract(batch.column("html").to_pylist(), shared.value)
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_slices(rows, read, "page_id long, url string, text string, n_chars long", text="html", limit=2 << 20)
