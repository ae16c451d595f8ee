"""A small forgiving HTML tree: block elements and the text runs between them, with counts for features."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![^\s"'=<>/])([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts, styles, titles and text fields: all up to their end tag is no markup, and is dropped.
RAW = frozenset("script style textarea title".split())
RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
#: Controls of forms, and templates: dropped with their contents. A control that is not closed ends with the next block.
DROPPED = frozenset("button select datalist template".split())
#: Tags without an element of their own here; what is inside belongs to what is around.
CLEAR = frozenset("html head body noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Blocks that no control of a form holds.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 article section main header footer nav aside form ul ol dl table blockquote pre".split())
#: Start tag -> open elements that it closes, unless one of the other set is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class Node:
    __slots__ = ("tag", "parent", "attrs", "text", "chars", "link_chars", "tags", "children", "depth", "mark", "begin", "rules")

    def __init__(self, tag: str, parent: int, attrs: str, depth: int, begin: int, rules: int = 0) -> None:
        self.tag, self.parent, self.attrs, self.depth, self.begin, self.rules = tag, parent, attrs, depth, begin, rules
        self.text, self.chars, self.link_chars, self.tags, self.children, self.mark = "", 0, 0, 0, 0, None


TEXT = "#text"


def markup(page: str) -> Iterator[tuple[str | None, str, str, bool]]:
    """(text before, tag, attributes, whether it is an end tag) of each tag, and (rest, "", "", False) at the end.

    One scan forward. Comments and declarations are skipped, a < that begins no tag is text. A quote opens an attribute's
    value after = alone and only if it is closed again. What nothing ends goes with the rest: a tag as text, a comment, a
    script or a style as nothing; the start tag of another raw element without end is passed over.
    """
    at, begin, end, text, gone = 0, 0, len(page), [], set()
    quoted = True  # whether tags end outside of quotes from here on
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", at)
            stop = page.find("-->", at + 2) if comment else page.find("]]>", at) if page.startswith("<![CDATA[", at) else page.find(">", at)
            text.append(page[begin:at])
            at = begin = end if stop < 0 else stop + (1 if page[stop] == ">" else 3)
            continue
        m = NAME.match(page, at + 1 + (after == "/"))
        if not m:
            at += 1
            continue
        stop, look = -1, m.end()
        while quoted:
            mark = QUOTE_OR_END.search(page, look)
            if not mark:
                quoted = False
                break
            look = mark.end()
            if mark[0] == ">":
                stop = mark.start()
                break
            back = mark.start() - 1
            while page[back].isspace():
                back -= 1
            if page[back] == "=" and (close := page.find(mark[0], look)) >= 0:
                look = close + 1
        if stop < 0:
            stop = page.find(">", m.end())
            if stop < 0:
                break
        text.append(page[begin:at])
        tag = m[0].lower()
        yield "".join(text), tag, page[m.end() : stop], after == "/"
        text = []
        at = begin = stop + 1
        if tag in RAW and after != "/":
            ended = None if tag in gone else RAW_END[tag].search(page, at)
            if ended:
                close = page.find(">", ended.end())
                at = begin = end if close < 0 else close + 1
            elif tag in ("script", "style"):
                at = begin = end
            else:
                gone.add(tag)
    yield "".join(text) + page[begin:], "", "", False


class Block:
    """An open block: its tag, its node, the inline elements that are open in it, and how many of each tag."""

    __slots__ = ("tag", "node", "inline", "count")

    def __init__(self, tag: str, node: int) -> None:
        self.tag, self.node, self.inline, self.count = tag, node, [], Counter()


MARK = re.compile(r'\s*data-main="([01])"')


def parse(page: str, marked: bool = False) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the page. Text runs are leaves tagged TEXT.

    References are decoded piece by piece, so none comes about where markup stood. Time is in proportion to the page's
    length: open elements are looked up by tag, never searched for. ``marked``: the page is a generated one whose labels
    are attributes; in others an attribute of that name is one like any other.
    """
    nodes = [Node("#page", -1, "", 0, 0)]
    stack = [Block("#page", 0)]
    open_at: dict[str, list[int]] = {}  # places in the stack of the open blocks of each tag
    run: list[str] = []
    seen = links = link_chars = rules = 0
    skip: str | None = None
    skip_depth = 0

    def flush() -> None:
        nonlocal run, seen, link_chars
        if run:
            text = " ".join("".join(run).split())
            if text:
                at = stack[-1].node
                leaf = Node(TEXT, at, "", nodes[at].depth + 1, seen, rules)
                leaf.text, leaf.chars, leaf.link_chars = text, len(text), min(link_chars, len(text))
                leaf.mark = nodes[at].mark
                nodes[at].children += 1
                nodes.append(leaf)
                seen += len(text)
        run, link_chars = [], 0

    def close(k: int) -> None:
        """The block at place ``k`` and all in it."""
        nonlocal links
        flush()
        while len(stack) > k:
            block = stack.pop()
            open_at[block.tag].pop()
            links -= block.count["a"]

    for text, tag, attrs, closing in markup(page):
        if skip is not None:
            if tag == skip:
                skip_depth = skip_depth - 1 if closing else skip_depth + 1 if tag == "template" else skip_depth
                skip = skip if skip_depth else None
                continue
            if not tag or skip == "template" or not (tag in BLOCKS if not closing else open_at.get(tag)):
                continue
            skip = None  # a control that is not closed
        elif text:
            run.append(html.unescape(text))
            if links:
                link_chars += len(run[-1].strip())
        if not tag:
            break
        block = stack[-1]
        if tag in CLEAR or tag in RAW:
            if tag in CLEAR:
                flush()
            continue
        if tag in DROPPED:
            if not closing and not attrs.endswith("/") and (tag != "template" or "</template" in page):
                skip, skip_depth = tag, 1
            continue
        if tag in VOID:
            if tag == "hr":  # a rule divides blocks; it stands in a paragraph only if that was not closed
                if stack[-1].tag == "p":
                    close(len(stack) - 1)
                flush()
                rules += 1
                block = stack[-1]
            elif tag == "br":
                run.append(" ")
            nodes[block.node].tags += 1
            continue
        if tag in INLINE:
            if not closing:
                nodes[block.node].tags += 1
                block.inline.append(tag)
                block.count[tag] += 1
                links += tag == "a"
            elif block.count[tag]:
                while True:
                    last = block.inline.pop()
                    block.count[last] -= 1
                    links -= last == "a"
                    if last == tag:
                        break
            continue
        if closing:
            if open_at.get(tag):
                close(open_at[tag][-1])
            else:
                flush()
            continue
        flush()
        if stack[-1].tag == "p":  # a block start tag ends an open paragraph
            close(len(stack) - 1)
        if tag in CLOSES:
            shut, scope = CLOSES[tag]
            low = max((open_at[t][-1] for t in scope if open_at.get(t)), default=0)
            found = [places[bisect_right(places, low)] for t in shut if (places := open_at.get(t)) and places[-1] > low]
            if found:
                close(min(found))
        parent = stack[-1].node
        nodes[parent].children += 1
        nodes[parent].tags += 1
        mark = nodes[parent].mark
        if marked and (label := MARK.search(attrs)):  # holds for what is inside
            mark = label[1] == "1"
            attrs = MARK.sub("", attrs)
        nodes.append(Node(tag, parent, attrs, nodes[parent].depth + 1, seen, rules))
        nodes[-1].mark = mark
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(Block(tag, len(nodes) - 1))
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.chars += node.chars
        up.link_chars += node.link_chars
        up.tags += node.tags
    return nodes


def attribute_tokens(attrs: str) -> list[str]:
    """Lower-case pieces of class, id and role values, cut at non-letters and at inner capitals."""
    out: list[str] = []
    for m in ATTRIBUTE.finditer(attrs):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
            value = m[2] or m[3] or m[4] or ""
            out += [t.lower() for t in re.findall(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])", value)]
    return out
