"""A small forgiving HTML tree: block elements as nodes, their text in page order.

Inline elements belong to the block that holds them; those with a name of their own (class, id, role and the like) are nodes too, and their text is told apart
inside its block. Text beside blocks, directly in their container, is a node "#text" for each run. Only scripts, styles, embedded media and
form controls have no text. Missing and misnested end tags are closed the way browsers do for the common cases.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html import unescape

#: Element names by their parsing rule.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("button script style template iframe textarea select svg audio video title noembed noframes annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark math meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Attributes that name an element: an inline element with one is a node.
NAMING = ("class", "id", "role", "itemprop", "aria-label")
NAMED = re.compile("|".join(NAMING), re.ASCII | re.IGNORECASE)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

NAME = re.compile(r"[A-Za-z][^\s/>\x00]*")
#: Searched in the page as it is: lower() may change its length (U+0130), and with it every position.
RAW_END = {tag: re.compile(f"</{tag}", re.ASCII | re.IGNORECASE) for tag in RAW}
#: The end of a tag, or a quote that begins a value.
TAG_STOP = re.compile(r""">|=\s*(["'])""")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "number", "own", "links", "start", "inline", "within")

    def __init__(self, tag, attrs, parent, number, start):
        self.tag, self.attrs, self.parent, self.number, self.start = tag, attrs, parent, number, start
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.own = self.links = self.inline = 0
        self.within = False  # an inline element
        if parent:
            parent.children.append(self)


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that begins before `at` ends: its ">" outside quoted values, or the end of the text. last: where each kind of quote stands last."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    i = at
    while m := TAG_STOP.search(html, i):
        if m[0] == ">":
            return m.start()
        close = html.find(m[1], m.end()) if m.end() <= last[m[1]] else -1
        if close < 0:  # a quote that never closes: the first ">" ends the tag
            return end
        i = close + 1
    return end


class Stack:
    """The open elements, and where in the stack those of each tag are: questions about tags don't walk the stack."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def top(self, *tags: str) -> int:
        """The place of the last open element with one of these tags; 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_above(self, tags, floor: int) -> int:
        """The lowest place above floor of an element with one of these tags; 0 without one."""
        found = [x[k] for t in tags if (x := self.at.get(t)) and (k := bisect_right(x, floor)) < len(x)]
        return min(found, default=0)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)}


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """(nodes, blocks): elements in page order, the root first; runs of text between block boundaries with the node that holds them."""
    nodes, runs = parse_runs(html)
    return nodes, [(node, joined(parts)) for node, parts in runs]


def joined(parts: list[tuple[Node, str]]) -> str:
    return " ".join("".join(t for _, t in parts).split())


def parse_runs(html: str) -> tuple[list[Node], list[tuple[Node, list[tuple[Node, str]]]]]:
    """(nodes, runs): as parse(), with each run in parts, each with the node that says it: the block or an inline node in it."""
    root = Node("#root", {}, None, 0, 0)
    stack = Stack(root)
    runs: list[tuple[Node, int, list[tuple[Node, str, int, int]], list[Node]]] = []  # holder, place, parts with their sizes and linked sizes, inline nodes
    run: list[tuple[Node, str, int, int]] = []
    made: list[Node] = []  # inline nodes of the run
    inlines: list[tuple[str, Node | None]] = []  # open inline elements of the current block, with the last node among them
    open_: Counter[str] = Counter()  # how many of each
    at, n, run_at = 0, len(html), 0
    last = {q: html.rfind(q) for q in "\"'"}

    def holder() -> Node:
        return inlines[-1][1] if inlines and inlines[-1][1] else stack.nodes[-1]

    def flush():
        if run or made:
            if any(size for _, _, size, _ in run):
                runs.append((stack.nodes[-1], run_at, list(run), list(made)))
            run.clear()
            made.clear()

    def say(raw: str, where: int):
        nonlocal run_at
        text = unescape(raw) if "&" in raw else raw
        if not run:
            run_at = where
        size = len(text.strip())
        run.append((holder(), text, size, size if open_["a"] else 0))

    def pop_to(k: int):
        flush()
        stack.cut(k)
        inlines.clear()
        open_.clear()

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:], at)
            break
        if lt > at:
            say(html[at:lt], at)
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            if html.startswith((">", "->"), lt + 4):  # an empty comment
                at = html.index(">", lt + 4) + 1
            else:
                at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = html.find("]]>", lt) if html.startswith("<![CDATA[", lt) else -1
            at = end + 3 if end >= 0 else n if (end := html.find(">", lt)) < 0 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(html, lt + 1 + closing)
        if not m:
            if closing:  # "</" with no name is a comment
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<", lt)
                at = lt + 1
            continue
        tag = m[0].lower()
        end = _tag_end(html, m.end(), last)
        at = end + 1
        # a formula's elements are parts of its line
        inline = tag in INLINE or (open_["math"] > 0 and tag not in CLOSES_P and tag not in RAW and tag not in VOID)
        if closing:
            if tag == "br":
                say(" ", lt)
            elif inline:
                if open_[tag]:
                    while True:
                        gone, _ = inlines.pop()
                        open_[gone] -= 1
                        if gone == tag:
                            break
            elif k := stack.top(tag):
                if tag not in ("div", "p", "li") or k > stack.top("table", "td", "th"):
                    pop_to(k)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if tag not in ("title",):
                say(" ", lt)
            if html[end - 1 : end] == "/" and tag == "svg":
                continue
            close = RAW_END[tag].search(html, at)
            if not close:
                at = n
            else:
                end = html.find(">", close.start())
                at = n if end < 0 else end + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input", "embed"):
                say(" ", lt)
            continue
        if inline:
            node = inlines[-1][1] if inlines else None
            if end > m.end() and NAMED.search(html, m.end(), end):
                attrs = attributes(html[m.end() : end])
                if any(attrs.get(k) for k in NAMING):
                    node = Node(tag, attrs, holder(), 0, lt)
                    node.within = True
                    made.append(node)
            inlines.append((tag, node))
            open_[tag] += 1
            stack.nodes[-1].inline += 1
            continue
        if tag in ("html", "body") and stack.top(tag):
            continue
        if tag == "body":
            if k := stack.first_above(("head",), 0):
                pop_to(k)
        elif tag in CLOSES_P:
            if (k := stack.top("p")) > stack.top("td", "th", "table"):
                pop_to(k)
        if tag in SIBLINGS:
            if k := stack.first_above(SIBLINGS[tag], stack.top(*SCOPE.get(tag, ("table",)))):
                pop_to(k)
        flush()
        inlines.clear()
        open_.clear()
        attrs = attributes(html[m.end() : end]) if end > m.end() else {}
        stack.push(Node(tag, attrs, stack.nodes[-1], 0, lt))
    flush()
    return _finished(root, runs)


def _finished(root: Node, runs) -> tuple[list[Node], list[tuple[Node, list[tuple[Node, str]]]]]:
    """Gives runs beside blocks a node of their own, sums sizes, and numbers all nodes in page order, parents first."""
    n_runs = Counter(id(block) for block, _, _, _ in runs)
    out = []
    for block, start, parts, made in runs:
        own = block
        if n_runs[id(block)] > 1 or any(not c.within for c in block.children if c.tag != "#text"):
            own = Node("#text", {k: v for k, v in block.attrs.items() if k.startswith("data-")}, block, 0, start)
            moved = {id(x) for x in made if x.parent is block}
            for x in made:
                if id(x) in moved:
                    x.parent = own
                    own.children.append(x)
        said = []
        for node, text, size, linked in parts:
            node = own if node is block else node
            node.own += size
            node.links += linked
            said.append((node, text))
        out.append((own, said))
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        x.number = len(nodes)
        x.depth = x.parent.depth + 1 if x.parent else 0
        nodes.append(x)
        x.children = sorted((c for c in x.children if c.parent is x), key=lambda c: c.start)
        todo += reversed(x.children)
    return nodes, out
