"""A small document tree over the standard library's HTML parser, for extraction and for corrections.

Missing end tags of paragraphs, list items, cells and the like are implied by
what follows; void elements have no content; an end tag without its start is
left out. Paths name every step by its place among the siblings of its tag.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "template", "noscript"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset((*HEADINGS, "p", "li", "td", "th", "blockquote", "pre", "figcaption", "caption", "dt", "dd", "div", "section", "article", "main", "header", "footer", "nav", "aside", "address", "summary", "label"))
CHROME = frozenset(("header", "nav", "footer", "aside"))
#: Start tags that end an open element of these tags, up to the nearest of the fence.
_ENDS = {
    "li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
_ENDS_P = frozenset((*HEADINGS, "p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "aside", "main", "figure", "blockquote", "pre", "form", "hr"))

#: An ampersand, with the reference where a semicolon ends one.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


class Node:
    """An element with its children: other nodes, texts, and comments as ``Comment``."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.elements() if n.tag in tags), None)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        """Text of all that is below, white space collapsed."""
        out, stack = [], [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    if c.tag not in RAW and c.tag not in skip:
                        stack.append(iter(c.children))
                        break
                elif not isinstance(c, Comment):
                    out.append(c)
            else:
                stack.pop()
                out.append(" ")
        return " ".join("".join(out).split())

    def own_text(self) -> str:
        """Text without that of blocks inside, so that no text is counted twice."""
        return self.text(BLOCKS)

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def detach(self) -> Node:
        del self.parent.children[self.index()]
        self.parent = None
        return self

    def insert(self, at: int, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.insert(at, child)

    def append(self, child: Node | str) -> None:
        self.insert(len(self.children), child)

    def after(self, child: Node) -> None:
        self.parent.insert(self.index() + 1, child)

    def before(self, child: Node) -> None:
        self.parent.insert(self.index(), child)


class Comment(str):
    """Text of a comment, or of a declaration where it begins with ``!``."""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in fence:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in _ENDS_P:
            self._close(("p",), ("table", "td", "th", "li", "button", "div", "section", "article"))
        if tag == "body":
            self._close(("head",), ())
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(Comment(data))

    def handle_decl(self, decl: str) -> None:
        self.open[-1].children.append(Comment("!" + decl))


def parse(markup: str | None, closed: bool = False) -> Node:
    """The document's tree; null and empty markup give an empty one. With ``closed`` only character references that end with a semicolon count, others stay as they are written."""
    markup, mark = markup or "", None
    if closed:
        # Ampersands of open references pass the parser as a character that the markup doesn't have.
        mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in markup)
        markup = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], markup)
    b = _Builder()
    b.feed(markup)
    b.close()
    if mark is not None:
        for n in (b.root, *b.root.elements()):
            n.tag, n.attrs = n.tag.replace(mark, "&"), {k.replace(mark, "&"): v.replace(mark, "&") for k, v in n.attrs.items()}
            n.children = [c if isinstance(c, Node) else type(c)(c.replace(mark, "&")) for c in n.children]
    return b.root


def body(root: Node) -> Node:
    return root.find("body") or root


def paths(root: Node) -> dict[int, str]:
    """Path of every element by its identity: ``html > body:nth-of-type(1) > p:nth-of-type(2)``."""
    out: dict[int, str] = {}
    stack = [(root, "")]
    while stack:
        node, at = stack.pop()
        seen: dict[str, int] = {}
        for c in node.children:
            if isinstance(c, Node):
                seen[c.tag] = seen.get(c.tag, 0) + 1
                step = "html" if c.tag == "html" else f"{c.tag}:nth-of-type({seen[c.tag]})"
                out[id(c)] = f"{at} > {step}" if at and c.tag != "html" else step
                stack.append((c, out[id(c)]))
    return out


def visible(node: Node) -> bool:
    """Neither the element nor what it is in is hidden by an attribute or an inline style."""
    for n in (node, *node.ancestors()):
        style = re.sub(r"\s", "", n.attrs.get("style", "")).lower()
        if "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or any(x in style for x in ("display:none", "visibility:hidden", "opacity:0")):
            return False
    return True


def serialize(root: Node) -> str:
    """The tree as markup."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(f"</{x[0]}>")
        elif isinstance(x, Comment):
            out.append(f"<{x}>" if x.startswith("!") else f"<!--{x}-->")
        elif isinstance(x, Node):
            if x.tag != "[document]":
                out.append("<" + x.tag + "".join(f' {k}="{_html.escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag in VOID:
                    continue
                stack.append((x.tag,))
            if x.tag in ("script", "style"):
                out += [c for c in x.children if isinstance(c, str)]
            else:
                stack += reversed(x.children)
        else:
            out.append(_html.escape(x, quote=False))
    return "".join(out)
