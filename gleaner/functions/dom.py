"""A small document tree over the standard library's HTML parser, for extractors that need structure.

Forgiving like browsers in what matters here: void elements have no content, paragraphs, list items, table cells and the like
end where the next one begins, stray end tags are ignored, and whatever is open at the end is closed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Tags that an opening tag ends, and those that shield what is outside of them.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())} | {tag: ({"p"}, {"button", "td", "th", "li"}) for tag in _BLOCKS}


class Node:
    """An element. Elements lie in document order in ``order``, those below it between ``at + 1`` and ``end``."""

    __slots__ = ("tag", "attrs", "children", "parent", "elements", "order", "at", "end", "place")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent, self.elements = tag, attrs, [], parent, []
        self.order: list[Node] = parent.order if parent else []
        self.at, self.end, self.place = len(self.order), None, len(parent.elements) if parent else 0
        self.order.append(self)
        if parent:
            parent.children.append(self)
            parent.elements.append(self)

    def walk(self) -> list[Node]:
        """Elements below this one, in document order."""
        return self.order[self.at + 1 : self.end]

    def all(self, fits: str | Callable[[Node], bool]) -> list[Node]:
        """Elements with one of these tags, or that fit."""
        if isinstance(fits, str):
            tags = frozenset(fits.split())
            return [n for n in self.walk() if n.tag in tags]
        return [n for n in self.walk() if fits(n)]

    def first(self, fits: str | Callable[[Node], bool]) -> Node | None:
        below = self.order[self.at + 1 : self.end]
        if isinstance(fits, str):
            return next((n for n in below if n.tag == fits), None)
        return next((n for n in below if fits(n)), None)

    def text(self, without: frozenset[str] = frozenset()) -> str:
        parts, todo = [], list(reversed(self.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                parts.append(child)
            elif child.tag not in without:
                todo += reversed(child.children)
        return "".join(parts)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def under(self, fits: Callable[[Node], bool]) -> bytearray:
        """By place in ``order``: whether an element that fits is above. One pass, however deep the tree is."""
        found = bytearray(len(self.order))
        own = [fits(n) for n in self.order]
        for n in self.order[1:]:
            up = n.parent.at
            found[n.at] = found[up] or own[up]
        return found

    def next(self) -> Node | None:
        """The next element beside this one."""
        beside = self.parent.elements if self.parent else []
        return beside[self.place + 1] if self.place + 1 < len(beside) else None

    def close(self) -> None:
        """Say where each element ends, once all are there."""
        for n in reversed(self.order):
            n.end = n.elements[-1].end if n.elements else n.at + 1


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def leave(self, to: Node) -> None:
        """Close what is open below ``to``."""
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends, shields = _ENDS.get(tag, ((), ()))
        if any(self.open[t] for t in ends):
            node, last = self.at, None
            while node.parent is not None and node.tag not in shields:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                self.leave(last.parent)
        held: dict[str, str] = {}
        for name, value in attrs:
            held.setdefault(name, value or "")
        node = Node(tag, held, self.at)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self.leave(node.parent)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a document; any text gives one."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.root.close()
    return builder.root
