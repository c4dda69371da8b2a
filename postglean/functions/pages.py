"""Pages as trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements that hold nothing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Node:
    """An element: its tag, attributes, and children, which are elements and texts."""

    tag: str = ""
    given: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    #: Of the root: whether each element was closed in turn and has no attribute twice; whether it declares a document.
    sound: bool = True
    declared: bool = False

    @classmethod
    def of(cls, page: str) -> Node:
        reader = _Reader()
        reader.feed(page)
        whole = not reader.rawdata
        reader.close()
        reader.open[0].sound &= len(reader.open) == 1 and whole
        return reader.open[0]

    @property
    def classes(self) -> list[str]:
        return self.given.get("class", "").split()

    def elements(self) -> Iterator[Node]:
        return (x for x in self.children if isinstance(x, Node))

    def all(self, wanted: Callable[[Node], bool]) -> Iterator[Node]:
        """Elements below, in the page's order."""
        left = list(self.elements())[::-1]
        while left:
            x = left.pop()
            if wanted(x):
                yield x
            left += list(x.elements())[::-1]

    def outermost(self, wanted: Callable[[Node], bool]) -> Iterator[Node]:
        """Elements below that are within no other wanted one."""
        left = list(self.elements())[::-1]
        while left:
            x = left.pop()
            if wanted(x):
                yield x
            else:
                left += list(x.elements())[::-1]

    def text(self, without: frozenset[str] = frozenset()) -> str:
        """Words of the element and of all below but those of tags ``without``."""
        out, left = [], [self]
        while left:
            x = left.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in without:
                left += x.children[::-1]
        return " ".join(" ".join(out).split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node()]

    def handle_decl(self, decl):
        self.open[0].declared = True

    def handle_starttag(self, tag, attrs):
        self.open[0].sound &= len(dict(attrs)) == len(attrs)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[0].sound &= len(dict(attrs)) == len(attrs)
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        self.open[0].sound &= tag in VOID or at == len(self.open) - 1
        if at:
            del self.open[at:]
