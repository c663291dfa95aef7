"""A small XML tree that keeps mixed content in order and takes prefixes as they are written."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def nodes(self, *names: str) -> Iterator[Node]:
        return (c for c in self.children if c.__class__ is Node and (not names or c.name in names))

    def first(self, *path: str) -> Node | None:
        at: Node = self
        for name in path:  # plain loops: readers look for most of what a document may say in vain
            for c in at.children:
                if c.__class__ is Node and c.name == name:
                    at = c
                    break
            else:
                return None
        return at

    def every(self, name: str) -> Iterator[Node]:
        todo = self.children[::-1]
        while todo:
            c = todo.pop()
            if c.__class__ is Node:
                if c.name == name:
                    yield c
                todo += c.children[::-1]

    def text(self) -> str:
        own = self.children
        if len(own) == 1 and own[0].__class__ is str:
            return own[0]
        return "".join(c if c.__class__ is str else c.text() for c in own)


def parsed(data: bytes | None) -> Node | None:
    """The root element; null for null or broken XML. Namespaces need not be declared."""
    if not data:
        return None
    root = Node("")
    stack = [root]
    push = stack.append
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        push(node)

    parser.StartElementHandler = start
    pop = stack.pop
    parser.EndElementHandler = lambda name: pop()
    parser.CharacterDataHandler = lambda data: stack[-1].children.append(data)
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        return None
    return next(root.nodes(), None)
