"""Syntax trees: one node type, a kind and named fields."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """A node; fields are attributes.  ``parts`` yields the expressions directly below, not those of inner queries."""

    def __init__(self, kind: str, **fields):
        self.kind = kind
        self.__dict__.update(fields)

    @property
    def fields(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kind"}

    def parts(self) -> Iterator[Node]:
        def below(value):
            if isinstance(value, Node):
                if value.kind != "select":
                    yield value
            elif isinstance(value, (list, tuple)):
                for v in value:
                    yield from below(v)

        for v in self.fields.values():
            yield from below(v)

    def walk(self) -> Iterator[Node]:
        """This expression and all below it, in writing order, without inner queries."""
        yield self
        for p in self.parts():
            yield from p.walk()

    def columns(self) -> list[Node]:
        return [n for n in self.walk() if n.kind == "column"]

    def __eq__(self, other):
        return isinstance(other, Node) and self.kind == other.kind and self.fields == other.fields

    def __repr__(self):
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.fields.items())})"


def dump(node: Node, depth: int = 0) -> str:
    """The tree as indented text, one node a line; empty fields are left out."""
    pad, plain, nested = "  " * depth, [], []
    for name, value in node.fields.items():
        if value in (None, "", [], False, ()):
            continue
        inner = [v for v in (value if isinstance(value, (list, tuple)) else [value]) if isinstance(v, Node)]
        if inner:
            nested.append((name, inner))
        elif isinstance(value, list) and value and isinstance(value[0], tuple):
            nested.append((name, [v for t in value for v in t if isinstance(v, Node)]))
        else:
            plain.append(name if value is True else f"{name}={', '.join(map(str, value)) if isinstance(value, (list, tuple)) else value}")
    lines = [f"{pad}{node.kind}{' ' + ' '.join(plain) if plain else ''}"]
    for name, inner in nested:
        lines.append(f"{pad}  {name}:")
        lines += [dump(n, depth + 2) for n in inner]
    return "\n".join(lines)
