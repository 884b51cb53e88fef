"""Syntax tree of the query language: frozen dataclasses, so that equal expressions compare equal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any


class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(x: Any) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)


def node(cls):
    return dataclass(frozen=True)(cls)


# Expressions


@node
class Lit(Node):
    value: Any


@node
class Param(Node):
    name: str


@node
class Var(Node):
    name: str


@node
class Prop(Node):
    base: Node
    key: str


@node
class Index(Node):
    base: Node
    index: Node


@node
class Un(Node):
    op: str
    x: Node


@node
class Bin(Node):
    op: str
    left: Node
    right: Node


@node
class IsNull(Node):
    x: Node
    negated: bool


@node
class HasLabel(Node):
    x: Node
    labels: tuple


@node
class Call(Node):
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False
    text: str = ""


@node
class Case(Node):
    operand: Node | None
    whens: tuple
    default: Node | None


@node
class ListLit(Node):
    items: tuple


@node
class MapLit(Node):
    items: tuple  # (key, Node)


@node
class MapProj(Node):
    base: Node
    items: tuple  # (".*", None), (".", key) or (key, Node)


@node
class ListComp(Node):
    var: str
    source: Node
    where: Node | None
    expr: Node | None


@node
class Quant(Node):
    kind: str
    var: str
    source: Node
    pred: Node


@node
class Reduce(Node):
    acc: str
    init: Node
    var: str
    source: Node
    expr: Node


@node
class Exists(Node):
    paths: tuple
    where: Node | None


@node
class PatComp(Node):
    path: Node
    where: Node | None
    expr: Node


# Patterns


@node
class NodePat(Node):
    var: str | None
    labels: tuple
    props: MapLit | None


@node
class RelPat(Node):
    var: str | None
    types: tuple
    props: MapLit | None
    direction: str  # "out", "in" or "both"
    lo: int | None = None
    hi: int | None = None
    varlen: bool = False


@node
class Path(Node):
    var: str | None
    elems: tuple  # NodePat (RelPat NodePat)*
    shortest: str | None = None  # None, "one" or "all"


# Clauses


@node
class Item(Node):
    expr: Node
    alias: str | None
    text: str


@node
class Match(Node):
    paths: tuple
    where: Node | None
    optional: bool
    graph: str | None


@node
class Project(Node):
    kind: str  # "with" or "return"
    items: tuple
    star: bool
    distinct: bool
    order: tuple  # (Node, descending)
    skip: Node | None
    limit: Node | None
    where: Node | None


@node
class Unwind(Node):
    expr: Node
    var: str


@node
class LoadCsv(Node):
    path: Node
    var: str
    headers: bool
    sep: str


@node
class Create(Node):
    paths: tuple


@node
class Merge(Node):
    paths: tuple
    on_create: tuple
    on_match: tuple


@node
class SetProp(Node):
    var: str
    key: str
    value: Node


@node
class SetLabels(Node):
    var: str
    labels: tuple


@node
class SetMap(Node):
    var: str
    value: Node
    replace: bool


@node
class Set(Node):
    items: tuple


@node
class Remove(Node):
    items: tuple  # (var, key) as Prop or HasLabel


@node
class Delete(Node):
    exprs: tuple
    detach: bool


@node
class Foreach(Node):
    var: str
    source: Node
    updates: tuple


@node
class Query(Node):
    clauses: tuple


@node
class Union(Node):
    left: Node
    right: Node
    all: bool


@node
class Explain(Node):
    query: Node
