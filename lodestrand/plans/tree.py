"""The syntax tree of a graph query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    variable: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class Edge:
    """direction is '>', '<' or '-'; hops is None for a single edge, else (least, most)."""

    relation: str | None = None
    direction: str = ">"
    hops: tuple[int, int] | None = None


@dataclass(frozen=True)
class Item:
    """What is returned: function(variable.property), variable.property or variable."""

    variable: str
    prop: str | None = None
    function: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Condition:
    """variable.property op value, or an 'and', 'or', 'not' of conditions."""

    op: str
    variable: str | None = None
    prop: str | None = None
    value: object = None
    parts: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Query:
    left: Node
    edge: Edge | None
    right: Node | None
    items: tuple[Item, ...]
    group_by: tuple[tuple[str, str], ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()  # name, descending
    limit: int | None = None
    where: Condition | None = field(default=None)
