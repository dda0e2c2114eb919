"""From the text of a graph query to its tree.

The plain language has MATCH, RETURN, GROUP BY, ORDER BY and LIMIT in that order, one
edge, and no conditions.  With extended=True it also has WHERE, patterns of one node,
`*` without bounds, and properties in aggregates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodestrand.plans.errors import QuerySyntaxError
from lodestrand.plans.tree import Condition, Edge, Item, Node, Query

KEYWORDS = {"MATCH", "RETURN", "GROUP", "ORDER", "BY", "LIMIT", "AS", "ASC", "DESC"}
EXTENDED_KEYWORDS = KEYWORDS | {"WHERE", "AND", "OR", "NOT"}
#: Hops of `*` without bounds.
UNBOUNDED = (1, 10)
LARGEST = (1 << 63) - 1
_TOKEN = re.compile(
    r"""(?P<skip>[\x20\t\r\n]+|//[^\n]*\n)|(?P<int>[0-9]+)|(?P<word>[A-Za-z][A-Za-z0-9_]*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op><>|=~|<=|>=|[()\[\]:\-<>,.*=])"""
)
_STRICT_OPS = set("()[]:-<>,.*")


@dataclass(frozen=True)
class Token:
    kind: str  # id, upid, int, string, end, or the keyword or sign itself
    text: str
    line: int
    column: int


def tokens(text: str, extended: bool = False) -> list[Token]:
    """The tokens of a query; white space may stand between any two and in none."""
    out, at, line, start = [], 0, 1, 0
    reserved = EXTENDED_KEYWORDS if extended else KEYWORDS
    while at < len(text):
        m = _TOKEN.match(text, at)
        column = at - start + 1
        if m is None or (not extended and (m.lastgroup == "string" or (m.lastgroup == "op" and m.group() not in _STRICT_OPS))):
            if m is None or m.lastgroup == "string" or len(m.group()) == 1:
                raise QuerySyntaxError(line, column, "a token", repr(text[at]))
            m = re.compile(".").match(text, at)  # a sign of two letters that only the extended language has
            if m.group() not in _STRICT_OPS:
                raise QuerySyntaxError(line, column, "a token", repr(text[at]))
            out.append(Token(m.group(), m.group(), line, column))
        elif m.lastgroup != "skip":
            word = m.group()
            kind = m.lastgroup
            if kind == "word":
                kind = word if word in reserved else "id" if word[0].islower() else "upid"
            elif kind == "op":
                kind = word
            out.append(Token(kind, word, line, column))
        for c in range(at, m.end()):
            if text[c] == "\n":
                line, start = line + 1, c + 1
        at = m.end()
    return [*out, Token("end", "end of query", line, at - start + 1)]


class _Parser:
    def __init__(self, text: str, extended: bool):
        self.extended, self.all, self.at = extended, tokens(text, extended), 0

    @property
    def next(self) -> Token:
        return self.all[self.at]

    def fail(self, expected: str):
        t = self.next
        raise QuerySyntaxError(t.line, t.column, expected, t.text)

    def has(self, *kinds: str) -> bool:
        return [t.kind for t in self.all[self.at : self.at + len(kinds)]] == list(kinds)

    def take(self, *kinds: str) -> Token:
        for kind in kinds:
            if self.next.kind != kind:
                self.fail(repr(kind))
            self.at += 1
        return self.all[self.at - 1]

    def try_take(self, *kinds: str) -> bool:
        if self.has(*kinds):
            self.at += len(kinds)
            return True
        return False

    def number(self) -> int:
        token = self.next
        value = int(self.take("int").text)
        if value > LARGEST:
            raise QuerySyntaxError(token.line, token.column, "a 64-bit integer", token.text)
        return value

    def query(self) -> Query:
        self.take("MATCH")
        left, edge, right = self.node(), None, None
        if not self.extended or self.next.kind in "-<":
            edge, right = self.edge(), self.node()
        where = self.condition() if self.extended and self.try_take("WHERE") else None
        self.take("RETURN")
        items = self.listed(self.item)
        group = self.listed(self.prop) if self.try_take("GROUP", "BY") else ()
        order = self.listed(self.order) if self.try_take("ORDER", "BY") else ()
        limit = self.number() if self.try_take("LIMIT") else None
        self.take("end")
        return Query(left, edge, right, items, group, order, limit, where)

    def listed(self, one) -> tuple:
        out = [one()]
        while self.try_take(","):
            out.append(one())
        return tuple(out)

    def node(self) -> Node:
        self.take("(")
        variable = label = None
        if self.next.kind == "id":
            variable = self.take("id").text
            if self.try_take(":"):
                label = self.take("upid").text
        self.take(")")
        return Node(variable, label)

    def edge(self) -> Edge:
        back = self.try_take("<")
        self.take("-", "[")
        relation = hops = None
        typed = self.try_take(":")
        if typed:
            relation = self.take("id").text
        if self.try_take("*"):
            hops = self.hops()
        self.take("]", "-")
        if back:
            if not typed and hops is None and not self.extended:
                self.fail("a relation in '<-[...]-'")
            return Edge(relation, "<", hops)
        if self.try_take(">"):
            return Edge(relation, ">", hops)
        if (typed or hops is not None) and not self.extended:
            self.fail("'>'")
        return Edge(relation, "-", hops)

    def hops(self) -> tuple[int, int]:
        if self.extended and self.next.kind != "int":
            return UNBOUNDED
        least = self.number()
        if self.try_take(".", "."):
            return least, self.number()
        return least, least

    def prop(self) -> tuple[str, str]:
        variable = self.take("id").text
        self.take(".")
        return variable, self.take("id").text

    def item(self) -> Item:
        function = prop = None
        if self.next.kind == "upid":
            function = self.take("upid").text
            self.take("(")
        if self.next.kind != "id":
            self.fail("a variable")
        variable = self.take("id").text
        if (function is None or self.extended) and self.try_take("."):
            prop = self.take("id").text
        if function is not None:
            self.take(")")
        aliasable = function is not None or prop is not None or self.extended
        alias = self.take("id").text if aliasable and self.try_take("AS") else None
        return Item(variable, prop, function, alias)

    def order(self) -> tuple[str, bool]:
        name = self.take("id").text
        down = self.try_take("DESC")
        if not down:
            self.try_take("ASC")
        return name, down

    def condition(self) -> Condition:
        parts = [self.conjunction()]
        while self.try_take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Condition("or", parts=tuple(parts))

    def conjunction(self) -> Condition:
        parts = [self.negation()]
        while self.try_take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Condition("and", parts=tuple(parts))

    def negation(self) -> Condition:
        if self.try_take("NOT"):
            return Condition("not", parts=(self.negation(),))
        if self.try_take("("):
            inner = self.condition()
            self.take(")")
            return inner
        variable, prop = self.prop()
        op = self.next.kind
        if op not in {"=", "<>", "<", ">", "<=", ">=", "=~"}:
            self.fail("a comparison")
        self.take(op)
        if self.next.kind == "int":
            return Condition(op, variable, prop, self.number())
        text = self.take("string").text
        return Condition(op, variable, prop, re.sub(r"\\(.)", r"\1", text[1:-1]))


def parse(text: str, extended: bool = False) -> Query:
    return _Parser(text, extended).query()
