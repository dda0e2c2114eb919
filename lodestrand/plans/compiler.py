"""From a query's tree to a DataFrame.

Catalyst does the rest: filters reach the scans, unused columns go.  Done here is what
it can't know: joins to chunks and files are left out where nothing they give is
returned (both join on unique keys), and walks are levels of distinct pairs.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.traverse import both_ways, walk_pairs
from lodestrand.plans.errors import QuerySemanticError
from lodestrand.plans.parser import parse
from lodestrand.plans.tree import Condition, Item, Query
from lodestrand.sources.filters import usable_patterns

ENTITY = ("id", "name", "entity_type", "chunk_id")
VIRTUAL = ("snippet", "file", "lines")
#: Edge columns that ORDER BY may name.
EDGE = ("weight", "relation_type")
AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


class _Compiler:
    def __init__(self, query: Query, store, extended: bool, scope: str | None):
        self.q, self.store, self.extended, self.scope = query, store, extended, scope
        back = query.edge is not None and query.edge.direction == "<"
        first, second = (query.right, query.left) if back else (query.left, query.right)
        self.first, self.second = first, second
        self.side: dict[str, str] = {}
        # A variable at both ends means the first of them in the edge's direction.
        for node, side in ((second, "e2"), (first, "e1")):
            if node is not None and node.variable is not None:
                self.side[node.variable] = side
        hops = query.edge.hops if query.edge is not None else None
        self.multi = hops is not None and hops != (0, 0)

    # -- names

    def where_is(self, variable: str, clause: str) -> str:
        if variable not in self.side:
            raise QuerySemanticError(f"unknown variable in {clause}: {variable}")
        return self.side[variable]

    def column(self, variable: str, prop: str, clause: str) -> Column:
        side = self.where_is(variable, clause)
        if prop in ENTITY:
            return F.col(f"{side}_{prop}")
        if prop in VIRTUAL and clause != "GROUP BY":
            return F.col(f"{side}_{prop}")
        raise QuerySemanticError(f"no such column: {variable}.{prop}")

    def needs(self) -> set[tuple[str, str]]:
        """(side, virtual property) of what is returned or compared."""
        found = {(self.where_is(i.variable, "RETURN"), i.prop) for i in self.q.items if i.prop in VIRTUAL}

        def walk(c: Condition | None):
            if c is not None:
                if c.prop in VIRTUAL:
                    found.add((self.where_is(c.variable, "WHERE"), c.prop))
                for p in c.parts:
                    walk(p)

        walk(self.q.where)
        if self.scope is not None:
            found |= {(s, "file") for s in (("e1", "e2") if self.second else ("e1",))}
        return found

    # -- rows

    def entities(self, node, side: str) -> DataFrame:
        rows = self.store.entities.select(*[F.col(c).alias(f"{side}_{c}") for c in ENTITY])
        return rows if node is None or node.label is None else rows.filter(F.col(f"{side}_entity_type") == node.label)

    def edges(self) -> DataFrame:
        edge = self.q.edge
        rows = self.store.edges.select("source_entity_id", "target_entity_id", "relation_type", "weight", F.col("chunk_id").alias("edge_chunk_id"))
        if edge.relation is not None:
            rows = rows.filter(F.col("relation_type") == edge.relation)
        if edge.direction == "-":
            if not self.extended:
                raise QuerySemanticError("undirected edges not yet supported")
            rows = both_ways(rows)
        return rows

    def pattern(self) -> DataFrame:
        e1 = self.entities(self.first, "e1")
        if self.q.edge is None:
            return e1
        edges = self.edges()
        if not self.multi:
            rows = edges.join(e1, F.col("source_entity_id") == F.col("e1_id"))
            return rows.join(self.entities(self.second, "e2"), F.col("target_entity_id") == F.col("e2_id"))
        least, most = self.q.edge.hops
        pairs = edges.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"))
        plain = self.store.entities.select("id")
        ends = plain if self.extended or self.second.label is None else self.entities(self.second, "e2").select(F.col("e2_id").alias("id"))
        # Compatible: the second label holds for the first hop's end; extended: for the walk's.
        walks = walk_pairs(pairs, e1.select(F.col("e1_id").alias("id")), ends, least, most)
        rows = walks.join(self.entities(None, "e1"), F.col("s") == F.col("e1_id"))
        return rows.join(self.entities(self.second if self.extended else None, "e2"), F.col("t") == F.col("e2_id"))

    def with_provenance(self, rows: DataFrame) -> DataFrame:
        needs = self.needs()
        for side in sorted({s for s, _ in needs}):
            wanted = {p for s, p in needs if s == side}
            lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
            chunks = self.store.chunks.select(F.col("chunk_id").alias("_c"), F.col("file_id").alias("_f"), F.col("content_snippet").alias(f"{side}_snippet"), lines.alias(f"{side}_lines"))
            rows = rows.join(chunks, F.col(f"{side}_chunk_id") == F.col("_c"), "left").drop("_c")
            if "file" in wanted:
                files = self.store.files.select(F.col("id").alias("_i"), F.col("path").alias(f"{side}_file"))
                rows = rows.join(files, F.col("_f") == F.col("_i"), "left").drop("_i")
            rows = rows.drop("_f")
        return rows

    # -- clauses

    def condition(self, c: Condition) -> Column:
        if c.op == "not":
            return ~self.condition(c.parts[0])
        if c.op in ("and", "or"):
            out = self.condition(c.parts[0])
            for p in c.parts[1:]:
                out = out & self.condition(p) if c.op == "and" else out | self.condition(p)
            return out
        column, value = self.column(c.variable, c.prop, "WHERE"), F.lit(c.value)
        if c.op == "=~" and not usable_patterns([str(c.value)]):
            raise QuerySemanticError(f"not a regular expression of linear time: {c.value}")
        return {"=": column == value, "<>": column != value, "<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value, "=~": column.rlike(f"^(?:{c.value})$")}[c.op]

    def aggregate(self, item: Item) -> tuple[str, Column]:
        side = self.where_is(item.variable, "RETURN")
        if item.function == "COUNT":
            column = F.col(f"{side}_id") if item.prop is None else self.column(item.variable, item.prop, "RETURN")
            return item.alias or f"COUNT(DISTINCT {side}.{item.prop or 'id'})", F.count_distinct(column)
        if item.function not in AGGREGATES:
            raise QuerySemanticError(f"unknown aggregate function: {item.function}")
        if not self.extended:
            raise QuerySemanticError(f"aggregate function {item.function} not yet supported")
        prop = item.prop or "id"
        return item.alias or f"{item.function.lower()}_{item.variable}_{prop}", AGGREGATES[item.function](self.column(item.variable, prop, "RETURN"))

    def plain(self, item: Item, whole: int) -> list[tuple[str, Column]]:
        if item.prop is not None:
            name = item.alias if self.extended and item.alias else f"{item.variable}_{item.prop}"
            return [(name, self.column(item.variable, item.prop, "RETURN"))]
        side = self.where_is(item.variable, "RETURN")
        prefix = "" if whole == 1 else f"{item.variable}_"
        return [(f"{prefix}{c}", F.col(f"{side}_{c}")) for c in ENTITY]

    def build(self) -> DataFrame:
        q = self.q
        functions = [i for i in q.items if i.function]
        if self.multi and functions and not self.extended:
            raise QuerySemanticError("unknown variable in RETURN: aggregates need a single hop")
        whole = sum(i.function is None and i.prop is None for i in q.items)
        outputs: list[tuple[str, Column, bool]] = []
        for item in q.items:
            if item.function:
                outputs.append((*self.aggregate(item), True))
            else:
                outputs += [(n, c, False) for n, c in self.plain(item, whole)]
        keys = [self.column(v, p, "GROUP BY") for v, p in q.group_by]

        rows = self.with_provenance(self.pattern())
        if q.where is not None:
            rows = rows.filter(self.condition(q.where))
        if self.scope is not None:
            prefix = self.scope.rstrip("/") + "/"
            inside = F.coalesce(F.col("e1_file").startswith(prefix), F.lit(False))
            rows = rows.filter(inside | F.coalesce(F.col("e2_file").startswith(prefix), F.lit(False)) if self.second else inside)

        clauses = q.group_by or q.order_by or q.limit is not None
        if self.multi and not self.extended:
            if clauses:
                warnings.warn("GROUP BY, ORDER BY and LIMIT have no effect on walks of several hops", stacklevel=4)
            return rows.select(*[c.alias(n) for n, c, _ in outputs]).distinct()

        grouped = bool(keys or functions)
        order = []
        for k, (name, down) in enumerate(q.order_by):
            if name not in {n for n, *_ in outputs}:
                if name not in EDGE or q.edge is None or self.multi:
                    raise QuerySemanticError(f"no such column, or an ambiguous one, in ORDER BY: {name}")
                outputs.append((f"_order{k}", F.col(name), False))
                name = f"_order{k}"
            order.append(F.col(f"`{name}`").desc_nulls_last() if down else F.col(f"`{name}`").asc_nulls_first())
        if grouped:
            # What isn't grouped has some row's value; the least makes it the same each time.
            made = [(c if agg else F.min(c)).alias(n) for n, c, agg in outputs]
            temp = rows.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(*made) if keys else rows.agg(*made)
            out = temp.drop(*[f"_key{i}" for i in range(len(keys))])
        else:
            out = rows.select(*[c.alias(n) for n, c, _ in outputs])
            if self.multi:
                out = out.distinct()
        if order:
            out = out.orderBy(*order)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*[n for n, *_ in outputs if n.startswith("_order")])


def run_query(store, text: str, extended: bool = False, scope: str | None = None) -> DataFrame:
    """The rows of a graph query over a store's entities, edges, chunks and files.

    extended=False computes what the plain language computes, its quirks included;
    extended=True honours aliases and all clauses, holds labels against walks' ends and
    knows WHERE, single nodes, undirected edges and more aggregates.  scope keeps
    patterns of which one end's file lies under a folder.
    """
    return _Compiler(parse(text, extended), store, extended, scope).build()
