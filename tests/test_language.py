"""The graph language: what it accepts, what it rejects, what it computes."""

import random

import pytest

from lodestrand.operators.traverse import walk_pairs
from lodestrand.plans.compiler import run_query
from lodestrand.plans.errors import QuerySemanticError, QuerySyntaxError
from lodestrand.plans.parser import parse
from lodestrand.schemas import EDGES, ENTITIES
from lodestrand.store import Tables

ACCEPTED = [
    "MATCH (x:RIVER)-[:feeds]->(y:LAKE) RETURN x.name, y.name",
    "MATCH (y:LAKE)<-[:feeds]-(x:RIVER) RETURN y.name, x.id",
    "MATCH (x)-[:crosses*2]->(y:ROAD) RETURN x.name",
    "MATCH (x)-[*1..5]->(y) RETURN y.name, x.name",
    "MATCH(x)-[:feeds* 1 . . 3]->( y )RETURN x.name AS z,y",
    "MATCH (x)-[]->() // a remark\nRETURN x",
    "MATCH (x)-[]-(y) RETURN x",
    "MATCH (x)-[:feeds]->(y)\nRETURN y.name, COUNT(x) AS n\nGROUP BY y.name ORDER BY n DESC, y_name ASC LIMIT 0",
]
REJECTED = [
    "match (a)-[]->(b) RETURN a",
    "MATCH (n) RETURN n.name",
    "MATCH (:FUNCTION)-[]->(b) RETURN b",
    "MATCH (f:function)-[]->(b) RETURN b",
    "MATCH (a)-[:CALLS]->(b) RETURN b",
    "MATCH (a)-[r:calls]->(b) RETURN b",
    "MATCH (a)<-[]-(b) RETURN b",
    "MATCH (a)-[:calls*]->(b) RETURN b",
    "MATCH (a)-[:calls]-(b) RETURN b",
    "MATCH (a)-[]->(b) WHERE a.name = 'x' RETURN b",
    "MATCH (a)-[]->(b) RETURN b.name ORDER BY b.name",
    "MATCH (a)-[]->(b) RETURN *",
    "MATCH (a)-[]->(b) RETURN COUNT(*)",
    "MATCH (a)-[]->(b) RETURN COUNT(a.name)",
    "MATCH (a)-[]->(b) RETURN DISTINCT a",
    "MATCH (a)-[]->(b) RETURN a SKIP 1",
    "MATCH (a)-[]->(b) RETURN a LIMIT 1 ORDER BY a",
    "MATCH (x:AS)-[]->(b) RETURN x",
    "MATCH (a)-[]->(b) RETURN a // no line end",
    "MATCH (a)-[]->(b) RETURN a LIMIT 99999999999999999999",
    "MATCH (a)-[]->(b) RETURN a AS x",
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepts(text):
    parse(text)


@pytest.mark.parametrize("text", REJECTED)
def test_rejects(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_errors_say_where():
    with pytest.raises(QuerySyntaxError) as e:
        parse("MATCH (a)-[]->(b)\n  RETURN 7")
    assert (e.value.line, e.value.column, e.value.got) == (2, 10, "7") and "parse error: 2:10" in str(e.value)


@pytest.fixture(scope="module")
def golden(spark):
    entities = spark.createDataFrame([(1, "A", "FUNCTION", 1), (2, "B", "FUNCTION", 1), (3, "C", "TYPE", 2), (4, "D", "TYPE", 2)], ENTITIES)
    edges = spark.createDataFrame([(s, t, r, c, 1.0) for s, t, r, c in [(1, 2, "calls", 1), (2, 3, "calls", 1), (3, 4, "uses", 2), (4, 1, "calls", 2), (1, 3, "calls", 1), (1, 2, "calls", 2)]], EDGES)
    return Tables(entities=entities, edges=edges)


@pytest.mark.parametrize(
    ("pattern", "pairs"),
    [
        ("(a)-[:calls]->(b)", "AB AB AC BC DA"),
        ("(a:FUNCTION)-[:calls]->(b:TYPE)", "AC BC"),
        ("(a)-[:calls*2]->(b)", "AC DB DC"),
        ("(a)-[:calls*1..3]->(b)", "AB AC BC DA DB DC"),
        ("(a)-[*3]->(b)", "AA AD BA CB CC DC DD"),
        ("(a)-[*1..2]->(b:TYPE)", "AC AD BC BD CA CD"),
        ("(a:FUNCTION)-[:calls*1..2]->(b:TYPE)", "AC BC"),
        ("(a)-[*2..1]->(b)", ""),
    ],
)
def test_golden_patterns(golden, pattern, pairs):
    rows = run_query(golden, f"MATCH {pattern} RETURN a.name, b.name").collect()
    assert sorted(r.a_name + r.b_name for r in rows) == pairs.split()


def test_golden_counts(golden):
    rows = run_query(golden, "MATCH (a)-[:calls]->(b) RETURN b.name, COUNT(a) AS n GROUP BY b.name ORDER BY n DESC, b_name").collect()
    assert [tuple(r) for r in rows] == [("C", 2), ("A", 1), ("B", 1)]
    assert run_query(golden, "MATCH (a)-[:calls]->(b) RETURN COUNT(a)").columns == ["COUNT(DISTINCT e1.id)"]


@pytest.mark.parametrize("text", ["MATCH (a)-[]-(b) RETURN a", "MATCH (a)-[]->(b) RETURN SUM(a)", "MATCH (a)-[]->(b) RETURN Count(a)", "MATCH (a)-[]->(b) RETURN c", "MATCH (a)-[*2]->(b) RETURN COUNT(a)", "MATCH (a)-[]->(b) RETURN a.nothing", "MATCH (a)-[]->(b) RETURN a.name ORDER BY name", "MATCH (a)-[]->(b) RETURN COUNT(a) GROUP BY c.name"])
def test_means_nothing(golden, text):
    with pytest.raises(QuerySemanticError):
        run_query(golden, text)


def test_walks_equal_those_by_hand(spark):
    rng = random.Random(3)
    for least, most in ((1, 3), (2, 4), (3, 3), (0, 2), (4, 0)):
        edges = {(rng.randrange(7), rng.randrange(9)) for _ in range(9)}  # 7 and 8 have no row
        found, level = set(), {(a, b) for a, b in edges if a < 7 and b < 7}
        for depth in range(1, (most or 10) + 1):
            if depth >= least:
                found |= level
            level = {(a, d) for a, b in level for c, d in edges if b == c}
        nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
        got = walk_pairs(spark.createDataFrame(sorted(edges), "s long, t long"), nodes, nodes, least, most)
        assert {(r.s, r.t) for r in got.collect()} == found


def test_extended_clauses(golden):
    run = lambda text: [tuple(r) for r in run_query(golden, text, extended=True).collect()]
    assert run("MATCH (n:TYPE) RETURN n.name AS x ORDER BY x DESC") == [("D",), ("C",)]
    assert run("MATCH (a)-[*1..2]->(b:TYPE) RETURN b.name, COUNT(a) AS n GROUP BY b.name ORDER BY b_name") == [("C", 3), ("D", 3)]
    assert run("MATCH (a)-[:uses]-(b) WHERE a.name = \"D\" RETURN b.name") == [("C",)]


@pytest.mark.parametrize("pattern", ["(", "a**b", "(?=x)y", "(a)\\\\1"])
def test_patterns_that_are_none_are_errors_of_the_query(golden, pattern):
    with pytest.raises(QuerySemanticError):
        run_query(golden, f'MATCH (a)-[]->(b) WHERE a.name =~ "{pattern}" RETURN b.name', extended=True)
