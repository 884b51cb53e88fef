"""Reading queries against small graphs, and a naive evaluator on random ones."""

from __future__ import annotations

import itertools
import random

import pytest

from orrery.graph import EdgeTable, Graph, NodeTable
from orrery.plans.compiler import CypherError
from orrery.session import Session


@pytest.fixture(scope="module")
def people(spark):
    s = Session(spark)
    s.cypher(
        "CREATE (a:Person {name: 'Alice', age: 30, city: 'NYC'}), (b:Person {name: 'Bob', age: 25, city: 'LA'}), (c:Person {name: 'Carol', age: 30, city: 'NYC'}), (d:Person {name: 'David', age: 35}), (e:Person {name: 'Eve', age: 28}), "
        "(t:Company {name: 'TechCorp', employees: 100}), (u:Company {name: 'StartupInc'}), "
        "(a)-[:KNOWS {since: 2020}]->(b), (b)-[:KNOWS {since: 2021}]->(c), (a)-[:KNOWS]->(d), (d)-[:KNOWS]->(c), (a)-[:WORKS_FOR]->(t), (e)-[:WORKS_FOR]->(t)"
    )
    return s


def rows(s: Session, q: str, params=None):
    return [tuple(tuple(v) if isinstance(v, list) else v for v in r.values()) for r in s.cypher(q, params)]


def test_labels_props_and_nulls(people):
    assert rows(people, "MATCH (n:Person {age: 30, city: 'NYC'}) RETURN n.name ORDER BY n.name") == [("Alice",), ("Carol",)]
    assert rows(people, "MATCH (n:Person {city: null}) RETURN count(n) AS n") == [(2,)]
    assert rows(people, "MATCH (n) WHERE n.employees IS NULL RETURN count(*) AS n") == [(6,)]
    assert rows(people, "MATCH (n:Nothing) RETURN n.x AS x") == []


def test_hops_directions_and_edge_maps(people):
    assert rows(people, "MATCH (a {name: 'Carol'})<-[:KNOWS]-(b) RETURN b.name AS n ORDER BY n") == [("Bob",), ("David",)]
    assert rows(people, "MATCH (a {name: 'Bob'})-[r]-(b) RETURN b.name AS n ORDER BY n") == [("Alice",), ("Carol",)]
    assert rows(people, "MATCH (a)-[r:KNOWS {since: 2021}]->(b) RETURN a.name, b.name") == [("Bob", "Carol")]
    assert rows(people, "MATCH (a)-[:KNOWS]->(a) RETURN count(*) AS n") == [(0,)]


def test_optional_keeps_rows_and_puts_where_inside(people):
    q = "MATCH (p:Person) OPTIONAL MATCH (p)-[:WORKS_FOR]->(c:Company) WHERE c.employees > 50 RETURN p.name AS p, c.name AS c ORDER BY p"
    assert rows(people, q) == [("Alice", "TechCorp"), ("Bob", None), ("Carol", None), ("David", None), ("Eve", "TechCorp")]
    assert rows(people, "OPTIONAL MATCH (x:Nothing) RETURN x IS NULL AS none, count(x) AS n") == [(True, 0)]
    assert rows(people, "MATCH (p:Person {name: 'Eve'}) OPTIONAL MATCH (p)<-[:KNOWS]-(q) RETURN q AS q, count(q) AS n") == [(None, 0)]


def test_grouping_having_and_nested_aggregates(people):
    assert rows(people, "MATCH (p:Person) RETURN p.age AS age, count(*) + 1 AS n ORDER BY age") == [(25, 2), (28, 2), (30, 3), (35, 2)]
    assert rows(people, "MATCH (p:Person) WITH p.city AS c, count(*) AS n WHERE n > 1 RETURN c, n ORDER BY c") == [(None, 2), ("NYC", 2)]
    assert rows(people, "MATCH (p:Person) RETURN min(p.name) AS a, max(p.age) AS b, sum(p.age) AS s, avg(p.age) AS v") == [("Alice", 35, 148, 29.6)]
    assert rows(people, "MATCH (p:Nothing) RETURN count(*) AS n") == [(0,)]


def test_paths(people):
    assert rows(people, "MATCH p = (a {name: 'Alice'})-[:KNOWS*]->(b) RETURN length(p) AS l, b.name AS n ORDER BY l, n") == [(1, "Bob"), (1, "David"), (2, "Carol"), (2, "Carol")]
    assert rows(people, "MATCH p = shortestPath((a {name: 'Alice'})-[:KNOWS*]->(b {name: 'Carol'})) RETURN length(p) AS l, size(nodes(p)) AS n") == [(2, 3)]
    assert len(rows(people, "MATCH p = allShortestPaths((a {name: 'Alice'})-[:KNOWS*]->(b {name: 'Carol'})) RETURN nodes(p) AS n")) == 2
    assert rows(people, "MATCH p = shortestPath((a {name: 'Carol'})-[:KNOWS*]->(b {name: 'Alice'})) RETURN p") == []
    assert rows(people, "MATCH (a {name: 'Alice'})-[r:KNOWS*0..1]->(b) RETURN b.name AS n, size(r) AS k ORDER BY n") == [("Alice", 0), ("Bob", 1), ("David", 1)]


def test_exists_comprehension_and_projection(people):
    assert rows(people, "MATCH (p:Person) WHERE (p)-[:WORKS_FOR]->(:Company) AND NOT (p)<-[:KNOWS]-() RETURN p.name AS n ORDER BY n") == [("Alice",), ("Eve",)]
    assert rows(people, "MATCH (p:Person) WHERE EXISTS { (p)-[:KNOWS]->(q) WHERE q.age > 30 } RETURN p.name") == [("Alice",)]
    got = people.cypher("MATCH (p:Person {name: 'Alice'}) RETURN [(p)-[:KNOWS]->(q) WHERE q.age < 50 | q.name] AS l, p{.name, older: p.age + 1, .*} AS m")[0]
    assert sorted(got["l"]) == ["Bob", "David"] and got["m"]["older"] == 31 and got["m"]["city"] == "NYC"
    assert rows(people, "MATCH (p:Person {name: 'Eve'}) RETURN [(p)-[:KNOWS]->(q) | q.name] AS l") == [((),)]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("7 % 4", 3), ("1 / 0", None), ("'a' + 1", "a1"), ("[1] + 2", [1, 2]), ("1 = '1'", False), ("1 < 'a'", None),
        ("null = null", None), ("true XOR null", None), ("2 IN [1, 2]", True), ("'x' IN []", False), ("[1, 2, 3][-1]", 3), ("[1][5]", None), ("{a: 1}.a", 1), ("{a: 1}['a']", 1),
        ("'Abc' STARTS WITH 'a'", False), ("'abc' =~ 'B'", False), ("'abc' =~ '(?i)B'", True), ("size([1, 2])", 2), ("size('abc')", 3), ("range(5, 1)", []), ("range(1, 6, 2)", [1, 3, 5]),
        ("split('a,,b', ',')", ["a", "", "b"]), ("substring('hello', 1, 3)", "ell"), ("toInteger('3.7')", 3), ("toInteger('x')", None), ("toBoolean('TRUE')", True), ("toFloat('1.5')", 1.5),
        ("sqrt(-1)", None), ("round(-2.5)", -3.0), ("sign(-3.2)", -1), ("ceil(1.2)", 2), ("head([])", None), ("tail([1, 2])", [2]), ("last([1, 2])", 2), ("reverse([1, 2])", [2, 1]), ("reverse('añb')", "bña"),
        ("coalesce(null, 2)", 2), ("left('abc', 2)", "ab"), ("right('abc', 2)", "bc"), ("replace('aXbX', 'X', '-')", "a-b-"), ("keys({a: 1, b: 2})", ["a", "b"]), ("date('2024-02-03')", "2024-02-03"),
        ("CASE WHEN 1 > 2 THEN 'x' END", None), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("[x IN [1, 2, 3] WHERE x > 1]", [2, 3]), ("any(x IN [1, 2] WHERE x > 1)", True), ("none(x IN [] WHERE x > 1)", True),
        ("reduce(s = '', x IN ['a', 'b'] | s + x)", "ab"), ("$p + 1", 3), ("-(1 + 2)", -3), ("NOT false", True),
    ],
)
def test_expressions(spark, text, value):
    assert Session(spark).cypher(f"RETURN {text} AS x", {"p": 2})[0]["x"] == value


def test_unwind_with_union_paging_and_names(spark):
    s = Session(spark)
    assert rows(s, "UNWIND [3, 1, 2] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN x ORDER BY x") == [(2,), (3,)]
    assert rows(s, "UNWIND [1, 2] AS x UNWIND [] AS y RETURN x") == []
    assert rows(s, "RETURN 1 AS a UNION RETURN 1 AS a") == [(1,)]
    assert rows(s, "UNWIND range(1, 9) AS x RETURN x ORDER BY x SKIP $a LIMIT $b", {"a": 2, "b": 3}) == [(3,), (4,), (5,)]
    assert s.cypher("UNWIND [1] AS x RETURN x, count(x), 1 + 1, toString(2)").columns == ["x", "count(x)", "column_2", "toString(2)"]
    with pytest.raises(CypherError):
        s.cypher("RETURN 1 AS a UNION RETURN 1 AS b")


@pytest.mark.parametrize("q", ["RETURN x", "RETURN nope(1)", "RETURN left('a')", "MATCH (n) RETURN count(n) + x", "RETURN $missing", "MATCH (n) FROM gone RETURN n"])
def test_errors(spark, q):
    with pytest.raises(CypherError):
        Session(spark).cypher(q)


def test_properties_called_from_and_to_and_a_bound_relationship(spark):
    s = Session(spark)
    s.cypher("CREATE (:A {from: 1, to: 2})-[:R {to: 3}]->(:A {from: 4, to: 5})-[:R {to: 6}]->(:A {from: 7, to: 8})")
    assert rows(s, "MATCH (a)-[r:R]->(b)-[q:R]->(c) RETURN a.from, a.to, r.to, b.to, q.to, c.to") == [(1, 2, 3, 5, 6, 8)]
    assert rows(s, "MATCH (a)-[r:R {to: 6}]->(b) MATCH (x)-[r]->(y) RETURN x.to, y.to, r.to") == [(5, 8, 6)]
    assert rows(s, "MATCH p = (a)-[:R*2]->(c {to: 8}) RETURN size(nodes(p)) AS n, head(nodes(p)) = id(a) AS l, last(nodes(p)) = id(c) AS r") == [(3, True, True)]


def test_random_graphs_against_nested_loops(spark):
    rnd = random.Random(5)
    nodes = [(i, rnd.choice([1, 2, None])) for i in range(7)]
    edges = [(100 + j, rnd.randrange(7), rnd.randrange(7), rnd.choice("TU")) for j in range(14)]
    table = lambda kind: spark.createDataFrame([e[:3] for e in edges if e[3] == kind], "id long, src long, dst long")
    g = Graph.from_tables(spark, [NodeTable(frozenset(["N"]), spark.createDataFrame(nodes, "id long, v long"))], [EdgeTable("T", table("T")), EdgeTable("U", table("U"))])
    s = Session(spark, g)
    want = sorted((e[1], e[2], f[2]) for e, f in itertools.product(edges, edges) if e[3] == "T" and e[2] == f[1] and dict(nodes)[e[1]] == 1)
    assert sorted(rows(s, "MATCH (a:N {v: 1})-[:T]->(b)-[]->(c) RETURN id(a), id(b), id(c)")) == want
    want = sorted((i, sum(1 for e in edges if i in e[1:3])) for i, _ in nodes)
    assert sorted(rows(s, "MATCH (a:N) OPTIONAL MATCH (a)-[r]-(b) RETURN id(a), count(r)")) == want

    def walks(path):
        if len(path) > 1:
            yield path
        if len(path) < 4:
            for e in edges:
                if e[1] == path[-1] and (e[2] not in path or len(path) == 1):
                    yield from walks([*path, e[2]])

    want = sorted((p[0], p[-1]) for i, _ in nodes for p in walks([i]))
    assert sorted(rows(s, "MATCH (a)-[*1..3]->(b) RETURN id(a), id(b)")) == want
