from __future__ import annotations

import pytest

from orrery.plans.compiler import CypherError
from orrery.session import Session


def names(s: Session, q: str):
    return sorted(tuple(r.values()) for r in s.cypher(q))


def test_create_set_remove_delete(spark):
    s = Session(spark)
    r = s.cypher("CREATE (a:P {name: 'A', n: 1})-[:K {w: 2}]->(b:P {name: 'B'}) RETURN a.name AS a, id(b) > 0 AS ok")
    assert r.to_list() == [{"a": "A", "ok": True}] and r.stats.nodes_created == 2 and r.stats.relationships_created == 1
    old = s.graph
    s.cypher("MATCH (p:P) SET p.n = coalesce(p.n, 10) + 1.5, p:Q")
    assert names(s, "MATCH (p:Q) RETURN p.name, p.n") == [("A", 2.5), ("B", 11.5)]
    assert Session(spark, old).cypher("MATCH (p:Q) RETURN count(p) AS n")[0]["n"] == 0  # the old version stays
    s.cypher("MATCH (p:P {name: 'A'}) SET p.n = null REMOVE p:Q")
    assert names(s, "MATCH (p:P) WHERE p.n IS NULL RETURN p.name, size(labels(p))") == [("A", 1)]
    s.cypher("MATCH ()-[k:K]->() SET k.w = k.w * 2")
    assert names(s, "MATCH ()-[k:K]->() RETURN k.w") == [(4,)]
    with pytest.raises(CypherError, match="still has relationships"):
        s.cypher("MATCH (p:P {name: 'A'}) DELETE p")
    r = s.cypher("MATCH (p:P {name: 'A'}) DETACH DELETE p")
    assert (r.stats.nodes_deleted, r.stats.relationships_deleted) == (1, 1)
    assert names(s, "MATCH (n) RETURN n.name") == [("B",)]


def test_match_create_makes_one_for_each_row_and_none_for_none(spark):
    s = Session(spark)
    s.cypher("UNWIND range(1, 3) AS x CREATE (:N {v: x})")
    s.cypher("MATCH (n:N) CREATE (n)-[:HAS]->(:M {of: n.v})")
    s.cypher("MATCH (n:Gone) CREATE (:M {of: 9})")
    assert names(s, "MATCH (n)-[:HAS]->(m) RETURN n.v, m.of") == [(1, 1), (2, 2), (3, 3)]
    assert names(s, "MATCH (m:M) RETURN count(m)") == [(3,)]


def test_merge(spark):
    s = Session(spark)
    s.cypher("UNWIND ['a', 'b', 'a'] AS k MERGE (n:N {k: k}) ON CREATE SET n.new = true")
    assert names(s, "MATCH (n:N) RETURN n.k, n.new") == [("a", True), ("b", True)]
    s.cypher("MERGE (n:N {k: 'a'}) ON CREATE SET n.new = true ON MATCH SET n.new = false")
    assert names(s, "MATCH (n:N) RETURN n.k, n.new") == [("a", False), ("b", True)]
    for _ in range(2):
        s.cypher("MATCH (a:N {k: 'a'}), (b:N {k: 'b'}) MERGE (a)-[r:T {w: 1}]->(b)")
    assert names(s, "MATCH (a)-[r:T]->(b) RETURN a.k, b.k, r.w") == [("a", "b", 1)]
    s.cypher("MERGE (x:X {k: 1})-[:Y]->(z:Z {k: 2})")
    s.cypher("MERGE (x:X {k: 1})-[:Y]->(z:Z {k: 2})")
    assert names(s, "MATCH (x:X)-[:Y]->(z) RETURN count(*)") == [(1,)]


def test_foreach_and_maps(spark):
    s = Session(spark)
    s.cypher("CREATE (:P {name: 'A'})")
    s.cypher("MATCH (p:P) FOREACH (x IN [1, 2] | CREATE (:C {v: x}) MERGE (p)-[:HAS {v: x}]->(p)) SET p += {a: 1, b: 'x'}")
    assert names(s, "MATCH (c:C) RETURN c.v") == [(1,), (2,)]
    assert names(s, "MATCH (p:P)-[h:HAS]->(p) RETURN h.v, p.a, p.b") == [(1, 1, "x"), (2, 1, "x")]
    s.cypher("MATCH (p:P) SET p = {name: 'Z'}")
    assert names(s, "MATCH (p:P) RETURN p.name, p.a IS NULL") == [("Z", True)]


def test_csv_explain_and_arguments(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;b\n1;x\n2;y\n")
    s = Session(spark)
    s.cypher(f"LOAD CSV WITH HEADERS FROM '{tmp_path}/f.csv' AS row FIELDTERMINATOR ';' CREATE (:R {{a: toInteger(row.a), b: row.b}})")
    assert names(s, "MATCH (r:R) RETURN r.a, r.b") == [(1, "x"), (2, "y")]
    assert names(s, f"LOAD CSV FROM '{tmp_path}/f.csv' AS row RETURN row[0]") == [("1;x",), ("2;y",), ("a;b",)]
    plan = s.cypher("EXPLAIN MATCH (r:R) RETURN r.a")[0]["plan"]
    assert "Match" in plan and "Scan parquet" in plan
    with pytest.raises(TypeError):
        s.cypher(5)
    with pytest.raises(TypeError):
        s.cypher("RETURN 1", [1])
