from __future__ import annotations

import pytest

from orrery.api import PropertyGraph, escape_string, format_props, sanitize_rel_type
from orrery.shell import loop
from orrery.sources.catalog import GraphCatalog
from orrery.streaming.ingest import merge_stream


def test_nodes_and_edges(spark):
    g = PropertyGraph(spark)
    g.upsert_node("a", {"name": "A", "age": 3}, "Person")
    g.upsert_node("b", {"name": "B"}, "Person")
    g.upsert_node("a", {"age": 4}, "Other")
    assert g.get_node("a")["properties"] == {"id": "a", "name": "A", "age": 4} and g.get_node("a")["labels"] == ["Person"]
    assert g.has_node("b") and not g.has_node("z") and g.get_node("z") is None
    g.upsert_edge("a", "b", {"w": 1}, "LIKES")
    g.upsert_edge("a", "b", {"w": 2}, "HATES")  # any edge between the two stays as it is
    assert g.get_edge("a", "b")["type"] == "LIKES" and g.get_edge("a", "b")["properties"] == {"w": 1}
    assert g.node_degree("b") == 1 and [n["properties"]["id"] for n in g.get_neighbors("b")] == ["a"] and len(g.get_node_edges("a")) == 1
    assert g.stats() == {"nodes": 2, "edges": 1}
    g.delete_edge("a", "b")
    g.delete_node("a")
    assert g.stats() == {"nodes": 1, "edges": 0}


def test_bulk_and_batches(spark):
    g = PropertyGraph(spark)
    got = g.insert_graph_bulk([("x", {"v": 1}, "N"), ("y", {"v": 2.5, "t": "s"}, "N"), ("z", {}, "M")], [("x", "y", {"w": 1}, "my type"), ("y", "z", {}, "E")])
    assert got == {"nodes": 3, "edges": 2} and set(g.resolve_node_ids(["x", "z", "gone"])) == {"x", "z"}
    with pytest.raises(ValueError, match="unknown end"):
        g.insert_edges_bulk([("x", "gone", {}, "E")])
    g.upsert_nodes_batch([("x", {"v": 9}, "N"), ("new", {"v": 1}, "N")])
    g.upsert_edges_batch([("x", "y", {}, "E"), ("x", "new", {}, "E")])
    assert g.stats() == {"nodes": 4, "edges": 3} and g.get_node("x")["properties"]["v"] == 9
    assert g.cache()["nodes"] == 4 and g.is_cached()
    assert g.pagerank().count() == 4 and g.shortest_path("x", "z")["path"] == ["x", "y", "z"]
    assert g.uncache()["status"] == "unloaded"


def test_strings():
    assert sanitize_rel_type("my type!") == "my_type_" and sanitize_rel_type("1a") == "REL_1a" and sanitize_rel_type("match") == "REL_match"
    assert escape_string("it's \\ \n") == "it\\'s \\\\ \\n" and format_props({"a": 1, "b": None, "c": True, "d": "x"}) == "{`a`: 1, `b`: null, `c`: true, `d`: 'x'}"


def test_catalog(spark, tmp_path):
    c = GraphCatalog(spark, f"file://{tmp_path}/graphs")
    assert c.list() == [] and len(c) == 0
    one = c.create("one")
    one.query("CREATE (:P {name: 'A'})-[:K]->(:P {name: 'B'})")
    c.save("one")
    with pytest.raises(FileExistsError):
        c.create("one")
    with pytest.raises(FileNotFoundError):
        c.open("two")
    c.open_or_create("two").query("CREATE (:P {name: 'C'})")
    assert c.list() == ["one", "two"] and "one" in c and sorted(c) == ["one", "two"]
    r = c.query("MATCH (p:P) MATCH (q:P) FROM two RETURN p.name AS p, q.name AS q, graph(q) AS g ORDER BY p", ["one", "two"]).to_list()
    assert r == [{"p": "A", "q": "C", "g": "two"}, {"p": "B", "q": "C", "g": "two"}]
    assert c.query_sql("SELECT count(*) AS n FROM one__P JOIN one__K ON one__P.id = src", ["one"]).first()["n"] == 1
    c.drop("two")
    assert c.list() == ["one"]


def test_shell_and_stream(spark, tmp_path):
    g, out = PropertyGraph(spark), []
    lines = iter(["CREATE (:P", " {name: 'A'});", "MATCH (p:P) RETURN p.name AS n;", ".tables", "oops;", ".quit"])
    loop(g, lambda: next(lines), out.append)
    assert "'nodes_created': 1" in out[0] and out[1] == '[{"n": "A"}]' and "(:P {name: string})" in out[2] and out[3].startswith("Error")
    spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "k long, v string").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
    q = "UNWIND $rows AS row MERGE (n:S {k: row.k}) SET n.v = row.v"
    merge_stream(g.session, rows, q, f"{tmp_path}/ck").awaitTermination()
    assert sorted((r["k"], r["v"]) for r in g.query("MATCH (n:S) RETURN n.k AS k, n.v AS v")) == [(1, "x"), (2, "y")]
