from __future__ import annotations

import random

import numpy as np
import pytest

from orrery.graph import EdgeTable, Graph, NodeTable
from orrery.operators import centrality, community, components, paths, rank, similarity, traversal
from orrery.operators.common import Csr


def graph(spark, nodes: str, edges: list[tuple]) -> Graph:
    ids = {n: i + 1 for i, n in enumerate(nodes)}
    v = spark.createDataFrame([(i, n) for n, i in ids.items()], "id long, id_ string")
    e = spark.createDataFrame([(k, ids[a], ids[b], float(w[0]) if w else None) for k, (a, b, *w) in enumerate(edges)], "id long, src long, dst long, w double")
    return Graph.from_tables(spark, [NodeTable(frozenset(["Node"]), v)], [EdgeTable("E", e)])


def table(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("node_id").collect()]


def test_components(spark):
    g = graph(spark, "abcde", [("a", "b"), ("c", "d")])
    assert table(components.wcc(g), "user_id", "component") == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)]
    g = graph(spark, "abcde", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d")])
    for far in (False, True):
        assert [c for (c,) in table(components.scc(g, far), "component")] == [0, 0, 0, 1, 1]


def test_empty_graph(spark):
    g = Graph(spark)
    for df in (rank.page_rank(g), components.wcc(g), components.scc(g), community.label_propagation(g), centrality.degree_centrality(g), similarity.triangle_count(g), paths.all_pairs(g), traversal.bfs(g, "a"), traversal.dfs(g, "a")):
        assert df.count() == 0
    assert paths.dijkstra(g, "a", "b").first()["found"] is False


def test_rank(spark):
    g = graph(spark, "ABCD", [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("D", "C")])
    r = {x["user_id"]: x["score"] for x in rank.page_rank(g).collect()}
    assert sorted(r, key=r.get)[0] == "D" and r["C"] > r["B"] and abs(r["D"] - 0.0375) < 1e-6
    cycle = graph(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a")])
    assert all(abs(x["score"] - 1 / 3) < 1e-6 for x in rank.page_rank(cycle).collect())
    assert all(abs(x["score"] - 3**-0.5) < 1e-9 for x in rank.eigenvector_centrality(cycle).collect())
    assert rank.top_page_rank(g, 2).count() == 2


def test_centrality(spark):
    diamond = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")])
    assert table(centrality.betweenness_centrality(diamond), "score") == [(0.0,), (0.5,), (0.0,), (0.5,)]
    assert table(centrality.degree_centrality(diamond), "in_degree", "out_degree", "degree")[0] == (0, 2, 2)
    assert table(centrality.closeness_centrality(graph(spark, "abc", [("a", "b"), ("b", "c")])), "score") == [(0.75,), (1.0,), (0.75,)]


def test_paths_and_traversal(spark):
    g = graph(spark, "ABCDE", [("A", "B", 2), ("B", "C", 1), ("A", "D", 3), ("D", "C", 5), ("B", "E", 4), ("B", "C", 0.5)])
    for far in (False, True):
        r = paths.dijkstra(g, "A", "C", "w", far).first()
        assert (list(r["path"]), r["distance"], r["found"]) == (["A", "B", "C"], 2.5, True)
        assert paths.dijkstra(g, "C", "A", None, far).first()["found"] is False
    assert paths.astar(g, "A", "C").first()["distance"] == 2.0
    assert paths.all_pairs(graph(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")])).collect()[1]["distance"] == 1.0
    assert [(r["user_id"], r["depth"], r["order"]) for r in traversal.bfs(g, "A").collect()] == [("A", 0, 0), ("B", 1, 1), ("D", 1, 2), ("C", 2, 3), ("E", 2, 4)]
    assert [r["user_id"] for r in traversal.dfs(g, "A").orderBy("order").collect()] == ["A", "B", "C", "E", "D"]
    assert traversal.bfs(g, "A", 1).count() == 3 and traversal.dfs(g, "A", 0).count() == 1


def test_similarity_and_triangles(spark):
    g = graph(spark, "abcd", [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")])
    assert [tuple(r) for r in similarity.node_similarity(g, 0.5).collect()] == [("a", "b", 1.0)]
    assert similarity.node_similarity(g).count() == 6 and similarity.node_similarity(g, 0.0, 2).count() == 2
    assert similarity.pair_similarity(g, "a", "b").first()["similarity"] == 1.0
    assert [tuple(r) for r in similarity.knn(g, "a", 3).collect()] == [("b", 1.0, 1)]
    t = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("d", "d")])
    assert table(similarity.triangle_count(t), "triangles", "clustering_coefficient") == [(1, 1.0), (1, 1.0), (1, 1.0), (0, 0.0)]


def test_communities(spark):
    two = [(a, b) for part in ("abcd", "efgh") for i, a in enumerate(part) for b in part[i + 1 :]]
    g = graph(spark, "abcdefgh", [*two, ("d", "e")])
    found = [c for (c,) in table(community.louvain(g), "community")]
    assert found == [0] * 4 + [1] * 4
    csr = Csr(g.vertices().toPandas(), g.links().toPandas())
    assert community.modularity(csr, np.array(found)) > 0.4
    assert len({c for (c,) in table(community.label_propagation(g), "community")}) <= 2
    assert community.community_count(g).first()[0] >= 1


@pytest.mark.parametrize("n", [1, 50])
def test_a_long_path_is_one_component(spark, n):
    e = spark.range(n).selectExpr("id as a", "id + 1 as b")
    for small in (0, 1000):
        got = components.connected_components(e, small=small).collect()
        assert len(got) == n + 1 and {r["component"] for r in got} == {0}
        assert components.connected_components(e.limit(0), small=small).count() == 0


def test_components_in_one_task_equal_the_distributed_ones(spark):
    rnd = random.Random(3)
    e = spark.createDataFrame([(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)], "a long, b long")
    one, many = ({(r["node"], r["component"]) for r in components.connected_components(e, small=k).collect()} for k in (1000, 0))
    assert one == many and len({c for _, c in one}) > 20
