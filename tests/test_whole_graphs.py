"""The algorithms that need the whole graph: none takes it to the driver, and all agree with plain loops."""

from __future__ import annotations

import heapq
import math
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from orrery.graph import EdgeTable, Graph, NodeTable
from orrery.operators import centrality, common, community, components, paths, rank, similarity, traversal
from orrery.operators.tasks import Flat

N = 40


def random_edges(seed: int, n: int = N, m: int = 110) -> list[tuple[int, int, float]]:
    """Ends 0 .. n - 1 and a weight, with loops, parallel edges, zero weights, nodes of equal out-edges and nodes without any."""
    rnd = random.Random(seed)
    e = [(rnd.randrange(n - 4), rnd.randrange(n - 4), float(rnd.randrange(4))) for _ in range(m)]
    e += [e[0], e[1], (3, 3, 1.0), *((x, y, 1.0) for x in (n - 4, n - 3, n - 2) for y in (5, 6))]
    return e


def graph(spark, edges, n: int = N) -> Graph:
    v = spark.createDataFrame(pd.DataFrame({"id": [10 * i for i in range(n)], "id_": [f"u{i}" for i in range(n)], "x": [float(i % 7) for i in range(n)], "y": [float(i // 7) if i % 5 else None for i in range(n)]}), "id long, id_ string, x double, y double")
    e = spark.createDataFrame([(k, 10 * a, 10 * b, w) for k, (a, b, w) in enumerate(edges)], "id long, src long, dst long, w double")
    return Graph.from_tables(spark, [NodeTable(frozenset(["N"]), v)], [EdgeTable("E", e)])


def hops(edges, s: int) -> dict[int, int]:
    dist, queue = {s: 0}, deque([s])
    while queue:
        x = queue.popleft()
        for a, b, _ in edges:
            if a == x and b not in dist:
                dist[b] = dist[x] + 1
                queue.append(b)
    return dist


@pytest.fixture
def no_driver(monkeypatch):
    """A graph of any size is too large for the driver."""
    monkeypatch.setattr(common, "LOCAL_EDGES", -1)
    monkeypatch.setattr(common, "local_csr", None)


def test_nothing_is_refused_or_taken_to_the_driver(spark, no_driver):
    g = graph(spark, random_edges(1))
    assert paths.astar(g, "u0", "u1").count() == paths.dijkstra(g, "u0", "u1").count() == 1
    for df in (centrality.betweenness_centrality(g), centrality.closeness_centrality(g), community.louvain(g), components.scc(g)):
        assert df.count() == N
    assert traversal.dfs(g, "u0").count() == len(hops(random_edges(1), 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    edges = random_edges(seed)
    g = graph(spark, edges)
    want = [(f"u{s}", f"u{t}", float(d)) for s in range(N) for t, d in sorted(hops(edges, s).items()) if s != t]
    assert [tuple(r) for r in paths.all_pairs(g).collect()] == want
    counts = {float(d): sum(x[2] == d for x in want) for d in {x[2] for x in want}}
    assert {r["distance"]: r["pairs"] for r in paths.pairs_by_distance(g).collect()} == counts


@pytest.mark.parametrize("seed", [1, 2])
def test_centrality(spark, seed):
    edges = random_edges(seed)
    g = graph(spark, edges)
    both = edges + [(b, a, w) for a, b, w in edges]
    got = {r["node_id"] // 10: r["score"] for r in centrality.closeness_centrality(g).collect()}
    for s in range(N):
        assert got[s] == pytest.approx(sum(1 / d for d in hops(both, s).values() if d) / (N - 1))
    score = np.zeros(N)
    for s in range(N):
        dist, sigma = hops(edges, s), np.zeros(N)
        sigma[s], delta, order = 1, np.zeros(N), sorted(hops(edges, s), key=hops(edges, s).get)
        for x in order:
            for a, b, _ in edges:
                if a == x and dist[b] == dist[x] + 1:
                    sigma[b] += sigma[x]
        for y in order[:0:-1]:
            for a, b, _ in edges:
                if b == y and dist.get(a) == dist[y] - 1:
                    delta[a] += sigma[a] / sigma[y] * (1 + delta[y])
        delta[s] = 0
        score += delta
    got = {r["node_id"] // 10: r["score"] for r in centrality.betweenness_centrality(g).collect()}
    assert [got[i] for i in range(N)] == pytest.approx(score.tolist())


def test_dfs(spark):
    edges = random_edges(3)
    near = [[b for a, b, _ in edges if a == x] for x in range(N)]
    for deep in (-1, 0, 2):
        want, stack, seen = [(0, 0)], [(0, iter(near[0]))], {0}
        while stack:
            y = next(stack[-1][1], None)
            if y is None:
                stack.pop()
            elif y not in seen and (deep < 0 or len(stack) <= deep):
                seen.add(y)
                want.append((y, len(stack)))
                stack.append((y, iter(near[y])))
        assert [(r["node_id"] // 10, r["depth"], r["order"]) for r in traversal.dfs(graph(spark, edges), "u0", deep).collect()] == [(*x, k) for k, x in enumerate(want)]
    alone = graph(spark, [])
    assert [r["user_id"] for r in traversal.dfs(alone, "u4").collect()] == ["u4"] and traversal.dfs(alone, "nobody").count() == 0


@pytest.mark.parametrize("place", [(None, None), ("x", "y"), ("LAT", "y")])
def test_astar(spark, place):
    edges = random_edges(4)
    g = graph(spark, edges)
    at = {i: (float(i % 7), float(i // 7)) for i in range(N) if i % 5} if place == ("x", "y") else {}
    for s, t in ((0, 7), (2, 11), (3, 3), (0, N - 1)):
        guess = lambda i, t=t: math.dist(at[i], at[t]) if i in at and t in at else 0.0
        cost, pred, done, heap, path = {s: 0.0}, {}, set(), [(guess(s), s)], []
        while heap and not path:
            _, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x == t:
                path = [x]
                while path[-1] != s:
                    path.append(pred[path[-1]])
            for a, b, _ in edges if not path else ():
                if a == x and b not in done and cost[x] + 1 < cost.get(b, math.inf):
                    cost[b], pred[b] = cost[x] + 1, x
                    heapq.heappush(heap, (cost[b] + guess(b), b))
        r = paths.astar(g, f"u{s}", f"u{t}", *place).first()
        assert (list(r["path"]), r["found"], r["nodes_explored"]) == ([f"u{i}" for i in reversed(path)], bool(path), len(done))
        assert r["distance"] == (len(path) - 1 if path else None)


@pytest.mark.parametrize("seed", [5, 6])
def test_dijkstra_takes_the_smaller_predecessor_in_either_form(spark, seed):
    edges = [(a, b, w or 1.0) for a, b, w in random_edges(seed)] + [(0, 30, 2.0), (0, 2, 1.0), (2, 31, 1.0), (31, 30, 0.0), (0, 1, 1.0), (1, 30, 1.0)]
    g = graph(spark, edges)
    for t in (9, 17, 30):
        one, two = (paths.dijkstra(g, "u0", f"u{t}", "w", far).first() for far in (False, True))
        assert one == two


def test_louvain_moves_as_before(spark):
    edges = random_edges(8)
    m, comp = len(edges), list(range(N))
    near = [[b for a, b, _ in edges if a == x] + [a for a, b, _ in edges if b == x] for x in range(N)]
    total = [float(len(x)) for x in near]
    for _ in range(100):
        moved = False
        for i in range(N):
            links: dict[int, int] = {}
            for y in near[i]:
                if y != i:
                    links[comp[y]] = links.get(comp[y], 0) + 1
            total[comp[i]] -= len(near[i])
            gain = lambda c: links.get(c, 0) / m - total[c] * len(near[i]) / (2.0 * m * m)  # noqa: B023, E731
            best, best_gain = comp[i], gain(comp[i])
            for c in sorted(links):
                if gain(c) > best_gain + 1e-12:
                    best, best_gain = c, gain(c)
            total[best] += len(near[i])
            moved |= best != comp[i]
            comp[i] = best
        if not moved:
            break
    names = {c: k for k, c in enumerate(dict.fromkeys(comp))}
    assert [r["community"] for r in community.louvain(graph(spark, edges)).collect()] == [names[c] for c in comp]


def test_twins_have_the_same_arcs():
    s, t = (np.array(x, np.int32) for x in zip(*sorted((a, b) for a, b in [(0, 3), (1, 3), (2, 3), (2, 3), (3, 4), (5, 3), (5, 4), (6, 3), (6, 4)]), strict=True))
    cls, reps = Flat(s, t, 8).twins()
    assert cls[0] == cls[1] and cls[5] == cls[6] and cls[4] == cls[7] == -1 and len(set(cls)) == 5 and len(reps) == 4


def sets_of(edges) -> dict[int, set[int]]:
    return {x: {b for a, b, _ in edges if a == x} for x in {a for a, _, _ in edges}}


def by_pairs(edges, threshold: float) -> list[tuple[str, str, float]]:
    near = sets_of(edges)
    rows = [(len(near.get(a, set()) & near.get(b, set())) / max(1, len(near.get(a, set()) | near.get(b, set()))), a, b) for a in range(N) for b in range(a + 1, N)]
    return [(f"u{a}", f"u{b}", s) for s, a, b in sorted(rows, key=lambda r: (-r[0], *r[1:])) if s >= threshold]


def test_similar_pairs_come_in_order_and_are_not_moved(spark, monkeypatch):
    edges = random_edges(9) + [(x, y, 1.0) for x in range(20, 28) for y in (30, 31 + x % 2)]
    g = graph(spark, edges)
    for threshold in (0.2, 0.5, 1.0):
        got = similarity.node_similarity(g, threshold)
        assert [tuple(r) for r in got.collect()] == by_pairs(edges, threshold)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Sort")  # nodes are sorted, pairs are not
    assert [tuple(r) for r in similarity.node_similarity(g, 0.0, 50).collect()] == by_pairs(edges, 0.0)[:50]
    monkeypatch.setattr(similarity, "LISTED", 0)
    assert [tuple(r) for r in similarity.node_similarity(g, 0.3).collect()] == by_pairs(edges, 0.3)


def test_pairs_are_counted_by_similarity(spark):
    edges = random_edges(9)
    want: dict[float, int] = {}
    for _, _, s in by_pairs(edges, 0.0):
        want[round(s, 6)] = want.get(round(s, 6), 0) + 1
    assert {r["similarity"]: r["pairs"] for r in similarity.pairs_by_similarity(graph(spark, edges), 6).collect()} == want


def test_nodes_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(similarity.F, "xxhash64", lambda *c: similarity.F.lit(1).cast("long"))
    near = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "x long, y long")
    assert {(r["x"], r["rep"]) for r in similarity._classes(near).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_triangles(spark):
    edges = random_edges(11, m=260)
    near = {x: {b for a, b, _ in edges if a == x and b != x} | {a for a, b, _ in edges if b == x and a != x} for x in range(N)}
    want = [sum(b in near[a] for a in near[x] for b in near[x] if a < b) for x in range(N)]
    got = {r["node_id"] // 10: r["triangles"] for r in similarity.triangle_count(graph(spark, edges)).collect()}
    assert [got[i] for i in range(N)] == want and sum(want) > 0


def test_a_node_of_many_arcs_opens_few_wedges(spark):
    """40 nodes with the same 30 neighbours, each of which has one further: pairs of neighbours would be 40 * 435."""
    edges = [(a, 40 + b, 1.0) for a in range(40) for b in range(30)] + [(40 + b, 70 + b % 2, 1.0) for b in range(30)]
    arcs = spark.createDataFrame([(a, b) for a, b, _ in edges], "s long, t long")
    assert similarity._wedges(arcs).count() == 40 * 30
    assert {r["triangles"] for r in similarity.triangle_count(graph(spark, edges, 72)).collect()} == {0}


def test_loops_deal_more_rows_to_more_tasks(spark, monkeypatch):
    """A task's share of a round's sort and sums stays the same: more rows, more partitions, which Spark doesn't join up again."""
    from orrery import storage

    assert storage.shares(spark.range(100)) == 4
    monkeypatch.setattr(storage, "ROWS", 10)
    assert storage.shares(spark.range(100)) == 10 and storage.shares(spark.range(101), 2) == 21
    edges, dealt = random_edges(12), []
    repartition = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *c: (dealt.append((n, c)), repartition(df, n, *c))[1])
    labels = list(range(N))
    for _ in range(3):
        votes = [[labels[b] for a, b, _ in edges if a == x] + [labels[a] for a, b, _ in edges if b == x] for x in range(N)]
        labels = [min(v, key=lambda c, v=v: (-v.count(c), c)) if v else labels[x] for x, v in enumerate(votes)]
    g = graph(spark, edges)
    assert [r["community"] // 10 for r in community.communities(g, 3).orderBy("node_id").collect()] == labels
    assert {n for n, c in dealt if c in (("x",), ("y",))} == {-(-2 * len(edges) // 10)}
    score = np.full(N, 1 / N)
    for _ in range(3):
        got = np.zeros(N)
        for a, b, _ in edges:
            got[b] += score[a] / sum(x == a for x, _, _ in edges)
        score = 0.15 / N + 0.85 * got
    assert [r["score"] for r in rank.page_rank(g, 0.85, 3).orderBy("node_id").collect()] == pytest.approx(score.tolist())
    assert {n for n, c in dealt if c in (("src",), ("dst",))} == {-(-len(edges) // 10)}
