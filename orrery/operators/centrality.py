"""Degree, betweenness and closeness centrality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.operators.common import parts
from orrery.operators.paths import shared_searches
from orrery.operators.tasks import Flat, in_tasks, numbered_graph
from orrery.storage import cut


def degree_centrality(g: Graph) -> DataFrame:
    """(node_id, user_id, in_degree, out_degree, degree)."""
    v, e = (g.cached["v"], g.cached["e"]) if g.cached else (g.vertices(), g.links())
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = v.join(d, "id", "left")
    return rows.select(F.col("id").alias("node_id"), "user_id", count("i").alias("in_degree"), count("o").alias("out_degree"), (count("i") + count("o")).alias("degree"))


def _summed(nodes: DataFrame, arcs: DataFrame, n: int, work, scale: float = 1.0) -> DataFrame:
    """(node_id, user_id, score): sums over tasks of what work(flat, k, tasks) -> array gives each node."""

    def rows(flat: Flat, k: int, tasks: int):
        total = work(flat, k, tasks)
        for lo in range(0, n, 100_000):
            at = lo + np.flatnonzero(total[lo : lo + 100_000])
            yield pa.RecordBatch.from_pydict({"nr": pa.array(at.astype(np.int32)), "s": pa.array(total[at])})

    sums = in_tasks(arcs, n, rows, "nr int, s double").groupBy("nr").agg((F.sum("s") / scale).alias("s"))
    return cut(nodes.join(sums, "nr", "left").select(F.col("id").alias("node_id"), "user_id", F.coalesce("s", F.lit(0.0)).alias("score")), "scores")


def _brandes(flat: Flat, source: int, weight: np.ndarray) -> np.ndarray:
    """Dependencies of all nodes on a source that counts as outside the graph, each target taken weight times; parallel edges count as
    paths of their own. A level with few out-arcs follows these, others take all in one sweep."""
    dist, sigma, few = np.full(flat.n, -1, np.int32), np.zeros(flat.n), len(flat.to) // 8
    ends, paths = np.unique(flat.to[flat.start[source] : flat.start[source + 1]], return_counts=True)
    dist[ends], sigma[ends], levels = 1, paths, [ends]
    while len(levels[-1]):
        now = levels[-1]
        if (flat.start[now + 1] - flat.start[now]).sum() <= few:
            x, y = flat.arcs_of(now)
            new = dist[y] < 0
            x, y = x[new], y[new]
            got = np.bincount(y, sigma[x], flat.n)
            at = np.unique(y)
        else:
            front = np.zeros(flat.n)
            front[now] = sigma[now]
            got = np.zeros(flat.n)
            got[flat.heads] = flat.pulled(front, np.add)
            at = np.flatnonzero((got > 0) & (dist < 0))
        dist[at], sigma[at] = len(levels) + 1, got[at]
        levels.append(at)
    delta, share = np.zeros(flat.n), np.zeros(flat.n)
    for below, now in zip(levels[:0:-1], levels[-2::-1], strict=True):
        share[below] = (weight[below] + delta[below]) / sigma[below]
        if (flat.start[now + 1] - flat.start[now]).sum() <= few:
            x, y = flat.arcs_of(now)
            got = np.bincount(x, share[y], flat.n)
        else:
            got = np.zeros(flat.n)
            got[flat.tails] = flat.summed(share)
        delta[now] = sigma[now] * got[now]
        share[below] = 0.0
    return delta


def betweenness_centrality(g: Graph) -> DataFrame:
    """(node_id, user_id, score): directed, unweighted, not normalised.

    Nodes with the same out-arcs share a search: it meets each of them as an end only, and counts it as a target of all but itself."""
    nodes, arcs, n = numbered_graph(*parts(g))

    def work(flat: Flat, k: int, tasks: int) -> np.ndarray:
        cls, reps = flat.twins()
        size, total = np.bincount(cls[cls >= 0], minlength=len(reps)), np.zeros(flat.n)
        for c in range(k, len(reps), tasks):
            total += _brandes(flat, int(reps[c]), size[c] - (cls == c).astype(float))
        return total

    return _summed(nodes, arcs, n, work)


def closeness_centrality(g: Graph) -> DataFrame:
    """(node_id, user_id, score): sum of 1 / distance to all others over undirected edges, over n - 1.

    A distance counts for its target, as it is the same both ways: so a level of a search of 64 sources adds to all nodes at once."""
    nodes, arcs, n = numbered_graph(*parts(g))
    near = arcs.select("s", "t").union(arcs.select("t", "s")).distinct()

    def work(flat: Flat, k: int, tasks: int) -> np.ndarray:
        total = np.zeros(flat.n)
        for sources, masks, members, bits in shared_searches(flat, k, tasks):
            for d, new in flat.levels(sources):
                for w, mask in masks:
                    total += np.bitwise_count(new & mask) * (w / d)
                total[members] -= (new[members] >> bits & np.uint64(1)) / d
        return total

    return _summed(nodes, near, n, work, max(1, n - 1))
