"""Label propagation and Louvain communities."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.operators.common import Csr, clamp, parts, renumbered, with_users
from orrery.operators.tasks import in_one_task, numbered_graph
from orrery.storage import cut, shares

UNROLLED = 3


def _labels(v: DataFrame, e: DataFrame, iterations: int) -> DataFrame:
    """(node_id, label) after synchronous rounds: the most frequent label among in- and out-neighbours, ties to the smallest.

    A round that changes nothing leaves a fixed point, so later rounds need no test for it; one is made where the
    labels are written out anyway.
    """
    n = shares(e, 2)
    ends = e.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(e.select("dst", "src")).repartition(n, "y")
    near = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")).sortWithinPartitions("y").persist(StorageLevel.MEMORY_AND_DISK)
    base = cut(v.select("id"), "labels")
    labels, left = base.select("id", F.col("id").alias("label")), iterations
    while left:
        steps = min(UNROLLED, left)
        for _ in range(steps):
            before = labels
            votes = near.join(labels, near["y"] == labels["id"]).repartition(n, "x").groupBy("x", "label").agg(F.sum("k").alias("k"))  # both sums where x is
            best = votes.groupBy("x").agg(F.max(F.struct("k", (-F.col("label")).alias("l"))).alias("m"))
            labels = base.join(best, base["id"] == best["x"], "left").select("id", F.coalesce(-F.col("m.l"), F.col("id")).alias("label"))
        left -= steps
        if left:
            both = cut(labels.join(before.withColumnRenamed("label", "old"), "id"), "labels")
            labels = both.select("id", "label")
            if both.filter("label <> old").isEmpty():
                break
        else:
            labels = cut(labels, "labels")
    near.unpersist()
    return labels.select(F.col("id").alias("node_id"), "label")


def label_propagation(g: Graph, iterations: int = 10) -> DataFrame:
    """(node_id, user_id, community) in node order; communities numbered from 0 in the order of their smallest node."""
    v, e = parts(g)
    rows = renumbered(_labels(v, e, clamp(int(iterations), 1, 100)), "label", "community")
    return with_users(rows, v, "node_id", "user_id", "community").orderBy("node_id")


def communities(g: Graph, iterations: int = 10) -> DataFrame:
    """(node_id, community): the label itself, a node's id, is the community."""
    v, e = parts(g)
    return _labels(v, e, clamp(int(iterations), 1, 50)).withColumnRenamed("label", "community").orderBy("community", "node_id")


def community_of(g: Graph, node_id: int, iterations: int = 10) -> DataFrame:
    return communities(g, iterations).filter(F.col("node_id") == node_id).select("community")


def community_members(g: Graph, community: int, iterations: int = 10) -> DataFrame:
    return communities(g, iterations).filter(F.col("community") == community).select("node_id")


def community_count(g: Graph, iterations: int = 10) -> DataFrame:
    return communities(g, iterations).select(F.count_distinct("community").alias("community_count"))


def _local_moves(start: np.ndarray, near: np.ndarray, resolution: float) -> np.ndarray:
    """Communities after passes of single moves, in node order, by the gain in modularity. near: ends of in- and out-edges."""
    n, m = len(start) - 1, len(near) // 2
    comp = np.arange(n, dtype=np.int32)
    if not m:
        return comp
    degree = np.diff(start).astype(float)
    loops = np.zeros(n, bool)
    for lo in range(0, n, 100_000):
        own = np.repeat(np.arange(lo, min(lo + 100_000, n)), np.diff(start[lo : lo + 100_001]))
        loops[own[near[start[lo] : start[min(lo + 100_000, n)]] == own]] = True
    total, at, ks = array("d", degree), memoryview(start), memoryview(degree)
    for _ in range(100):
        moved = False
        for i in range(n):
            near_i = near[at[i] : at[i + 1]]
            if loops[i]:
                near_i = near_i[near_i != i]
            if not len(near_i):
                continue
            own, k = int(comp[i]), ks[i]
            if len(near_i) < 200:
                links: dict[int, int] = {}
                for c in comp[near_i].tolist():
                    links[c] = links.get(c, 0) + 1
            else:
                links = dict(zip(*(x.tolist() for x in np.unique(comp[near_i], return_counts=True)), strict=True))
            total[own] -= k
            best, best_gain = own, links.get(own, 0) / m - resolution * total[own] * k / (2.0 * m * m)
            for c in sorted(links):
                if (x := links[c] / m - resolution * total[c] * k / (2.0 * m * m)) > best_gain + 1e-12:
                    best, best_gain = c, x
            total[best] += k
            if best != own:
                comp[i], moved = best, True
        if not moved:
            break
    return comp


def louvain(g: Graph, resolution: float = 1.0) -> DataFrame:
    """(node_id, user_id, community): one level of local moving, which depends on the order of nodes and so runs in one task."""
    nodes, arcs, n = numbered_graph(*parts(g))

    def work(start, near, more):
        comp = _local_moves(start, near, resolution)
        for lo in range(0, n, 100_000):
            yield pa.RecordBatch.from_pydict({"nr": np.arange(lo, min(lo + 100_000, n), dtype=np.int32), "label": comp[lo : lo + 100_000].astype(np.int64)})

    both = arcs.union(arcs.select(F.col("t").alias("s"), F.col("s").alias("t"), "edge"))
    rows = in_one_task(both, n, work, "nr int, label long").join(nodes, "nr").select(F.col("id").alias("node_id"), "label")
    return with_users(renumbered(rows, "label", "community"), nodes, "node_id", "user_id", "community").orderBy("node_id")


def modularity(csr: Csr, comp: np.ndarray, resolution: float = 1.0) -> float:
    m = len(csr.src)
    degree = np.bincount(csr.src, minlength=csr.n) + np.bincount(csr.dst, minlength=csr.n)
    inside = float((comp[csr.src] == comp[csr.dst]).sum()) / m
    mass = np.bincount(comp, weights=degree)
    return inside - resolution * float(((mass / (2.0 * m)) ** 2).sum())
