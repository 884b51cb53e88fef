"""Connected components of undirected and directed graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.operators.common import Csr, is_local, parts, renumbered, with_users
from orrery.storage import cut


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a table of edges(a, b) whose size has been checked, by minima and pointer jumping in one task."""

    def work(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, at = np.unique(np.concatenate([t.column(i).to_numpy() for i in range(2)]), return_inverse=True)
        a, b, root = at[: t.num_rows], at[t.num_rows :], np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, root[a], root[b])
            np.minimum.at(low, root[b], root[a])
            low = low[low]
            if (low == root).all() and (root[a] == root[b]).all():
                break
            root = low
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(1).mapInArrow(work, "node long, component long"), "cc-roots")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 0) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Each round maps a node to the smallest member of its closed neighbourhood, in an order
    that a hash salted by the round sets, and contracts the edges along that map; the edge
    table shrinks geometrically whatever the ids look like (an ordered path would take n
    rounds under plain minima). Only grouped minima and equi-joins are used: a hub is
    pre-aggregated on the map side, and a skewed join side can be split by AQE. Nulls in
    either end and self links add no edge (a self link keeps its node). No edges: no rows.
    Up to `small` edges (long ids) are joined up in one task instead, which saves dozens of jobs.
    """
    first = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    e = cut(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if small and e.count() <= small:
        return _in_one_task(e)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    e, maps, turn = e.filter("a <> b"), [], 0
    while not e.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        ends = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy("a").agg(F.min(order("b")).alias("m"))
        m = cut(best.select(F.col("a").alias("node"), F.least("m", order("a"))["n"].alias("root")), "cc-map")
        maps.append(m)
        to_a, to_b = (m.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        moved = e.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
        e = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        turn += 1
    out = nodes.withColumn("root", F.col("node"))
    for m in maps:
        step = m.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = cut(out, "cc-roots")
    low = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(low, "root").select("node", "component")


def wcc(g: Graph) -> DataFrame:
    """(node_id, user_id, component): components numbered from 0 in the order of their smallest node."""
    v, e = parts(g)
    comp = connected_components(e, "src", "dst")
    rows = v.join(comp, v["id"] == comp["node"], "left").select(F.col("id").alias("node_id"), F.coalesce("component", "id").alias("root"))
    return with_users(renumbered(cut(rows, "wcc"), "root", "component"), v, "node_id", "user_id", "component")


def _tarjan(csr: Csr) -> list[int]:
    """Strong component of each node (as the smallest member), without recursion."""
    index, low, on, comp, stack, count = [-1] * csr.n, [0] * csr.n, [False] * csr.n, [0] * csr.n, [], 0
    for root in range(csr.n):
        if index[root] >= 0:
            continue
        work = [(root, iter(csr.neighbours(root).tolist()))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            x, todo = work[-1]
            for y in todo:
                if index[y] < 0:
                    index[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    on[y] = True
                    work.append((y, iter(csr.neighbours(y).tolist())))
                    break
                if on[y]:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == index[x]:
                    members = []
                    while True:
                        y = stack.pop()
                        on[y] = False
                        members.append(y)
                        if y == x:
                            break
                    for y in members:
                        comp[y] = min(members)
    return comp


def _closure(seeds: DataFrame, e: DataFrame, a: str, b: str) -> DataFrame:
    """(node, colour) reached from seeds(node, colour) along a -> b among nodes of the same colour."""
    reached = front = seeds
    while True:
        step = front.join(e, front["node"] == e[a]).select(F.col(b).alias("node"), "colour").distinct()
        front = cut(step.join(reached, ["node", "colour"], "left_anti"), "scc-front")
        if front.isEmpty():
            return reached
        reached = reached.union(front)


def scc_distributed(v: DataFrame, e: DataFrame) -> DataFrame:
    """(node, root): strong components by colouring. Each round spreads the smallest id forward until nothing changes;
    the nodes of a colour that reach its root backwards are the root's component, and the rest goes to the next round."""
    left, done = cut(v.select(F.col("id").alias("node")), "scc"), None
    e = e.select("src", "dst").filter("src <> dst").distinct()
    while not left.isEmpty():
        inside = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc-edges")
        colours = left.withColumn("colour", F.col("node"))
        while True:
            got = inside.join(colours, inside["src"] == colours["node"]).groupBy("dst").agg(F.min("colour").alias("c"))
            new = cut(colours.join(got, colours["node"] == got["dst"], "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")), "scc-colours")
            colours = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        ca, cb = colours.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        within = cut(inside.join(ca, "src").join(cb, "dst").filter("ca = cb").select("src", "dst"), "scc-within")
        comp = cut(_closure(colours.filter("node = colour"), within, "dst", "src").select("node", F.col("colour").alias("root")), "scc-found")
        done = comp if done is None else done.union(comp)
        left = cut(left.join(comp, "node", "left_anti"), "scc")
    return done if done is not None else v.select(F.col("id").alias("node"), F.col("id").alias("root"))


def scc(g: Graph, distributed: bool | None = None) -> DataFrame:
    """(node_id, user_id, component): strong components numbered from 0 in the order of their smallest node."""
    v, e = parts(g)
    if distributed is None:
        distributed = not is_local(e)
    if distributed:
        rows = scc_distributed(v, e).select(F.col("node").alias("node_id"), "root")
    else:
        from orrery.operators.common import local_csr

        csr = local_csr(v, e)
        comp = _tarjan(csr)
        rows = g.spark.createDataFrame(pd.DataFrame({"node_id": csr.ids, "root": csr.ids[comp] if csr.n else csr.ids}), "node_id long, root long")
    return with_users(renumbered(cut(rows, "scc"), "root", "component"), v, "node_id", "user_id", "component")
