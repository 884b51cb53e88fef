"""Breadth-first and depth-first traversal from the node with a given property `id`."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.operators.common import parts, with_users
from orrery.operators.tasks import in_one_task, numbered_graph
from orrery.storage import cut

SCHEMA = "node_id long, user_id string, depth long, `order` long"


def bfs(g: Graph, start: str, max_depth: int = -1) -> DataFrame:
    """(node_id, user_id, depth, order) along out-edges to max_depth (-1: any); order as a queue would give it:
    by the order of the parent, then the edge id."""
    from orrery.plans.writes import numbered

    v, e = parts(g)
    first = v.filter(F.col("user_id") == start).agg(F.min("id").alias("node_id")).filter("node_id is not null")
    level = cut(first.select("node_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("order")), "bfs")
    seen, depth, count = level, 0, 1
    while max_depth < 0 or depth < max_depth:
        depth += 1
        hits = level.join(e, level["node_id"] == e["src"]).select(F.col("dst").alias("to"), F.struct("order", F.col("id").alias("edge")).alias("by"))
        new = hits.groupBy("to").agg(F.min("by").alias("by")).withColumnRenamed("to", "node_id").join(seen, "node_id", "left_anti")
        ranked, n = numbered(new.orderBy("by.order", "by.edge"))
        if not n:
            break
        level = cut(ranked.select("node_id", F.lit(depth).cast("long").alias("depth"), (F.col("row") + count).cast("long").alias("order")), "bfs")
        seen, count = seen.union(level), count + n
    return with_users(seen, v, "node_id", "user_id", "depth", "order").orderBy("order")


def dfs(g: Graph, start: str, max_depth: int = -1) -> DataFrame:
    """(node_id, user_id, depth, order) in preorder, neighbours by edge id. Each step depends on the one before, so one task walks."""
    v, e = parts(g)
    nodes, arcs, n = numbered_graph(v, e)
    first = nodes.filter(F.col("user_id") == start).agg(F.min("nr")).first()[0]
    if first is None:
        return g.spark.createDataFrame([], SCHEMA)

    def work(begin, to, more):
        met, depths, stack, seen = array("i", [first]), array("i", [0]), array("i", [first]), bytearray(n)
        at, end, ends = memoryview(begin[:-1].copy()), memoryview(begin[1:]), memoryview(to)
        seen[first] = 1
        while stack:
            x = stack[-1]
            p, last = at[x], end[x]
            while p < last and seen[ends[p]]:
                p += 1
            if p == last or len(stack) > max_depth >= 0:
                stack.pop()
                continue
            at[x] = p + 1
            y = ends[p]
            seen[y] = 1
            met.append(y)
            depths.append(len(stack))
            stack.append(y)
        nr, depth = np.frombuffer(met, np.int32), np.frombuffer(depths, np.int32)
        for lo in range(0, len(nr), 100_000):
            part = slice(lo, min(lo + 100_000, len(nr)))
            yield pa.RecordBatch.from_pydict({"nr": nr[part], "depth": depth[part].astype(np.int64), "order": np.arange(part.start, part.stop)})

    rows = in_one_task(arcs, n, work, "nr int, depth long, `order` long").join(nodes, "nr")
    return rows.select(F.col("id").alias("node_id"), "user_id", "depth", "order").orderBy("order")
