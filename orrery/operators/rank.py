"""PageRank, plain and personalised, and eigenvector centrality: rank vectors by repeated join and sum."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.operators.common import clamp, dealt, parts, with_users
from orrery.storage import cut, shares

UNROLLED = 4  # iterations planned between two written rank tables


def _weighted(e: DataFrame, n: int) -> DataFrame:
    """Edges, parallel ones merged, with their share of the source's rank; dealt to n partitions by source once, and kept there."""
    each = e.select("src", "dst").repartition(n, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    out = F.sum("k").over(W.partitionBy("src"))
    return each.select("src", "dst", (F.col("k") / out).alias("share")).sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)


def _spread(ranks: DataFrame, edges: DataFrame, value: Column, base: DataFrame, n: int) -> DataFrame:
    got = edges.join(ranks, edges["src"] == ranks["id"]).select("dst", value.alias("value")).repartition(n, "dst").groupBy("dst").agg(F.sum("value").alias("got"))
    return base.join(got, base["id"] == got["dst"], "left").drop("dst")


def page_rank(g: Graph, damping: float = 0.85, iterations: int = 20, seeds: list[str] | None = None) -> DataFrame:
    """(node_id, user_id, score) by falling score.

    score = (1 - d) / N + d * sum of the in-neighbours' score over their out-degree; what nodes without out-edges hold is lost.
    With seeds (user ids), the start and the jumps are uniform over these. Stops early once no score moves by 1e-6.
    """
    iterations = clamp(int(iterations), 1, 100)
    v, e = parts(g)
    n, deal = v.count(), shares(e)
    edges = _weighted(e, deal)
    if seeds is None:
        base = v.select("id", F.lit(1.0 / max(n, 1)).alias("jump"))
    else:
        k = v.filter(F.col("user_id").isin(seeds)).count()
        base = v.select("id", F.when(F.col("user_id").isin(seeds), F.lit(1.0 / max(k, 1))).otherwise(0.0).alias("jump"))
    base = cut(base, "ranks")
    ranks, left = base.select("id", F.col("jump").alias("rank")), iterations
    while left:
        steps = min(UNROLLED, left)
        for _ in range(steps):
            before = ranks
            got = _spread(ranks, edges, F.col("rank") * F.col("share"), base, deal)
            ranks = got.select("id", ((1 - damping) * F.col("jump") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        left -= steps
        if left and seeds is None:
            both = cut(ranks.join(before.withColumnRenamed("rank", "old"), "id"), "ranks")
            ranks = both.select("id", "rank")
            if (both.select(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < 1e-6:
                break
        else:
            ranks = cut(ranks, "ranks")
    edges.unpersist()
    rows = with_users(ranks.select(F.col("id").alias("node_id"), "rank"), v, "node_id", "user_id", F.col("rank").alias("score"))
    return rows.orderBy(F.desc("score"), "node_id")


def top_page_rank(g: Graph, k: int = 10, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    return page_rank(g, damping, iterations).limit(clamp(int(k), 1, 1000))


def eigenvector_centrality(g: Graph, iterations: int = 100) -> DataFrame:
    """(node_id, user_id, score) by falling score: power iteration over in-edges, unit length, from equal values;
    a vector that vanishes becomes uniform; stops once the change is below 1e-10."""
    v, e = parts(g)
    n = v.count()
    deal = shares(e)
    edges = dealt(cut(e.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("k")), "edges"), "src")
    start = 1.0 / math.sqrt(n) if n else 0.0
    base = cut(v.select("id"), "base")
    x = base.select("id", F.lit(start).alias("x"))
    for _ in range(clamp(int(iterations), 1, 1000)):
        new = cut(_spread(x, edges, F.col("x") * F.col("k"), base, deal).select("id", F.coalesce("got", F.lit(0.0)).alias("y")), "power")
        norm = math.sqrt(new.select(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0)
        scaled = new.select("id", (F.col("y") / norm if norm >= 1e-15 else F.lit(start)).alias("z"))
        change = scaled.join(x, "id").select(F.sqrt(F.sum(F.pow(F.col("z") - F.col("x"), 2)))).first()[0]
        x = scaled.select("id", F.col("z").alias("x"))
        if norm < 1e-15 or (change or 0.0) < 1e-10:
            break
    edges.unpersist()
    return with_users(x.withColumnRenamed("id", "node_id"), v, "node_id", "user_id", F.col("x").alias("score")).orderBy(F.desc("score"), "node_id")
