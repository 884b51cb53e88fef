"""Shortest paths between nodes given by their property `id`, and all pairs."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.graph import Graph, column_of
from orrery.operators.common import Csr, is_local, local_csr, parts
from orrery.operators.tasks import WORD, Flat, in_one_task, in_tasks, numbered_graph
from orrery.storage import cut

FOUND = "path array<string>, distance double, found boolean"
EARTH_KM = 6371.0


def _heap(csr: Csr, s: int, t: int) -> tuple[list[int], float] | None:
    dist, pred, done, heap = {s: 0.0}, {}, set(), [(0.0, s)]
    start, to, weight = csr.out
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        if x == t:
            path = [x]
            while path[-1] != s:
                path.append(pred[path[-1]])
            return path[::-1], d
        for y, w in zip(to[start[x] : start[x + 1]].tolist(), weight[start[x] : start[x + 1]].tolist(), strict=True):
            if y not in dist or d + w < dist[y] or (d + w == dist[y] and y not in done and x < pred.get(y, csr.n)):
                dist[y], pred[y] = d + w, x
                heapq.heappush(heap, (d + w, y))
    return None


def dijkstra(g: Graph, source: str, target: str, weight: str | None = None, distributed: bool | None = None) -> DataFrame:
    """One row (path of user ids, distance, found): directed, weights from a numeric property (missing: 1.0), the least of
    parallel edges. Of equal paths the predecessor with the smaller id is taken."""
    v = cut(g.vertices(), "vertices")
    e = cut(g.links(weight), "links")
    if distributed is None:
        distributed = not is_local(e)
    if distributed:
        found = _relax(v, e, source, target)
        if found is not None:
            return g.spark.createDataFrame([(found[0], found[1], True)], FOUND)
    else:
        csr = local_csr(v, e)
        s, t = csr.find(source), csr.find(target)
        if s is not None and t is not None and (got := _heap(csr, s, t)) is not None:
            return g.spark.createDataFrame([([csr.user[i] for i in got[0]], got[1], True)], FOUND)
    return g.spark.createDataFrame([([], None, False)], FOUND)


def _relax(v: DataFrame, e: DataFrame, source: str, target: str) -> tuple[list[str], float] | None:
    """Bellman-Ford: nodes whose distance fell in a round send it on in the next, until none falls. At equal distance the smaller
    predecessor stays (over an arc of weight 0 only the first, so that predecessors make no circle)."""
    edges = cut(e.groupBy("src", "dst").agg(F.min("weight").alias("w")), "edges")
    ends = {r["user_id"]: r["id"] for r in v.filter(F.col("user_id").isin(source, target)).groupBy("user_id").agg(F.min("id").alias("id")).collect()}
    if source not in ends or target not in ends:
        return None
    best = cut(v.filter(F.col("id") == ends[source]).select("id", F.lit(0.0).alias("d"), F.lit(-1).cast("long").alias("pred")), "dist")
    front = best
    while not front.isEmpty():
        offers = front.join(edges, front["id"] == edges["src"]).groupBy("dst").agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), F.col("src").alias("pred"), (F.col("w") > 0).alias("up"))).alias("o"))
        both = cut(best.join(offers, best["id"] == offers["dst"], "full").select(F.coalesce("id", "dst").alias("id"), F.col("d").alias("old"), F.col("pred").alias("oldp"), "o"), "dist")
        better = F.col("o").isNotNull() & (F.col("old").isNull() | (F.col("o.d") < F.col("old")))
        named = better | F.coalesce((F.col("o.d") == F.col("old")) & F.col("o.up") & (F.col("o.pred") < F.col("oldp")), F.lit(False))
        best = both.select("id", F.when(better, F.col("o.d")).otherwise(F.col("old")).alias("d"), F.when(named, F.col("o.pred")).otherwise(F.col("oldp")).alias("pred"))
        front = both.filter(better).select("id", F.col("o.d").alias("d"), F.col("o.pred").alias("pred"))
    at = best.filter(F.col("id") == ends[target]).first()
    if at is None:
        return None
    path, distance = [ends[target]], at["d"]
    while path[-1] != ends[source]:
        path.append(best.filter(F.col("id") == path[-1]).first()["pred"])
    names = {r["id"]: r["user_id"] for r in v.filter(F.col("id").isin(path)).collect()}
    return [names[i] for i in reversed(path)], distance


def astar(g: Graph, source: str, target: str, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """One row (path, distance, found, nodes_explored): best-first by hops plus an estimate, which is the
    great-circle distance in km for properties called lat or latitude, else the straight line, else 0.

    Without an estimate the search goes level by level over joins; with one, its order is sequential, so it runs in one task."""
    v, e = parts(g)
    ends = {r["user_id"]: r["id"] for r in v.filter(F.col("user_id").isin(source, target)).groupBy("user_id").agg(F.min("id").alias("id")).collect()}
    schema = f"{FOUND}, nodes_explored long"
    if source not in ends or target not in ends:
        return g.spark.createDataFrame([([], None, False, 0)], schema)
    place = None
    if lat and lon:
        for table in g.nodes:
            have = table.props
            if all(isinstance(have.get(column_of(k)), T.NumericType) for k in (lat, lon)):
                at = table.df.select("id", F.col(column_of(lat)).cast("double").alias("x"), F.col(column_of(lon)).cast("double").alias("y")).dropna()
                place = at if place is None else place.union(at)
    search = _best_first(v, e, ends[source], ends[target], place, (lat or "").lower() in ("lat", "latitude")) if place is not None else _by_levels(v, e, ends[source], ends[target])
    path, explored = search
    if not path:
        return g.spark.createDataFrame([([], None, False, explored)], schema)
    names = {r["id"]: r["user_id"] for r in v.filter(F.col("id").isin(path)).collect()}
    return g.spark.createDataFrame([([names[i] for i in path], float(len(path) - 1), True, explored)], schema)


def _by_levels(v: DataFrame, e: DataFrame, s: int, t: int) -> tuple[list[int], int]:
    """Ids along the path and the nodes taken up: all of the levels before, and those of the last whose id is not above the target's."""
    seen = level = cut(v.filter(F.col("id") == s).select("id", F.lit(-1).cast("long").alias("pred")), "levels")
    done, before = [], 0
    while True:
        here = level.select(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("id") == t, F.col("pred"))).alias("pred"), F.count_if(F.col("id") <= t).alias("low")).first()
        if here["pred"] is not None:
            path, pred = [t], here["pred"]
            for rows in reversed(done):
                path.append(pred)
                pred = rows.filter(F.col("id") == pred).first()["pred"]
            return path[::-1], before + here["low"]
        if not here["n"]:
            return [], before
        done.append(level)
        before += here["n"]
        hits = e.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("pred"))
        level = cut(hits.join(seen, "id", "left_anti").select("id", "pred"), "levels")
        seen = seen.union(level)


def _best_first(v: DataFrame, e: DataFrame, s: int, t: int, place: DataFrame, round_earth: bool) -> tuple[list[int], int]:
    nodes, arcs, n = numbered_graph(v, e)
    number = {r["id"]: r["nr"] for r in nodes.filter(F.col("id").isin(s, t)).collect()}
    first, last = number[s], number[t]

    def work(start, to, more):
        at, x, y = np.zeros(n, bool), np.empty(n), np.empty(n)
        for i, a, b in more:
            at[i], x[i], y[i] = True, a, b

        def guess(i: int) -> float:
            if not at[i] or not at[last]:
                return 0.0
            if not round_earth:
                return math.dist((x[i], y[i]), (x[last], y[last]))
            p, q = math.radians(x[i]), math.radians(x[last])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y[last] - y[i]) / 2) ** 2
            return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))

        cost, pred, done, heap, explored, path = {first: 0.0}, {}, bytearray(n), [(guess(first), first)], 0, []
        while heap and not path:
            _, i = heapq.heappop(heap)
            if done[i]:
                continue
            done[i] = 1
            explored += 1
            if i == last:
                path = [i]
                while path[-1] != first:
                    path.append(pred[path[-1]])
            for j in to[start[i] : start[i + 1]].tolist() if not path else ():
                if not done[j] and cost[i] + 1.0 < cost.get(j, math.inf):
                    cost[j], pred[j] = cost[i] + 1.0, i
                    heapq.heappush(heap, (cost[j] + guess(j), j))
        out = path[::-1] or [-1]
        yield pa.RecordBatch.from_pydict({"step": pa.array(range(len(out)), pa.int64()), "nr": pa.array(out, pa.int32()), "explored": pa.array([explored] * len(out), pa.int64())})

    rows = in_one_task(arcs, n, work, "step long, nr int, explored long", place.join(nodes, "id").select("nr", "x", "y"))
    steps = rows.join(nodes, "nr", "left").select("step", "id", "explored").orderBy("step").collect()
    return [r["id"] for r in steps if r["id"] is not None], steps[0]["explored"]


def all_pairs(g: Graph) -> DataFrame:
    """(source, target, distance) of all ordered pairs of different nodes with a directed path, by node ids; user ids are given
    where nodes have them, else the node ids as strings.

    Each task searches from its own run of sources, 64 at a time, and gives the rows in order: no pair is moved or kept."""
    nodes, arcs, n = numbered_graph(*parts(g))
    schema = pa.schema([("s", pa.int32()), ("t", pa.int32()), ("distance", pa.float64())])

    def work(flat: Flat, k: int, tasks: int):
        lo, hi, wide = n * k // tasks, n * (k + 1) // tasks, max(1, min(WORD, (1 << 24) // n))
        for first in range(lo, hi, wide):
            block = np.arange(first, min(first + wide, hi))
            dist = np.zeros((len(block), n), np.int32)
            for d, new in flat.levels(block):
                hit = np.flatnonzero(new)
                at, bit = np.nonzero(np.unpackbits(new[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                dist[bit, hit[at]] = d
            dist[np.arange(len(block)), block] = 0
            for i, row in zip(block.tolist(), dist, strict=True):
                t = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), i, np.int32)), pa.array(t.astype(np.int32)), pa.array(row[t].astype(float))], schema=schema)

    name = F.coalesce("user_id", F.col("id").cast("string"))
    a, b = (F.broadcast(nodes.select(F.col("nr").alias(k), name.alias(c))) for k, c in (("s", "source"), ("t", "target")))
    return in_tasks(arcs.select("s", "t").distinct(), n, work, "s int, t int, distance double").join(a, "s").join(b, "t").select("source", "target", "distance")


def pairs_by_distance(g: Graph) -> DataFrame:
    """(distance, pairs): how many of the rows of all_pairs have each distance. Every pair is met and counted where it is found, and
    nodes with the same out-arcs share a search."""
    _, arcs, n = numbered_graph(*parts(g))

    def work(flat: Flat, k: int, tasks: int):
        total: dict[int, int] = {}
        for sources, masks, members, bits in shared_searches(flat, k, tasks):
            for d, new in flat.levels(sources):
                found = sum(w * int(np.bitwise_count(new & mask).sum()) for w, mask in masks)
                total[d] = total.get(d, 0) + found - int((new[members] >> bits & np.uint64(1)).sum())
        yield pa.RecordBatch.from_pydict({"distance": pa.array(list(total), pa.float64()), "k": pa.array(total.values(), pa.int64())})

    rows = in_tasks(arcs.select("s", "t").distinct(), n, work, "distance double, k long")
    return rows.groupBy("distance").agg(F.sum("k").alias("pairs")).filter("pairs > 0")


def shared_searches(flat: Flat, k: int, tasks: int):
    """(sources, masks, members, bits): this task's classes of nodes with the same out-arcs, 64 at a time. sources: one node of each;
    masks (w, mask): the bits of the classes of w nodes; members of all these classes, and the bit of each."""
    cls, reps = flat.twins()
    by_class = np.argsort(cls, kind="stable")
    first = np.searchsorted(cls[by_class], np.arange(len(reps) + 1))
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    for lo in range(k * WORD, len(order), tasks * WORD):
        block = order[lo : lo + WORD]
        masks = [(int(w), np.uint64(sum(1 << int(j) for j in np.flatnonzero(size[block] == w)))) for w in np.unique(size[block])]
        members = np.concatenate([by_class[first[c] : first[c + 1]] for c in block])
        yield reps[block], masks, members, np.repeat(np.arange(len(block)), size[block]).astype(np.uint64)
