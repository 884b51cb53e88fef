"""What the graph algorithms share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.storage import cut, shares

#: Up to so many edges, Dijkstra and strong components run on the driver, which saves jobs; beyond, in their distributed forms.
LOCAL_EDGES = 100_000


def clamp(x, low, high):
    return max(low, min(high, x))


def parts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Vertices and links: of the cached graph if there is one, else written out once for the loops to come."""
    if g.cached:
        return g.cached["v"], g.cached["e"]
    return cut(g.vertices(), "vertices"), cut(g.links(), "links")


def is_local(links: DataFrame) -> bool:
    return links.count() <= LOCAL_EDGES


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key, sorted, and kept on the executors' disks, so that the joins of a loop on key move only their
    other side. What a lost executor held is made again from the table. The caller unpersists it."""
    return df.repartition(shares(df), key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


class Csr:
    """Adjacency of a graph in flat arrays, nodes by ascending id, neighbours by ascending edge id."""

    def __init__(self, v: pd.DataFrame, e: pd.DataFrame):
        v = v.sort_values("id")
        self.ids = v["id"].to_numpy(np.int64)
        self.user = v["user_id"].tolist()
        e = e.sort_values("id")
        self.src = np.searchsorted(self.ids, e["src"].to_numpy(np.int64))
        self.dst = np.searchsorted(self.ids, e["dst"].to_numpy(np.int64))
        self.weight = e["weight"].to_numpy(float)
        self.n = len(self.ids)
        self.out = self._index(self.src, self.dst)
        self.into = self._index(self.dst, self.src)

    def _index(self, a: np.ndarray, b: np.ndarray):
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(self.n + 1)), b[order], self.weight[order]

    def neighbours(self, i: int) -> np.ndarray:
        start, to, _ = self.out
        return to[start[i] : start[i + 1]]

    def both(self, i: int) -> np.ndarray:
        (s, a, _), (t, b, _) = self.out, self.into
        return np.concatenate((a[s[i] : s[i + 1]], b[t[i] : t[i + 1]]))

    def find(self, user: str) -> int | None:
        try:
            return self.user.index(user)
        except ValueError:
            return None


def local_csr(v: DataFrame, e: DataFrame) -> Csr:
    """The whole graph on the driver, after a check of its size."""
    if not is_local(e):
        raise ValueError(f"the local form takes at most {LOCAL_EDGES} edges")
    return Csr(v.select("id", "user_id").toPandas(), e.select("id", "src", "dst", "weight").toPandas())


def with_users(rows: DataFrame, v: DataFrame, *columns) -> DataFrame:
    """rows(node_id, ...) joined with user_id of v, as columns."""
    return rows.join(v.select(F.col("id").alias("node_id"), "user_id"), "node_id").select(*columns)


def renumbered(rows: DataFrame, label: str, name: str) -> DataFrame:
    """rows(node_id, label) with label replaced by 0, 1, ... in the order of each group's smallest node_id."""
    from orrery.plans.writes import numbered

    groups = rows.groupBy(label).agg(F.min("node_id").alias("_first"))
    order, _ = numbered(groups.orderBy("_first"), "_nr")
    return rows.join(order.select(label, F.col("_nr").cast("long").alias(name)), label)
