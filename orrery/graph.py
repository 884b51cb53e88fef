"""The property graph: an immutable bundle of node tables (by label set) and edge tables (by type)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.storage import cut


#: The column that holds a property named `id` (the column `id` is the node's or edge's own id).
USER_ID = "id_"


def column_of(key: str) -> str:
    return USER_ID if key == "id" else key


def key_of(column: str) -> str:
    return "id" if column == USER_ID else column


@dataclass(frozen=True)
class NodeTable:
    """df: id bigint and a column for each property (a property named id in the column USER_ID)."""

    labels: frozenset
    df: DataFrame
    parts: int = 1  # how many written tables df is the union of

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name != "id"}


@dataclass(frozen=True)
class EdgeTable:
    """df: id, src, dst bigint and a column for each property. Endpoint labels, if given, are promises that every
    end exists and has exactly that label, which let a pattern skip the join with the node table."""

    type: str
    df: DataFrame
    src_label: str | None = None
    dst_label: str | None = None
    parts: int = 1

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("id", "src", "dst")}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of two columns of one property: numbers widen, anything else becomes a string."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()
    return T.StringType()


def merged_props(tables) -> dict[str, T.DataType]:
    out: dict[str, T.DataType] = {}
    for t in tables:
        for k, kind in t.props.items():
            out[k] = common_type(out[k], kind) if k in out else kind
    return out


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    nodes: tuple = ()
    edges: tuple = ()
    name: str = "main"
    cached: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def from_tables(spark: SparkSession, nodes: list[NodeTable], edges: list[EdgeTable], name: str = "main") -> Graph:
        return Graph(spark, tuple(nodes), tuple(edges), name)

    def with_tables(self, nodes: tuple | None = None, edges: tuple | None = None) -> Graph:
        return replace(self, nodes=self.nodes if nodes is None else nodes, edges=self.edges if edges is None else edges, cached={})

    def node_tables(self, labels=()) -> list[NodeTable]:
        return [t for t in self.nodes if set(labels) <= t.labels]

    def edge_tables(self, types=()) -> list[EdgeTable]:
        return [t for t in self.edges if not types or t.type in types]

    # Whole-graph views, as the algorithms take them

    def vertices(self) -> DataFrame:
        """(id, user_id): user_id is the property `id` as a string, or null."""
        parts = []
        for t in self.nodes:
            user = F.col(USER_ID).cast("string") if USER_ID in t.props else F.lit(None).cast("string")
            parts.append(t.df.select("id", user.alias("user_id")))
        if not parts:
            return self.spark.createDataFrame([], "id long, user_id string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def links(self, weight: str | None = None) -> DataFrame:
        """(id, src, dst, weight): weight is the numeric property of that name, 1.0 where it is missing."""
        parts = []
        for t in self.edges:
            kind = t.props.get(weight) if weight else None
            w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if isinstance(kind, T.NumericType) else F.lit(1.0)
            parts.append(t.df.select("id", "src", "dst", w.alias("weight")))
        if not parts:
            return self.spark.createDataFrame([], "id long, src long, dst long, weight double")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # Cache control

    def cache(self) -> dict:
        if not self.cached:
            self.cached["v"], self.cached["e"] = self.vertices().persist(), self.links().persist()
        return {"status": "loaded", "nodes": self.cached["v"].count(), "edges": self.cached["e"].count()}

    def uncache(self) -> dict:
        for df in self.cached.values():
            df.unpersist()
        was = bool(self.cached)
        self.cached.clear()
        return {"status": "unloaded" if was else "not_loaded"}

    def is_cached(self) -> bool:
        return bool(self.cached)

    def stats(self) -> dict:
        return {"nodes": sum(t.df.count() for t in self.nodes), "edges": sum(t.df.count() for t in self.edges)}

    def save(self, path: str) -> None:
        """One Parquet folder for each table, with its kind and labels in the name of the folder."""
        rows = []
        for i, t in enumerate(self.nodes):
            t.df.write.mode("overwrite").parquet(f"{path}/n{i}")
            rows.append(("node", f"n{i}", sorted(t.labels), None, None))
        for i, t in enumerate(self.edges):
            t.df.write.mode("overwrite").parquet(f"{path}/e{i}")
            rows.append(("edge", f"e{i}", [t.type], t.src_label, t.dst_label))
        schema = "kind string, folder string, labels array<string>, src_label string, dst_label string"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/_tables.parquet")

    @staticmethod
    def load(spark: SparkSession, path: str, name: str = "main") -> Graph:
        nodes, edges = [], []
        for r in sorted(spark.read.parquet(f"{path}/_tables.parquet").collect(), key=lambda r: (len(r.folder), r.folder)):
            df = spark.read.parquet(f"{path}/{r.folder}")
            if r.kind == "node":
                nodes.append(NodeTable(frozenset(r.labels), df))
            else:
                edges.append(EdgeTable(r.labels[0], df, r.src_label, r.dst_label))
        return Graph(spark, tuple(nodes), tuple(edges), name)

    def settled(self) -> Graph:
        """The same graph with every table written to shared storage."""
        return self.with_tables(tuple(replace(t, df=cut(t.df, "graph")) for t in self.nodes), tuple(replace(t, df=cut(t.df, "graph")) for t in self.edges))
