"""The graph as an object: nodes and edges by the property `id`, neighbourhoods, bulk loading and algorithms."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.graph import USER_ID, EdgeTable, Graph, NodeTable, column_of, common_type
from orrery.operators import centrality, community, components, paths, rank, similarity, traversal
from orrery.plans.lexer import KEYWORDS
from orrery.plans.writes import add_edges, add_nodes, next_id, numbered
from orrery.session import Result, Session
from orrery.storage import cut


def sanitize_rel_type(name: str) -> str:
    """A relationship type of letters, digits and _, not starting with a digit and no keyword."""
    out = re.sub(r"\W", "_", name) or "RELATED"
    out = f"REL_{out}" if out[0].isdigit() else out
    return f"REL_{out}" if out.lower() in KEYWORDS else out


def escape_string(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def format_props(props: dict) -> str:
    """A property map in the query language."""

    def one(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return repr(v) if isinstance(v, (int, float)) else f"'{escape_string(str(v))}'"

    return "{" + ", ".join(f"`{k}`: {one(v)}" for k, v in props.items()) + "}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class PropertyGraph:
    """A session with helpers. Every change makes a new version; `graph` is the current one."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, name: str = "main"):
        self.spark = spark
        self.session = Session(spark, graph or Graph(spark, name=name), main=name)

    @property
    def graph(self) -> Graph:
        return self.session.graph

    def query(self, text: str, params: dict | None = None) -> Result:
        return self.session.cypher(text, params)

    # Nodes

    def _node_rows(self, match: str, params: dict | None = None) -> list[dict]:
        return [self._as_node(r["n"]) for r in self.query(f"{match} RETURN n", params)]

    @staticmethod
    def _as_node(row) -> dict:
        p = row["properties"]
        p = p.asDict() if hasattr(p, "asDict") else dict(p)
        return {"id": row["id"], "labels": list(row["labels"]), "properties": {k: v for k, v in p.items() if v is not None}}

    def has_node(self, node_id: str) -> bool:
        return bool(self.query("MATCH (n {id: $id}) RETURN count(n) AS n", {"id": node_id})[0]["n"])

    def get_node(self, node_id: str) -> dict | None:
        rows = self._node_rows("MATCH (n {id: $id})", {"id": node_id})
        return rows[0] if rows else None

    def upsert_node(self, node_id: str, props: dict | None = None, label: str = "Entity") -> None:
        """Set each property of the node, or create it; the label counts on creation only."""
        props = {k: v for k, v in (props or {}).items() if k != "id"}
        if self.has_node(node_id):
            sets = ", ".join(f"n.{quoted(k)} = $p{i}" for i, k in enumerate(props))
            if sets:
                self.query(f"MATCH (n {{id: $id}}) SET {sets}", {"id": node_id} | {f"p{i}": v for i, v in enumerate(props.values())})
        else:
            self.query(f"CREATE (n:{quoted(label)} $props)", {"props": {"id": node_id, **props}})

    def delete_node(self, node_id: str) -> None:
        self.query("MATCH (n {id: $id}) DETACH DELETE n", {"id": node_id})

    def get_all_nodes(self, label: str | None = None) -> list[dict]:
        return self._node_rows(f"MATCH (n{':' + quoted(label) if label else ''})")

    # Edges

    def has_edge(self, a: str, b: str) -> bool:
        return bool(self.query("MATCH ({id: $a})-[r]->({id: $b}) RETURN count(r) AS n", {"a": a, "b": b})[0]["n"])

    @staticmethod
    def _as_edge(row, a, b) -> dict:
        p = row["properties"]
        p = p.asDict() if hasattr(p, "asDict") else dict(p)
        return {"id": row["id"], "type": row["type"], "source": a, "target": b, "properties": {k: v for k, v in p.items() if v is not None}}

    def get_edge(self, a: str, b: str) -> dict | None:
        rows = self.query("MATCH ({id: $a})-[r]->({id: $b}) RETURN r ORDER BY id(r) LIMIT 1", {"a": a, "b": b}).to_list()
        return self._as_edge(rows[0]["r"], a, b) if rows else None

    def upsert_edge(self, a: str, b: str, props: dict | None = None, rel_type: str = "RELATED") -> None:
        """Create the edge unless any edge leads from a to b already."""
        if not self.has_edge(a, b):
            self.query(f"MATCH (a {{id: $a}}), (b {{id: $b}}) CREATE (a)-[:{quoted(sanitize_rel_type(rel_type))} {format_props(props or {})}]->(b)", {"a": a, "b": b})

    def delete_edge(self, a: str, b: str) -> None:
        self.query("MATCH ({id: $a})-[r]->({id: $b}) DELETE r", {"a": a, "b": b})

    def get_all_edges(self) -> list[dict]:
        return [self._as_edge(r["r"], r["a"], r["b"]) for r in self.query("MATCH (a)-[r]->(b) RETURN a.id AS a, b.id AS b, r")]

    # Neighbourhoods

    def node_degree(self, node_id: str) -> int:
        return self.query("MATCH (n {id: $id})-[r]-() RETURN count(r) AS n", {"id": node_id})[0]["n"]

    def get_neighbors(self, node_id: str) -> list[dict]:
        return self._node_rows("MATCH ({id: $id})-[]-(n) WITH DISTINCT n", {"id": node_id})

    def get_node_edges(self, node_id: str) -> list[dict]:
        return [self._as_edge(r["r"], r["a"], r["b"]) for r in self.query("MATCH (a)-[r]->(b) WHERE a.id = $id OR b.id = $id RETURN a.id AS a, b.id AS b, r", {"id": node_id})]

    def stats(self) -> dict:
        return self.graph.stats()

    # Bulk loading: DataFrames or lists in, one join and one union for each label or type

    def insert_nodes_bulk(self, rows: list[tuple] | DataFrame, label: str | None = None) -> DataFrame:
        """rows: (external id, properties, label), or a DataFrame (id, properties...) with one label; gives (ext_id, id)."""
        groups: dict[str, DataFrame] = {}
        if isinstance(rows, DataFrame):
            groups[label or "Entity"] = rows
        else:
            by_label: dict[str, list] = {}
            for ext, props, lab in rows:
                by_label.setdefault(lab, []).append({"id": str(ext), **{k: v if isinstance(v, (bool, int, float)) or v is None else str(v) for k, v in props.items() if k != "id"}})
            for lab, found in by_label.items():
                groups[lab] = self._frame(found)
        out = None
        for lab, df in groups.items():
            base = next_id(self.graph.nodes)
            nr, _ = numbered(df.withColumnRenamed("id", USER_ID), ".nr")
            new = nr.select((F.col("`.nr`") + base).cast("long").alias("id"), *[c for c in nr.columns if c != ".nr"])
            new = cut(new, "bulk")
            self.session.graph = add_nodes(self.graph, frozenset([lab]), new)
            ids = new.select(F.col(USER_ID).cast("string").alias("ext_id"), "id")
            out = ids if out is None else out.union(ids)
        return out if out is not None else self.spark.createDataFrame([], "ext_id string, id long")

    def _frame(self, rows: list[dict]) -> DataFrame:
        """Rows with missing keys; a column takes the widest type of its values."""
        keys = list(dict.fromkeys(k for r in rows for k in r))

        def kind(k: str) -> str:
            types = {type(r[k]) for r in rows if r.get(k) is not None}
            return "boolean" if types == {bool} else "bigint" if types == {int} else "double" if types and types <= {int, float} else "string"

        kinds = {k: kind(k) for k in keys}
        cast = {"boolean": bool, "bigint": int, "double": float, "string": str}
        data = [tuple(None if r.get(k) is None else cast[kinds[k]](r[k]) for k in keys) for r in rows]
        return self.spark.createDataFrame(data, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))

    def _known(self, column: str) -> DataFrame:
        """(column, id) of all nodes with a property id."""
        return self.graph.vertices().filter("user_id is not null").select(F.col("user_id").alias(column), "id")

    def resolve_node_ids(self, ext_ids: list[str]) -> dict[str, int]:
        asked = self.spark.createDataFrame([(str(x),) for x in ext_ids], "ext_id string").distinct()
        return {r["ext_id"]: r["id"] for r in self._known("ext_id").join(asked, "ext_id", "left_semi").collect()}

    def insert_edges_bulk(self, rows: list[tuple] | DataFrame, id_map: DataFrame | None = None, rel_type: str | None = None) -> int:
        """rows: (source, target, properties, type) by external ids, or a DataFrame (source, target, properties...) with one
        type. ValueError if an end is unknown; gives the number of edges."""
        if isinstance(rows, DataFrame):
            groups = {sanitize_rel_type(rel_type or "RELATED"): rows}
        else:
            by_type: dict[str, list] = {}
            for a, b, props, kind in rows:
                by_type.setdefault(sanitize_rel_type(kind), []).append({"source": str(a), "target": str(b), **props})
            groups = {k: self._frame(found) for k, found in by_type.items()}
        ids = id_map if id_map is not None else self.graph.vertices().filter("user_id is not null").select(F.col("user_id").alias("ext_id"), "id")
        total = 0
        for kind, df in groups.items():
            src = ids.select(F.col("ext_id").alias("source"), F.col("id").alias("src"))
            dst = ids.select(F.col("ext_id").alias("target"), F.col("id").alias("dst"))
            both = cut(df.join(src, "source", "left").join(dst, "target", "left"), "bulk")
            if bad := both.filter("src is null or dst is null").select("source", "target").first():
                raise ValueError(f"unknown end of an edge: {bad['source']} -> {bad['target']}")
            nr, n = numbered(both, ".nr")
            base = next_id(self.graph.edges)
            props = [F.col(f"`{c}`").alias(column_of(c)) for c in df.columns if c not in ("source", "target")]
            self.session.graph = add_edges(self.graph, kind, nr.select((F.col("`.nr`") + base).cast("long").alias("id"), "src", "dst", *props))
            total += n
        return total

    def insert_graph_bulk(self, nodes: list[tuple], edges: list[tuple]) -> dict:
        ids = cut(self.insert_nodes_bulk(nodes), "bulk")
        return {"nodes": ids.count(), "edges": self.insert_edges_bulk(edges, ids)}

    def upsert_nodes_batch(self, rows: list[tuple] | DataFrame, label: str | None = None) -> None:
        """rows: (id, properties, label), or a DataFrame (id, properties...) with one label. Ids that exist get the values that
        aren't null, others become nodes; of a repeated id one row counts (of a list the last)."""
        groups: dict[str, DataFrame] = {}
        if isinstance(rows, DataFrame):
            groups[label or "Entity"] = rows
        else:
            by_label: dict[str, dict] = {}
            for ext, props, lab in rows:
                by_label.setdefault(lab, {})[str(ext)] = {"id": str(ext), **{k: v for k, v in props.items() if k != "id"}}
            groups = {lab: self._frame(list(found.values())) for lab, found in by_label.items()}
        for lab, df in groups.items():
            df = cut(df.withColumn("id", F.col("id").cast("string")).dropDuplicates(["id"]), "batch")
            known = cut(self._known("ext_id").groupBy("ext_id").agg(F.min("id").alias("node")).join(df.select(F.col("id").alias("ext_id")), "ext_id", "left_semi"), "batch")
            new = df.join(known.select(F.col("ext_id").alias("id")), "id", "left_anti")
            self._overwrite(df.join(known, F.col("id") == F.col("ext_id")).drop("ext_id", "id"), [c for c in df.columns if c != "id"])
            if not new.isEmpty():
                self.insert_nodes_bulk(new, lab)

    def _overwrite(self, values: DataFrame, keys: list[str]) -> None:
        """Set the properties `keys` of the nodes values(node, ...) where the value isn't null; tables without such a node stay."""
        values, tables = cut(values, "batch"), []
        for t in self.graph.nodes:
            if not keys or t.df.join(values.select(F.col("node").alias("id")), "id", "left_semi").isEmpty():
                tables.append(t)
                continue
            new = values.select(F.col("node").alias("id"), *[F.col(f"`{k}`").alias(f".{k}") for k in keys])
            df = t.df.join(new, "id", "left")
            for k in keys:
                c, kind = column_of(k), values.schema[k].dataType
                kind = common_type(t.props[c], kind) if c in t.props else kind
                df = df.withColumn(c, F.coalesce(F.col(f"`.{k}`").cast(kind), F.col(f"`{c}`").cast(kind) if c in t.props else F.lit(None).cast(kind)))
            tables.append(replace(t, df=cut(df.drop(*[f".{k}" for k in keys]), "table")))
        self.session.graph = self.graph.with_tables(nodes=tuple(tables))

    def upsert_edges_batch(self, rows: list[tuple] | DataFrame, rel_type: str | None = None) -> None:
        """rows: (source, target, properties, type), or a DataFrame (source, target, properties...) with one type. Pairs that any
        edge joins already, and rows with an unknown end, are left out; of a repeated pair one row counts."""
        if isinstance(rows, DataFrame):
            groups = {rel_type or "RELATED": rows}
        else:
            by_type: dict[str, dict] = {}
            seen: set[tuple] = set()
            for a, b, props, kind in rows:
                if (str(a), str(b)) not in seen:
                    seen.add((str(a), str(b)))
                    by_type.setdefault(kind, {})[a, b] = {"source": str(a), "target": str(b), **props}
            groups = {k: self._frame(list(found.values())) for k, found in by_type.items()}
        for kind, df in groups.items():
            ends = df.dropDuplicates(["source", "target"]).join(self._known("source").withColumnRenamed("id", ".s"), "source").join(self._known("target").withColumnRenamed("id", ".t"), "target")
            have = self.graph.links().select(F.col("src").alias(".s"), F.col("dst").alias(".t"))
            new = cut(ends.join(have, [".s", ".t"], "left_anti").select(*df.columns), "batch")
            if not new.isEmpty():
                self.insert_edges_bulk(new, rel_type=kind)

    # Algorithms

    def pagerank(self, damping: float = 0.85, iterations: int = 20) -> DataFrame:
        return rank.page_rank(self.graph, damping, iterations)

    def degree_centrality(self) -> DataFrame:
        return centrality.degree_centrality(self.graph)

    def betweenness_centrality(self) -> DataFrame:
        return centrality.betweenness_centrality(self.graph)

    def closeness_centrality(self) -> DataFrame:
        return centrality.closeness_centrality(self.graph)

    def eigenvector_centrality(self, iterations: int = 100) -> DataFrame:
        return rank.eigenvector_centrality(self.graph, iterations)

    def community_detection(self, iterations: int = 10) -> DataFrame:
        return community.label_propagation(self.graph, iterations)

    def louvain(self, resolution: float = 1.0) -> DataFrame:
        return community.louvain(self.graph, resolution)

    def leiden_communities(self, resolution: float = 1.0, seed: int | None = None) -> DataFrame:
        try:
            import graspologic_native  # noqa: F401
        except ImportError as e:
            raise ImportError("leiden_communities needs an optional package that isn't installed; louvain() needs none") from e
        raise NotImplementedError("leiden_communities isn't built; use louvain()")

    def weakly_connected_components(self) -> DataFrame:
        return components.wcc(self.graph)

    def strongly_connected_components(self) -> DataFrame:
        return components.scc(self.graph)

    def shortest_path(self, source: str, target: str, weight: str | None = None) -> dict:
        r = paths.dijkstra(self.graph, source, target, weight).first()
        return {"path": list(r["path"]), "distance": r["distance"], "found": r["found"]}

    def astar(self, source: str, target: str, lat: str | None = None, lon: str | None = None) -> dict:
        r = paths.astar(self.graph, source, target, lat, lon).first()
        return {"path": list(r["path"]), "distance": r["distance"], "found": r["found"], "nodes_explored": r["nodes_explored"]}

    def all_pairs_shortest_path(self) -> DataFrame:
        return paths.all_pairs(self.graph)

    def bfs(self, start: str, max_depth: int = -1) -> DataFrame:
        return traversal.bfs(self.graph, start, max_depth)

    def dfs(self, start: str, max_depth: int = -1) -> DataFrame:
        return traversal.dfs(self.graph, start, max_depth)

    def node_similarity(self, threshold: float = 0.0, k: int | None = None) -> DataFrame:
        return similarity.node_similarity(self.graph, threshold, k)

    def knn(self, node_id: str, k: int = 10) -> DataFrame:
        return similarity.knn(self.graph, node_id, k)

    def triangle_count(self) -> DataFrame:
        return similarity.triangle_count(self.graph)

    # Cache and export

    def cache(self) -> dict:
        return self.graph.cache()

    def uncache(self) -> dict:
        return self.graph.uncache()

    def reload(self) -> dict:
        self.graph.uncache()
        return self.graph.cache()

    def is_cached(self) -> bool:
        return self.graph.is_cached()

    def to_rustworkx(self):
        """(PyDiGraph, {user id: index}), if the optional package is there; the graph must fit the driver."""
        try:
            import rustworkx as rx
        except ImportError as e:
            raise ImportError("to_rustworkx() needs the optional package rustworkx") from e
        g, at = rx.PyDiGraph(), {}
        for r in self.graph.vertices().toLocalIterator():
            at[r["id"]] = g.add_node(r["user_id"])
        for r in self.graph.links().toLocalIterator():
            g.add_edge(at[r["src"]], at[r["dst"]], r["weight"])
        return g, {g[i]: i for i in at.values()}

    def __enter__(self) -> PropertyGraph:
        return self

    def __exit__(self, *_) -> None:
        self.uncache()


def graph(spark: SparkSession, path: str | None = None, name: str = "main") -> PropertyGraph:
    return PropertyGraph(spark, Graph.load(spark, path, name) if path else None, name)


__all__ = ["EdgeTable", "Graph", "NodeTable", "PropertyGraph", "escape_string", "format_props", "graph", "sanitize_rel_type"]
