"""Connections: a graph with a committed version, a query builder and typed access to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.graph import Graph
from orrery.session import Result, Session


class TypedRow:
    """A row whose values are asked for by name and type. None stands for a null of any type."""

    def __init__(self, values: dict):
        self.values = values

    def get(self, name: str, kind: type | None = None):
        if name not in self.values:
            raise KeyError(f"no column {name}; there are {', '.join(self.values)}")
        v = self.values[name]
        if v is None or kind is None:
            return v
        if kind is float and isinstance(v, int) and not isinstance(v, bool):
            return float(v)
        if not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
            raise TypeError(f"{name} is {type(v).__name__}, not {kind.__name__}")
        return v

    def get_int(self, name: str) -> int | None:
        return self.get(name, int)

    def get_float(self, name: str) -> float | None:
        return self.get(name, float)

    def get_str(self, name: str) -> str | None:
        return self.get(name, str)

    def get_bool(self, name: str) -> bool | None:
        return self.get(name, bool)

    def get_list(self, name: str) -> list | None:
        return self.get(name, list)


class QueryBuilder:
    """connection.query_builder(text).param("k", 1).run()"""

    def __init__(self, session: Session, text: str):
        self.session, self.text, self.given = session, text, {}

    def param(self, name: str, value) -> QueryBuilder:
        self.given[name] = value
        return self

    def params(self, values: dict) -> QueryBuilder:
        self.given |= values
        return self

    def run(self) -> Result:
        return self.session.cypher(self.text, self.given)

    def rows(self) -> list[TypedRow]:
        return [TypedRow(r) for r in self.run()]


class Connection:
    """A session over one graph. Versions are immutable, so commit() marks the current one and rollback() goes back to the one
    marked last; with a path, commit() also writes the graph there."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, path: str | None = None):
        self.session, self.path = Session(spark, graph), path
        self.committed = self.session.graph

    @property
    def graph(self) -> Graph:
        return self.session.graph

    def cypher(self, query: str, params: dict | str | None = None) -> Result:
        return self.session.cypher(query, params)

    def query_builder(self, text: str) -> QueryBuilder:
        return QueryBuilder(self.session, text)

    def execute(self, sql: str) -> DataFrame:
        """Spark SQL, with the tables of the graph as views named by label and by relationship type."""
        for t in self.graph.nodes:
            t.df.createOrReplaceTempView("_".join(sorted(t.labels)) or "nodes")
        for t in self.graph.edges:
            t.df.createOrReplaceTempView(t.type)
        return self.session.spark.sql(sql)

    def commit(self) -> None:
        if self.path is not None:
            # The tables may be read from the folder that is written: a new one takes its place when it is complete.
            spark, new = self.session.spark, f"{self.path.rstrip('/')}.new"
            at = spark._jvm.org.apache.hadoop.fs.Path
            fs = at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(at(new), True)
            self.graph.save(new)
            fs.delete(at(self.path), True)
            fs.rename(at(new), at(self.path))
            self.session.graph = Graph.load(spark, self.path, self.graph.name)
        self.committed = self.session.graph

    def rollback(self) -> None:
        self.session.graph = self.committed

    def close(self) -> None:
        self.graph.uncache()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()
        self.close()


def connect(spark: SparkSession, path: str | None = None) -> Connection:
    """A connection to the graph saved at path, or to a new one (which commit() writes there)."""
    if path is None:
        return Connection(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_tables.parquet")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return Connection(spark, Graph.load(spark, path) if there else None, path)


def wrap(spark: SparkSession, graph: Graph) -> Connection:
    """A connection to a graph that is at hand."""
    return Connection(spark, graph)
