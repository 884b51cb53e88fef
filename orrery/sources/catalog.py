"""Many graphs by name, each a folder of Parquet tables under one root."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from orrery.api import PropertyGraph
from orrery.graph import Graph
from orrery.session import Result, Session


class GraphCatalog:
    """list, exists, create, open, drop, query over several graphs; works on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, PropertyGraph] = {}

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list(self) -> list[str]:
        if not self._fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path()) if s.isDirectory() and self._fs.exists(self._path(f"{s.getPath().getName()}/_tables.parquet")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{name}/_tables.parquet"))

    def create(self, name: str) -> PropertyGraph:
        if self.exists(name):
            raise FileExistsError(f"graph {name} exists")
        Graph(self.spark, name=name).save(f"{self.root}/{name}")
        return self.open(name)

    def open(self, name: str) -> PropertyGraph:
        if not self.exists(name):
            raise FileNotFoundError(f"no graph {name}")
        if name not in self._open:
            self._open[name] = PropertyGraph(self.spark, Graph.load(self.spark, f"{self.root}/{name}", name), name)
        return self._open[name]

    def open_or_create(self, name: str) -> PropertyGraph:
        return self.open(name) if self.exists(name) else self.create(name)

    def save(self, name: str) -> None:
        """Write an open graph back: to a new folder first, as its tables may be read from the old one."""
        fs, new = self._fs, f"{name}.new"
        fs.delete(self._path(new), True)
        self._open[name].graph.save(f"{self.root}/{new}")
        fs.delete(self._path(name), True)
        fs.rename(self._path(new), self._path(name))
        del self._open[name]

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise FileNotFoundError(f"no graph {name}")
        self._open.pop(name, None)
        self._fs.delete(self._path(name), True)

    def query(self, text: str, graphs: list[str], params: dict | None = None) -> Result:
        """A query over several graphs; patterns say FROM name, the first graph is the default."""
        opened = {g: self.open(g).graph for g in graphs}
        s = Session(self.spark, graphs=opened, main=graphs[0])
        out = s.cypher(text, params)
        for g in graphs:
            self._open[g].session.graph = s.graphs[g]
        return out

    def query_sql(self, sql: str, graphs: list[str]) -> DataFrame:
        """Spark SQL over views <graph>__<Label> and <graph>__<TYPE>."""
        for name in graphs:
            g = self.open(name).graph
            for t in g.nodes:
                t.df.createOrReplaceTempView(f"{name}__{'_'.join(sorted(t.labels)) or 'nodes'}")
            for t in g.edges:
                t.df.createOrReplaceTempView(f"{name}__{t.type}")
        return self.spark.sql(sql)

    def __iter__(self) -> Iterator[str]:
        return iter(self.list())

    def __contains__(self, name: str) -> bool:
        return self.exists(name)

    def __len__(self) -> int:
        return len(self.list())

    def __enter__(self) -> GraphCatalog:
        return self

    def __exit__(self, *_) -> None:
        self._open.clear()


def graphs(spark: SparkSession, root: str) -> GraphCatalog:
    """The catalog of the graphs below a folder."""
    return GraphCatalog(spark, root)
