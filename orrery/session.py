"""Running queries: the session holds the current graph versions and gives results as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from orrery.graph import Graph
from orrery.operators.calls import algorithm_call
from orrery.plans import ast as A
from orrery.plans.compiler import Compiler, CypherError
from orrery.plans.parser import parse
from orrery.plans.writes import UPDATES, Writer, WriteStats


class Result:
    """Rows of a query, as a DataFrame (`df`) and as a sequence; `stats` counts what it wrote."""

    def __init__(self, df: DataFrame, stats: WriteStats):
        self.df, self.stats = df, stats
        self._rows: list[Row] | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self) -> list[Row]:
        if self._rows is None:
            self._rows = self.df.collect()
        return self._rows

    def to_list(self) -> list[dict]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.rows()]

    def to_json(self) -> str:
        return json.dumps([{k: v.asDict(True) if isinstance(v, Row) else v for k, v in r.items()} for r in self.to_list()], default=str)

    def write_json(self, path: str) -> None:
        """The rows as JSON lines in a folder, written by the executors."""
        self.df.write.mode("overwrite").json(path)

    def __iter__(self) -> Iterator[dict]:
        return iter(self.to_list())

    def __len__(self) -> int:
        return len(self.rows())

    def __getitem__(self, i: int) -> dict:
        return self.to_list()[i]


class Session:
    """session.cypher(query, params) over a graph, or several by name (MATCH ... FROM name)."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, graphs: dict[str, Graph] | None = None, main: str = "main", max_hops: int = 100):
        self.spark, self.main, self.max_hops = spark, main, max_hops
        self.graphs = dict(graphs or {})
        self.graphs.setdefault(main, graph or Graph(spark))

    @property
    def graph(self) -> Graph:
        return self.graphs[self.main]

    @graph.setter
    def graph(self, g: Graph) -> None:
        self.graphs[self.main] = g

    def cypher(self, query: str, params: dict | str | None = None) -> Result:
        if not isinstance(query, str):
            raise TypeError("the query must be a string")
        if isinstance(params, str):
            params = json.loads(params)
        if params is not None and not isinstance(params, dict):
            raise TypeError("parameters must be a dict or a JSON object")
        stats = WriteStats()
        tree = parse(query)
        if isinstance(tree, A.Explain):
            return Result(self.explain(tree.query, params or {}), stats)
        return Result(self.run(tree, params or {}, stats), stats)

    def run(self, q: A.Node, params: dict, stats: WriteStats) -> DataFrame:
        if isinstance(q, A.Union):
            left, right = self.run(q.left, params, stats), self.run(q.right, params, stats)
            if left.columns != right.columns:
                raise CypherError(f"UNION needs equal column names: {left.columns} and {right.columns}")
            both = left.union(right)
            return both if q.all else both.distinct()
        return self.query(q, params, stats)[0]

    def query(self, q: A.Query, params: dict, stats: WriteStats) -> tuple[DataFrame, Compiler]:
        c = Compiler(dict(self.graphs), params, self.main, self.max_hops)
        if (got := algorithm_call(c, q)) is not None:
            return got, c
        c.learn_uses(q)
        writes = any(isinstance(x, UPDATES) for x in q.clauses)
        if writes:
            c.used.add("*")
        out = None
        for x in q.clauses:
            if isinstance(x, UPDATES):
                Writer(c, stats).apply(x)
            else:
                out = c.read_clause(x)
        if writes:
            self.graphs = {**self.graphs, **c.graphs}
        if out is None:
            if not writes:
                raise CypherError("a query ends with RETURN or an update")
            out = self.spark.createDataFrame([], "status string")
        return out, c

    def explain(self, q: A.Node, params: dict) -> DataFrame:
        """One row: clauses as planned, then Spark's formatted plan. Nothing is written."""
        if isinstance(q, A.Query) and any(isinstance(x, UPDATES) for x in q.clauses):
            text = "\n".join(f"{type(x).__name__}" for x in q.clauses)
        elif isinstance(q, A.Query):
            df, c = self.query(q, params, WriteStats())
            text = "\n".join(c.log) + "\n" + df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        else:
            df = self.run(q, params, WriteStats())
            text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.range(1).select(F.lit(text).alias("plan"))
