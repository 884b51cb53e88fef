"""A few registered queries against their oracle SQL on the smallest tables, and the plan of the flagship query."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orrery import queries

DIR = "/root/testdata/sf0.001"
SOME = ["flagship", "three_hop", "optional_match", "not_exists", "pattern_comprehension", "varlen_1_3", "math_fns", "pagerank", "label_propagation", "wcc", "knn", "merge_upsert", "from_graph", "dfs", "apsp_pairs", "match_merge", "batch_nodes", "transactions"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    df, want = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(map(plain, r))) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_registry_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_flagship_plan_prunes_and_pushes(spark):
    plan = queries.QUERIES["explain"](spark, DIR).first()["plan"]
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "c_name" not in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_merge_is_an_equi_join(spark):
    """The anti join of MERGE has equality keys (null-safe), so it hashes or sorts instead of looping over all pairs."""
    from orrery.plans.compiler import Compiler
    from orrery.plans.writes import Writer, WriteStats
    from orrery.session import Session

    s = Session(spark)
    s.cypher("UNWIND range(1, 9) AS k CREATE (:N {k: k, name: toString(k)})")
    c = Compiler(dict(s.graphs))
    w = Writer(c, WriteStats())
    from orrery.functions import values as V
    from pyspark.sql import functions as F

    from orrery.plans import ast as A

    values = {"k": V.E(F.col("`.key1`"), V.INT), "name": V.E(F.col("`.key2`"), V.STRING)}
    e, scan = c.scan(A.NodePat("n", ("N",), None), s.graph)
    wanted = spark.range(5).selectExpr("id AS `.key1`", "cast(id AS string) AS `.key2`")
    plan = wanted.join(scan, w.fit(e, values, {"k": ".key1", "name": ".key2"}), "left_anti")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "LeftAnti" in plan


def test_appends_write_only_new_rows(spark):
    from orrery.session import Session

    s = Session(spark)
    for i in range(20):
        s.cypher(f"CREATE (:N {{v: {i}}})")
    assert s.cypher("MATCH (n:N) RETURN count(n) AS n, sum(n.v) AS s").to_list() == [{"n": 20, "s": 190}]
    assert s.graph.nodes[0].parts < 20


def test_updates_read_the_line_items_once(spark, monkeypatch, tmp_path):
    """DELETE tests, counts and rewrites the tables of its graph; these are joined from the line items, which is done once."""
    from orrery import queries_api

    met = []

    def counted(session, path):
        g = trade_graph(session, path)
        hits = session.sparkContext.accumulator(0)

        def seen(batches):
            for b in batches:
                hits.add(b.num_rows)
                yield b

        e = g.edges[0]
        met.append(hits)
        return g.with_tables(edges=(replace(e, df=e.df.coalesce(1).mapInArrow(seen, e.df.schema)),))

    from dataclasses import replace

    from orrery.testgraph import trade_graph

    monkeypatch.setattr(queries_api, "trade_graph", counted)
    trades = trade_graph(spark, DIR).edges[0].df.count()
    assert queries_api.delete_rules(spark, DIR).first()["refused"] is True
    assert met[0].value == trades
