"""Registered queries for loading, the graph object, connections, the catalog, functions and errors, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.api import PropertyGraph, escape_string, format_props, sanitize_rel_type
from orrery.connection import TypedRow, connect, wrap
from orrery.session import Session
from orrery.shell import run_line
from orrery.sources.catalog import GraphCatalog, graphs
from orrery.storage import shared_dir
from orrery.streaming.ingest import merge_stream
from orrery.testgraph import market_graph, relational_graph, trade_graph

PAIRS = "SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"

#: name -> (query on the relational graph, SQL on the tables)
CYPHER: dict[str, tuple[str, str]] = {
    "null_map": ("MATCH (e:Event {value: null}) RETURN count(*) AS n", "SELECT count(*) AS n FROM events WHERE value IS NULL"),
    "precedence": ("UNWIND [1] AS x RETURN 1 + 2 * 3 - 4 % 3 AS a, NOT true OR true AS b, true XOR true AND false AS c, -2 + 5 AS d, 2 < 3 AND 3 < 4 AS e, 10 / 4 * 2 AS f", "SELECT CAST(6 AS BIGINT) AS a, true AS b, true AS c, CAST(3 AS BIGINT) AS d, true AS e, CAST(4 AS BIGINT) AS f"),
    "backticks": ("MATCH (`the node`:`Nation`) RETURN `the node`.`name` AS `a name`, `the node`.key AS key", 'SELECT n_name AS "a name", CAST(n_nationkey AS BIGINT) AS key FROM nation'),
    "string_predicates": (
        "MATCH (n:Nation) RETURN n.name AS name, startsWith(n.name, 'NATION_1') AS s, endsWith(n.name, '3') AS e, contains(n.name, '_2') AS c, ltrim('  a ') AS l, rtrim('  a ') AS r, split(n.name, '_')[1] AS part",
        "SELECT n_name AS name, starts_with(n_name, 'NATION_1') AS s, ends_with(n_name, '3') AS e, contains(n_name, '_2') AS c, 'a ' AS l, '  a' AS r, string_split(n_name, '_')[2] AS part FROM nation",
    ),
    "temporal": (
        "UNWIND ['2024-03-05T06:07:08', '1999-12-31T23:59:59'] AS s RETURN date(s) AS d, time(s) AS t, datetime(s) AS dt, localdatetime(s) AS l",
        "SELECT strftime(x, '%Y-%m-%d') AS d, strftime(x, '%H:%M:%S') AS t, strftime(x, '%Y-%m-%dT%H:%M:%SZ') AS dt, strftime(x, '%Y-%m-%dT%H:%M:%S') AS l FROM (VALUES (TIMESTAMP '2024-03-05 06:07:08'), (TIMESTAMP '1999-12-31 23:59:59')) v(x)",
    ),
    "clock_and_chance": ("UNWIND [1] AS x RETURN rand() >= 0 AND random() < 1 AS r, size(randomUUID()) AS u, timestamp() > 1700000000000 AS t, size(date()) AS d, size(datetime()) AS dt", "SELECT true AS r, CAST(36 AS BIGINT) AS u, true AS t, CAST(10 AS BIGINT) AS d, CAST(20 AS BIGINT) AS dt"),
    "collect_distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.name AS nation, size(collect(DISTINCT c.mktsegment)) AS segs, sum(DISTINCT c.key % 5) AS s", "SELECT n_name AS nation, count(DISTINCT c_mktsegment) AS segs, CAST(sum(DISTINCT c_custkey % 5) AS BIGINT) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "stdev": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, round(stdev(c.acctbal), 4) AS s, round(stdevp(c.acctbal), 4) AS p", "SELECT c_mktsegment AS seg, round(stddev_samp(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 4) AS p FROM customer GROUP BY 1"),
    "aggregate_of_nothing": ("MATCH (c:Customer) WHERE c.key < 0 RETURN count(*) AS n, sum(c.key) AS s, size(collect(c.name)) AS k, min(c.key) AS lo", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS lo"),
    "keys_list": ("MATCH (n:Nation) UNWIND keys(n) AS k RETURN k, count(*) AS n", "SELECT k, count(*) AS n FROM nation, (VALUES ('key'), ('name')) v(k) GROUP BY 1"),
    "rels_of_path": ("MATCH p = (a:Nation)-[:IN_REGION]->(r) UNWIND rels(p) AS e RETURN e, length(p) AS l", "SELECT CAST(n_nationkey AS BIGINT) AS e, CAST(1 AS BIGINT) AS l FROM nation"),
    "map_literal": ("UNWIND [{a: 1, b: 'x'}, {a: 2, b: 'y'}] AS m RETURN m.a AS a, m['b'] AS b", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y')) v(a, b)"),
    "comments_and_case": ("match (n:Nation) // a comment\n where n.key < 7 /* another */ return n.name as name order by name;", "SELECT n_name AS name FROM nation WHERE n_nationkey < 7"),
}


def rows_sql(names: str, rows: list[tuple]) -> str:
    """SELECT of literal rows; whole numbers are BIGINT."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _nations(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    g = PropertyGraph(spark)
    g.insert_nodes_bulk(_table(spark, sf_dir, "nation").select(_named("n", "n_nationkey").alias("id"), F.col("n_name").alias("name")), label="Nation")
    return g


def _refused(run: Callable) -> bool:
    try:
        run()
    except (ValueError, TypeError, KeyError, FileExistsError, FileNotFoundError):
        return True
    return False


# Loading


def bulk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, c = _nations(spark, sf_dir), _table(spark, sf_dir, "customer")
    g.insert_nodes_bulk(c.select(_named("c", "c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), label="Customer")
    g.insert_edges_bulk(c.select(_named("c", "c_custkey").alias("source"), _named("n", "c_nationkey").alias("target"), F.col("c_mktsegment").alias("segment")), rel_type="LIVES_IN")
    return g.query("MATCH (c:Customer)-[r:LIVES_IN]->(n:Nation) RETURN n.name AS nation, r.segment AS segment, count(c) AS n, round(sum(c.balance), 2) AS balance").df


def bulk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PropertyGraph(spark)
    regions, nations = _table(spark, sf_dir, "region").collect(), _table(spark, sf_dir, "nation").collect()
    nodes = [(f"r{r.r_regionkey}", {"name": r.r_name}, "Region") for r in regions] + [(f"n{n.n_nationkey}", {"name": n.n_name}, "Nation") for n in nations]
    made = g.insert_graph_bulk(nodes, [(f"n{n.n_nationkey}", f"r{n.n_regionkey}", {}, "in region") for n in nations])
    known = g.resolve_node_ids(["n0", "n1", "nowhere"])
    refused = _refused(lambda: g.insert_edges_bulk([("n0", "nowhere", {}, "X")]))
    rows = g.query("MATCH (n:Nation)-[:in_region]->(r:Region) RETURN r.name AS region, count(n) AS n").df
    return rows.select("region", "n", F.lit(made["nodes"]).cast("long").alias("nodes"), F.lit(made["edges"]).cast("long").alias("edges"), F.lit(len(known)).cast("long").alias("known"), F.lit(refused).alias("refused"))


def batch_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, n = _nations(spark, sf_dir), _table(spark, sf_dir, "nation")
    changed = n.filter("n_nationkey >= 10").select(_named("n", "n_nationkey").alias("id"), F.lower("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    g.upsert_nodes_batch(changed.union(n.filter("n_nationkey < 5").select(_named("x", "n_nationkey"), F.lit("new"), F.lit(None).cast("long"))), label="Nation")
    g.upsert_nodes_batch([("n0", {"name": "zero"}, "Nation"), ("y0", {"name": "why"}, "Place")])
    return g.query("MATCH (n) RETURN n.id AS id, n.name AS name, n.region AS region, head(labels(n)) AS label").df


def batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, n = _nations(spark, sf_dir), _table(spark, sf_dir, "nation")
    step = lambda by: n.filter(f"n_nationkey < {25 - by}").select(_named("n", "n_nationkey").alias("source"), F.concat(F.lit("n"), (F.col("n_nationkey") + by).cast("string")).alias("target"), F.lit(by).cast("long").alias("by"))
    g.insert_edges_bulk(step(1), rel_type="STEP")
    again = step(1).withColumn("by", F.lit(9).cast("long"))
    g.upsert_edges_batch(again.union(step(2)).union(step(2)).union(n.select(_named("n", "n_nationkey"), F.lit("nowhere"), F.lit(0).cast("long"))), rel_type="STEP")
    return g.query("MATCH (a)-[s:STEP]->(b) RETURN a.id AS a, b.id AS b, s.by AS by").df


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "json")
    Session(spark, relational_graph(spark, sf_dir)).cypher("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.name AS nation, r.name AS region").write_json(path)
    return spark.read.schema("nation string, region string").json(path)


def unwind_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.cypher("UNWIND $rows AS row CREATE (:Item {sku: row.sku, qty: row.qty})", {"rows": [{"sku": f"s{i}", "qty": i * i} for i in range(50)]})
    return s.cypher("MATCH (i:Item) WHERE i.qty > 100 RETURN i.sku AS sku, i.qty AS qty").df


def load_csv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path)
    return Session(spark).cypher(f"LOAD CSV FROM '{path}' AS row RETURN toInteger(row[0]) AS key, row[1] AS name").df


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = Session(spark), shared_dir(spark, "stream-in")
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows.union(rows.filter("n_nationkey < 5")).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    merge_stream(s, stream, "UNWIND $rows AS row MERGE (n:Nation {id: row.n_nationkey}) SET n.name = row.n_name", shared_dir(spark, "stream-state")).awaitTermination()
    return s.cypher("MATCH (n:Nation) RETURN n.id AS id, n.name AS name").df


# Updates


def match_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, trade_graph(spark, sf_dir).settled())
    for _ in range(2):
        s.cypher("MATCH (a:Nation), (b:Nation) WHERE toInteger(a.id) + 1 = toInteger(b.id) MERGE (a)-[r:NEXT_TO]->(b) ON CREATE SET r.n = 1 ON MATCH SET r.n = 2")
    return s.cypher("MATCH (a)-[r:NEXT_TO]->(b) RETURN a.id AS a, b.id AS b, r.n AS n").df


def merge_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    for _ in range(2):
        s.cypher("UNWIND range(1, 5) AS k MERGE (a:X {k: k})-[:Y]->(b:Z {k: k % 2})")
    return s.cypher("MATCH (a:X)-[:Y]->(b:Z) RETURN a.k AS a, b.k AS b").df


def delete_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE refuses a node with relationships; without them it goes."""
    s = Session(spark, trade_graph(spark, sf_dir).settled())
    refused = _refused(lambda: s.cypher("MATCH (n:Nation {id: '0'}) DELETE n"))
    s.cypher("MATCH (n:Nation {id: '0'})-[r]-() DELETE r")
    s.cypher("MATCH (n:Nation {id: '0'}) DELETE n")
    stats = s.graph.stats()
    return spark.createDataFrame([(refused, stats["nodes"], stats["edges"])], "refused boolean, nodes long, edges long")


def remove_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, trade_graph(spark, sf_dir))
    s.cypher("MATCH (n:Nation) SET n:Big")
    s.cypher("MATCH (n:Big) WHERE toInteger(n.id) % 2 = 0 REMOVE n:Big")
    return s.cypher("MATCH (n:Nation) RETURN n.id AS id, n:Big AS big").df


def result_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, rows = Session(spark), []
    for q in ("CREATE (:A {v: 1})-[:R {w: 2}]->(:A {v: 2})", "MATCH (a:A) SET a.v = a.v + 1", "MATCH (a:A {v: 2}) DETACH DELETE a"):
        rows += [(q[:6], k, v) for k, v in s.cypher(q).stats.as_dict().items()]
    return spark.createDataFrame(rows, "query string, stat string, n long")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = shared_dir(spark, "connection"), []
    with connect(spark, path) as c:
        c.cypher("CREATE (:P {v: 1})")
        c.commit()
        c.cypher("CREATE (:P {v: 2})")
        rows.append(("before", c.execute("SELECT v FROM P").count()))
        c.rollback()
        rows.append(("after", c.execute("SELECT v FROM P").count()))
        c.cypher("CREATE (:P {v: 3})")
    rows.append(("again", connect(spark, path).cypher("MATCH (p:P) RETURN sum(p.v) AS s")[0]["s"]))
    return spark.createDataFrame(rows, "step string, n long")


def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = wrap(spark, relational_graph(spark, sf_dir))
    return c.query_builder("MATCH (n:Nation)-[:IN_REGION]->(r) WHERE n.key > $k AND r.name <> $r RETURN n.name AS name").param("k", 10).params({"r": "ASIA"}).run().df


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = wrap(spark, trade_graph(spark, sf_dir)).query_builder("MATCH (n:Nation {id: '3'}) RETURN n.id AS s, 4 AS i, 2.5 AS f, true AS b, [1, 2] AS l, null AS z").rows()[0]
    got = [("i", row.get_int("i") == 4), ("as float", row.get_float("i") == 4.0), ("f", row.get_float("f") == 2.5), ("s", row.get_str("s") == "3"), ("b", row.get_bool("b") is True), ("l", row.get_list("l") == [1, 2]), ("z", row.get("z", int) is None)]
    got += [("wrong type", _refused(lambda: row.get_int("s"))), ("no column", _refused(lambda: row.get("q"))), ("bool is no int", _refused(lambda: TypedRow({"b": True}).get_int("b")))]
    return spark.createDataFrame(got, "what string, ok boolean")


# The graph object and the catalog


def graph_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    with PropertyGraph(spark) as g:
        g.upsert_node("a", {"name": "A"}, "P")
        g.upsert_node("b", {"name": "B"}, "P")
        g.upsert_node("a", {"age": 3})
        g.upsert_edge("a", "b", {"w": 1}, "KNOWS")
        g.upsert_edge("a", "b", {"w": 2}, "LIKES")
        rows = [("age", str(g.get_node("a")["properties"]["age"])), ("label", g.get_node("a")["labels"][0]), ("type", g.get_edge("a", "b")["type"]), ("edge", str(g.has_edge("a", "b"))), ("back", str(g.has_edge("b", "a")))]
        rows += [("degree", str(g.node_degree("b"))), ("neighbour", g.get_neighbors("b")[0]["properties"]["id"]), ("edges of b", str(len(g.get_node_edges("b")))), ("nodes", str(len(g.get_all_nodes("P")))), ("edges", str(len(g.get_all_edges())))]
        g.delete_edge("a", "b")
        g.delete_node("b")
        rows += [("left", str(g.stats())), ("b", str(g.has_node("b"))), ("none", str(g.get_node("b")))]
    return spark.createDataFrame(rows, "what string, value string")


def algorithm_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every algorithm of the graph object on the trade graph, and of the calls that give one answer."""
    g = PropertyGraph(spark, trade_graph(spark, sf_dir).settled())
    frames = {
        "pagerank": g.pagerank(iterations=2), "degree": g.degree_centrality(), "betweenness": g.betweenness_centrality(), "closeness": g.closeness_centrality(), "eigenvector": g.eigenvector_centrality(2),
        "communities": g.community_detection(2), "louvain": g.louvain(), "wcc": g.weakly_connected_components(), "scc": g.strongly_connected_components(), "triangles": g.triangle_count(),
    }
    out = None
    for name, df in frames.items():
        rows = df.select(F.lit(name).alias("name"), F.count_distinct("node_id").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


def algorithm_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An algorithm's result is a DataFrame and joins any other."""
    d = Session(spark, trade_graph(spark, sf_dir)).cypher("RETURN degreeCentrality()").df
    return d.join(_table(spark, sf_dir, "nation"), F.col("node_id") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.sum("degree").alias("degree"))


def cache_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PropertyGraph(spark, market_graph(spark, sf_dir))
    first, again, on = g.cache(), g.reload(), g.is_cached()
    g.uncache()
    return spark.createDataFrame([(first["nodes"], again["edges"], on, g.is_cached())], "nodes long, edges long, cached boolean, later boolean")


def catalog_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    with graphs(spark, shared_dir(spark, "catalog")) as cat:
        n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
        cat.create("nations").insert_nodes_bulk(n.select(_named("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), _named("r", "n_regionkey").alias("region")), label="Nation")
        cat.open_or_create("regions").insert_nodes_bulk(r.select(_named("r", "r_regionkey").alias("id"), F.col("r_name").alias("name")), label="Region")
        cat.save("nations")
        cat.save("regions")
        return cat.query("MATCH (n:Nation) MATCH (r:Region) FROM regions WHERE n.region = r.id RETURN graph(n) AS g, graph(r) AS h, n.name AS nation, r.name AS region", ["nations", "regions"]).df


def catalog_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = GraphCatalog(spark, shared_dir(spark, "catalog"))
    cat.create("shop").insert_nodes_bulk(_table(spark, sf_dir, "customer").select(_named("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), label="Customer")
    return cat.query_sql("SELECT segment, count(*) AS n FROM shop__Customer GROUP BY segment", ["shop"])


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = GraphCatalog(spark, shared_dir(spark, "catalog"))
    rows = [("empty", str(cat.list()))]
    for name in ("b", "a", "c"):
        cat.create(name)
    rows += [("twice", str(_refused(lambda: cat.create("a")))), ("all", str(list(cat))), ("in", str("a" in cat)), ("len", str(len(cat)))]
    cat.drop("b")
    rows += [("left", str(cat.list())), ("gone", str(cat.exists("b"))), ("no such", str(_refused(lambda: cat.open("b")))), ("drop", str(_refused(lambda: cat.drop("b"))))]
    return spark.createDataFrame(rows, "what string, value string")


def shell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PropertyGraph(spark)
    said = [("create", run_line(g, "CREATE (:P {v: 1})")), ("read", run_line(g, "MATCH (n:P) RETURN n.v AS v")), ("tables", run_line(g, ".tables")), ("stats", run_line(g, ".stats")), ("quit", str(run_line(g, ".quit"))), ("error", str(run_line(g, "MATCH (").startswith("Error")))]
    return spark.createDataFrame(said, "line string, answer string")


def utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("type", sanitize_rel_type("in region")), ("digit", sanitize_rel_type("2nd")), ("keyword", sanitize_rel_type("match")), ("escape", escape_string("it's\n")), ("props", format_props({"a": 1, "b": True, "c": None, "d": "x'y"}))]
    return spark.createDataFrame(rows, "what string, value string")


ERRORS = {
    "unclosed": "MATCH (n RETURN n", "no return": "MATCH (n)", "unknown variable": "MATCH (n:Nation) RETURN m", "unknown function": "RETURN nope(1)", "arguments": "RETURN left('a')", "typecast": "RETURN 1::int", "power": "RETURN 2 ^ 3",
    "call": "CALL db.labels()", "nested aggregate": "MATCH (n:Nation) WHERE count(n) > 1 RETURN n", "missing parameter": "RETURN $x", "columns of union": "RETURN 1 AS a UNION RETURN 2 AS b", "unknown graph": "MATCH (n) FROM nowhere RETURN n", "with needs a name": "MATCH (n:Nation) WITH n.key + 1 RETURN 1",
}


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, trade_graph(spark, sf_dir))
    rows = [(k, _refused(lambda q=q: s.cypher(q))) for k, q in ERRORS.items()]
    rows += [("query type", _refused(lambda: s.cypher(1))), ("parameters", _refused(lambda: s.cypher("RETURN 1", "[1]"))), ("bad json", _refused(lambda: s.cypher("RETURN 1", "{")))]
    return spark.createDataFrame(rows, "what string, refused boolean")


def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, relational_graph(spark, sf_dir)).cypher("MATCH (n:Nation {name: $n}) RETURN n.key AS key, $l[1] AS second", '{"n": "NATION_7", "l": [1, 5]}').df


def explain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Session(spark, relational_graph(spark, sf_dir)).cypher("EXPLAIN MATCH (o:Order {status: 'F'}) WHERE o.totalprice > 1000 RETURN o.key AS key").df
    has = lambda s: F.contains("plan", F.lit(s))
    return plan.select(has("Match").alias("clauses"), has("EqualTo(o_orderstatus,F)").alias("pushed"), has("o_custkey").alias("extra_columns"), has("Python").alias("python"))


NATIONS = "(SELECT count(*) FROM nation)"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "bulk_frames": (bulk_frames, "SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"),
    "bulk_lists": (bulk_lists, f"SELECT r_name AS region, count(*) AS n, (SELECT count(*) FROM region) + {NATIONS} AS nodes, {NATIONS} AS edges, CAST(2 AS BIGINT) AS known, true AS refused FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "batch_nodes": (batch_nodes, "SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 'zero' WHEN n_nationkey >= 10 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey >= 10 THEN CAST(n_regionkey AS BIGINT) END AS region, 'Nation' AS label FROM nation UNION ALL SELECT 'x' || n_nationkey, 'new', NULL, 'Nation' FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'y0', 'why', NULL, 'Place'"),
    "batch_edges": (batch_edges, "SELECT 'n' || k AS a, 'n' || (k + b) AS b, CAST(b AS BIGINT) AS by FROM range(0, 25) t(k), (VALUES (1), (2)) v(b) WHERE k + b < 25"),
    "json_sink": (json_sink, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "unwind_create": (unwind_create, "SELECT 's' || i AS sku, i * i AS qty FROM range(0, 50) t(i) WHERE i * i > 100"),
    "load_csv_lists": (load_csv_lists, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation"),
    "stream_merge": (stream_merge, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"),
    "match_merge": (match_merge, "SELECT CAST(k AS VARCHAR) AS a, CAST(k + 1 AS VARCHAR) AS b, CAST(2 AS BIGINT) AS n FROM range(0, 24) t(k)"),
    "merge_edge": (merge_edge, "SELECT k AS a, k % 2 AS b FROM range(1, 6) t(k)"),
    "delete_rules": (delete_rules, f"SELECT true AS refused, {NATIONS} - 1 AS nodes, (SELECT count(*) FROM ({PAIRS}) WHERE a <> 0 AND b <> 0) AS edges"),
    "remove_label": (remove_label, "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey % 2 = 1 AS big FROM nation"),
    "result_stats": (result_stats, rows_sql("query, stat, n", [(q, s, n) for q, ns in (("CREATE", (2, 1, 3, 0, 0)), ("MATCH ", (0, 0, 2, 0, 0)), ("MATCH ", (0, 0, 0, 1, 1))) for s, n in zip(("nodes_created", "relationships_created", "properties_set", "nodes_deleted", "relationships_deleted"), ns, strict=True)])),
    "transactions": (transactions, rows_sql("step, n", [("before", 2), ("after", 1), ("again", 4)])),
    "query_builder": (query_builder, "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 10 AND r_name <> 'ASIA'"),
    "typed_rows": (typed_rows, rows_sql("what, ok", [(k, True) for k in ("i", "as float", "f", "s", "b", "l", "z", "wrong type", "no column", "bool is no int")])),
    "graph_object": (graph_object, rows_sql("what, value", [("age", "3"), ("label", "P"), ("type", "KNOWS"), ("edge", "True"), ("back", "False"), ("degree", "1"), ("neighbour", "a"), ("edges of b", "1"), ("nodes", "2"), ("edges", "1"), ("left", "{'nodes': 1, 'edges': 0}"), ("b", "False"), ("none", "None")])),
    "algorithm_methods": (algorithm_methods, f"SELECT name, {NATIONS} AS n FROM (VALUES ('pagerank'), ('degree'), ('betweenness'), ('closeness'), ('eigenvector'), ('communities'), ('louvain'), ('wcc'), ('scc'), ('triangles')) v(name)"),
    "algorithm_with_tables": (algorithm_with_tables, f"SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS degree FROM (SELECT a AS k FROM ({PAIRS}) UNION ALL SELECT b FROM ({PAIRS})) JOIN nation ON k = n_nationkey GROUP BY 1"),
    "cache_control": (cache_control, f"SELECT {NATIONS} + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)) AS edges, true AS cached, false AS later"),
    "catalog_queries": (catalog_queries, "SELECT 'nations' AS g, 'regions' AS h, n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "catalog_sql": (catalog_sql, "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"),
    "catalog_names": (catalog_names, rows_sql("what, value", [("empty", "[]"), ("twice", "True"), ("all", "['a', 'b', 'c']"), ("in", "True"), ("len", "3"), ("left", "['a', 'c']"), ("gone", "False"), ("no such", "True"), ("drop", "True")])),
    "shell_lines": (shell_lines, rows_sql("line, answer", [("create", "{'nodes_created': 1, 'relationships_created': 0, 'properties_set': 1, 'nodes_deleted': 0, 'relationships_deleted': 0}"), ("read", '[{"v": 1}]'), ("tables", "(:P {v: bigint})"), ("stats", "{'nodes': 1, 'edges': 0}"), ("quit", "None"), ("error", "True")])),
    "utilities": (utilities, rows_sql("what, value", [("type", "in_region"), ("digit", "REL_2nd"), ("keyword", "REL_match"), ("escape", "it\\'s\\n"), ("props", "{`a`: 1, `b`: true, `c`: null, `d`: 'x\\'y'}")])),
    "errors": (errors, rows_sql("what, refused", [(k, True) for k in (*ERRORS, "query type", "parameters", "bad json")])),
    "json_params": (json_params, "SELECT CAST(7 AS BIGINT) AS key, CAST(5 AS BIGINT) AS second"),
    "explain_flags": (explain_flags, "SELECT true AS clauses, true AS pushed, false AS extra_columns, false AS python"),
}
