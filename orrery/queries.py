"""Registered queries over the driver's tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import queries_api
from orrery.graph import Graph
from orrery.operators import centrality, community, components, paths, rank, similarity, traversal
from orrery.session import Session
from orrery.storage import shared_dir
from orrery.testgraph import BASE, SALES_BASE, SALES_WIDTH, market_graph, relational_graph, trade_graph

ITEMS = "lineitem JOIN orders ON l_orderkey = o_orderkey"
TURNS = "SELECT conv_id, turn, role, conv_id * 1000 + turn AS id FROM conversations"

#: name -> (query on the relational graph, SQL on the tables)
CYPHER: dict[str, tuple[str, str]] = {
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order {status: 'F'})-[i:HAS_ITEM]->(p:Part) WHERE i.quantity >= 10 RETURN p.brand AS brand, count(*) AS items, round(sum(i.extendedprice * (1 - i.discount)), 2) AS revenue ORDER BY revenue DESC, brand LIMIT 10",
        f"SELECT p_brand AS brand, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {ITEMS} JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND l_quantity >= 10 GROUP BY p_brand ORDER BY revenue DESC, brand LIMIT 10",
    ),
    "node_scan": ("MATCH (n) RETURN count(n) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations) AS n"),
    "label_scan": ("MATCH (c:Customer) RETURN c.key AS key, c.name AS name", "SELECT c_custkey AS key, c_name AS name FROM customer"),
    "edge_scan": ("MATCH ()-[r]->() RETURN type(r) AS type, count(*) AS n", "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'HAS_ITEM', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'DID', count(*) FROM events UNION ALL SELECT 'NEXT', count(*) FROM conversations WHERE turn > 0"),
    "inline_prop": ("MATCH (o:Order {status: 'F'}) RETURN o.key AS key", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'"),
    "inline_multi_prop": ("MATCH (o:Order {status: 'F', priority: '1-URGENT'}) RETURN o.key AS key", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "where_bool": ("MATCH (c:Customer) WHERE (c.acctbal > 5000 OR c.mktsegment = 'BUILDING') AND NOT c.key < 10 RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT c_custkey < 10"),
    "xor": ("MATCH (c:Customer) WHERE c.acctbal > 5000 XOR c.key % 2 = 0 RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE (c_acctbal > 5000) <> (c_custkey % 2 = 0)"),
    "null_checks": ("MATCH (e:Event) RETURN e.value IS NULL AS no_value, e.nothing IS NOT NULL AS has, count(*) AS n", "SELECT value IS NULL AS no_value, false AS has, count(*) AS n FROM events GROUP BY 1, 2"),
    "in_list": ("MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "starts_with": ("MATCH (p:Part) WHERE p.brand STARTS WITH 'Brand#1' RETURN p.key AS key", "SELECT p_partkey AS key FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    "ends_with": ("MATCH (c:Customer) WHERE c.name ENDS WITH '7' RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE ends_with(c_name, '7')"),
    "contains": ("MATCH (c:Customer) WHERE c.name CONTAINS '00012' RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE contains(c_name, '00012')"),
    "regex": ("MATCH (c:Customer) WHERE c.name =~ '1[0-4]+$' RETURN c.key AS key", "SELECT c_custkey AS key FROM customer WHERE regexp_matches(c_name, '1[0-4]+$')"),
    "arithmetic": ("MATCH (o:Order) RETURN o.key AS key, o.key / 7 AS d, o.key % 7 AS m, o.key - 3 AS s, -(o.key) * 2 AS neg, o.key / 0 AS z", "SELECT o_orderkey AS key, o_orderkey // 7 AS d, o_orderkey % 7 AS m, o_orderkey - 3 AS s, -o_orderkey * 2 AS neg, CAST(NULL AS BIGINT) AS z FROM orders"),
    "string_plus": ("MATCH (n:Nation) RETURN n.name + '-' + n.key AS tag", "SELECT n_name || '-' || CAST(n_nationkey AS VARCHAR) AS tag FROM nation"),
    "label_predicate": ("MATCH (n)-[:IN_NATION]->(:Nation) WHERE n:Supplier RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier"),
    "hop_out": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "hop_in": ("MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION]-(n) RETURN n.name AS nation", "SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "hop_undirected": ("MATCH (t:Turn {turn: 1})-[:NEXT]-(u) RETURN t.conv_id AS conv, u.turn AS turn", f"WITH t AS ({TURNS}) SELECT a.conv_id AS conv, b.turn AS turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 WHERE a.turn = 1"),
    "two_hop": ("MATCH (r:Region)<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer) RETURN r.name AS region, count(c) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "three_hop": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS n, round(sum(o.totalprice), 2) AS total", "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "type_alternation": ("MATCH (a)-[r:IN_REGION|IN_NATION]->(b) RETURN type(r) AS type, b.name AS name, count(a) AS n", "SELECT 'IN_REGION' AS type, r_name AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 2 UNION ALL SELECT 'IN_NATION', n_name, count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON n_nationkey = k GROUP BY 2"),
    "rel_prop_filter": ("MATCH (o:Order)-[i:HAS_ITEM {returnflag: 'R'}]->(p) WHERE i.quantity > 40 RETURN o.key AS o, p.key AS p, i.quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40"),
    "self_join_shared_var": ("MATCH (s:Supplier)-[:SUPPLIES]->(p)<-[:HAS_ITEM]-(o:Order {priority: '1-URGENT'}) WHERE s.key < 3 RETURN s.key AS s, count(DISTINCT o) AS orders", "SELECT s.l_suppkey AS s, count(DISTINCT o_orderkey) AS orders FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s JOIN lineitem i ON i.l_partkey = s.l_partkey JOIN orders ON i.l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND s.l_suppkey < 3 GROUP BY 1"),
    "cross_pattern": ("MATCH (r:Region), (n:Nation {name: 'NATION_3'}) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation WHERE n_name = 'NATION_3'"),
    "comma_patterns": ("MATCH (c:Customer)-[:PLACED]->(o:Order), (c)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r) WHERE o.status = 'P' RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P' GROUP BY 1"),
    "multi_match": ("MATCH (n:Nation)-[:IN_REGION]->(r {name: 'EUROPE'}) MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(s) AS suppliers", "SELECT n_name AS nation, count(*) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'EUROPE' GROUP BY 1"),
    "optional_match": ("MATCH (o:Order) OPTIONAL MATCH (o)-[i:HAS_ITEM]->(p:Part) RETURN o.key AS key, count(p) AS parts", "SELECT o_orderkey AS key, count(l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "optional_where": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 9000 RETURN n.name AS nation, s.name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000"),
    "exists_pattern": ("MATCH (n:Nation) WHERE EXISTS((n)<-[:IN_NATION]-(:Supplier)) RETURN n.name AS nation", "SELECT n_name AS nation FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "not_exists": ("MATCH (o:Order) WHERE NOT (o)-[:HAS_ITEM]->() RETURN o.key AS key", "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "exists_flag": ("MATCH (o:Order) RETURN EXISTS { (o)-[i:HAS_ITEM]->() WHERE i.quantity > 49 } AS big, count(*) AS n", "SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS big, count(*) AS n FROM orders GROUP BY 1"),
    "exists_prop": ("MATCH (n) WHERE exists(n.mktsegment) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL"),
    "pattern_comprehension": ("MATCH (r:Region) RETURN r.name AS region, size([(r)<-[:IN_REGION]-(n) WHERE n.key > 10 | n.name]) AS n", "SELECT r_name AS region, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 10 GROUP BY 1"),
    "list_comprehension": ("MATCH (r:Region) RETURN r.key AS key, size([x IN range(0, r.key) WHERE x % 2 = 0 | x * x]) AS n, reduce(s = 0, y IN [x IN range(0, r.key) WHERE x % 2 = 0 | x * x] | s + y) AS total", "SELECT CAST(r_regionkey AS BIGINT) AS key, CAST(r_regionkey // 2 + 1 AS BIGINT) AS n, (SELECT CAST(sum(x * x) AS BIGINT) FROM range(0, r_regionkey + 1) t(x) WHERE x % 2 = 0) AS total FROM region"),
    "all_any_none_single": ("MATCH (n:Nation) RETURN n.key AS key, all(x IN [n.key, 10] WHERE x > 5) AS a, any(x IN [n.key, 3] WHERE x > 5) AS b, none(x IN [n.key] WHERE x > 20) AS c, single(x IN [n.key, 1] WHERE x = 1) AS d", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_nationkey > 5 AS a, n_nationkey > 5 AS b, n_nationkey <= 20 AS c, n_nationkey <> 1 AS d FROM nation"),
    "reduce": ("UNWIND range(1, 5) AS n RETURN n, reduce(acc = 0, x IN range(1, n) | acc + x) AS total", "SELECT n, n * (n + 1) // 2 AS total FROM range(1, 6) t(n)"),
    "subscript": ("UNWIND [[1, 2, 3], [4, 5, 6]] AS l RETURN l[0] AS first, l[-1] AS last, l[9] AS none", "SELECT CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last, CAST(NULL AS BIGINT) AS none FROM (VALUES (1, 3), (4, 6)) t(a, b)"),
    "case_searched": ("MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1"),
    "case_simple": ("MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, count(*) AS n", "SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS code, count(*) AS n FROM orders GROUP BY 1"),
    "map_projection": ("MATCH (n:Nation) WITH n{.name, .key, double: n.key * 2} AS m RETURN m.name AS name, m.double AS double", "SELECT n_name AS name, CAST(n_nationkey * 2 AS BIGINT) AS double FROM nation"),
    "string_fns": (
        "MATCH (n:Nation) RETURN toUpper(n.name) AS u, toLower(n.name) AS l, trim('  x ') AS t, length(n.name) AS len, reverse(n.name) AS r, substring(n.name, 1, 3) AS s, replace(n.name, 'NATION', 'N') AS p, size(split(n.name, '_')) AS parts, left(n.name, 2) AS a, right(n.name, 2) AS b",
        "SELECT upper(n_name) AS u, lower(n_name) AS l, 'x' AS t, length(n_name) AS len, reverse(n_name) AS r, substr(n_name, 2, 3) AS s, replace(n_name, 'NATION', 'N') AS p, CAST(len(string_split(n_name, '_')) AS BIGINT) AS parts, left(n_name, 2) AS a, right(n_name, 2) AS b FROM nation",
    ),
    "math_fns": (
        "MATCH (c:Customer) RETURN c.key AS key, abs(c.acctbal) AS a, ceil(c.acctbal) AS ce, floor(c.acctbal) AS fl, sign(c.acctbal) AS si, round(sqrt(abs(c.acctbal)), 6) AS sq, round(log(c.key + 1), 6) AS ln, round(log10(c.key + 1), 6) AS lg, round(exp(c.key % 5), 6) AS ex, sqrt(-1) IS NULL AS bad",
        "SELECT c_custkey AS key, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(sign(c_acctbal) AS BIGINT) AS si, round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(c_custkey + 1), 6) AS ln, round(log10(c_custkey + 1), 6) AS lg, round(exp(c_custkey % 5), 6) AS ex, true AS bad FROM customer",
    ),
    "trig_fns": ("UNWIND [0.0, 0.25, 0.5, 1.0] AS x RETURN x, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 6) AS t, round(asin(x), 6) AS a, round(acos(x), 6) AS b, round(atan(x), 6) AS d, round(pi(), 6) AS p, round(e(), 6) AS e", "SELECT x, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 6) AS t, round(asin(x), 6) AS a, round(acos(x), 6) AS b, round(atan(x), 6) AS d, round(pi(), 6) AS p, round(exp(1), 6) AS e FROM (VALUES (CAST(0.0 AS DOUBLE)), (0.25), (0.5), (1.0)) v(x)"),
    "conversion_fns": ("UNWIND ['12', '3.7', 'abc', 'true'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(12) AS t", "SELECT s, CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS i, TRY_CAST(s AS DOUBLE) AS f, CASE WHEN s = 'true' THEN true END AS b, '12' AS t FROM (VALUES ('12'), ('3.7'), ('abc'), ('true')) v(s)"),
    "list_fns": ("UNWIND [[3, 1, 2], [7]] AS l RETURN head(l) AS h, last(l) AS z, size(tail(l)) AS t, size(l) AS n, head(reverse(l)) AS r, size(l + [9]) AS more", "SELECT CAST(h AS BIGINT) AS h, CAST(z AS BIGINT) AS z, CAST(n - 1 AS BIGINT) AS t, CAST(n AS BIGINT) AS n, CAST(z AS BIGINT) AS r, CAST(n + 1 AS BIGINT) AS more FROM (VALUES (3, 2, 3), (7, 7, 1)) v(h, z, n)"),
    "range_unwind": ("UNWIND range(10, 1, -3) AS x RETURN x", "SELECT x FROM range(10, 0, -3) t(x)"),
    "unwind_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n.key) AS keys UNWIND keys AS k RETURN r.name AS region, sum(k) AS total", "SELECT r_name AS region, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "coalesce": ("MATCH (n) WHERE n:Nation OR n:Customer RETURN coalesce(n.mktsegment, n.nothing, 'none') AS seg, count(*) AS n", "SELECT coalesce(seg, 'none') AS seg, count(*) AS n FROM (SELECT c_mktsegment AS seg FROM customer UNION ALL SELECT NULL FROM nation) GROUP BY 1"),
    "count_distinct": ("MATCH (c:Customer)-[:PLACED]->(o) RETURN count(DISTINCT c) AS customers, count(DISTINCT o.status) AS statuses, count(*) AS orders", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses, count(*) AS orders FROM orders"),
    "sum_avg_min_max": ("MATCH (o:Order)-[i:HAS_ITEM]->() RETURN o.status AS status, round(sum(i.quantity), 2) AS s, round(avg(i.quantity), 6) AS a, min(i.extendedprice) AS lo, max(o.priority) AS hi", f"SELECT o_orderstatus AS status, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_extendedprice) AS lo, max(o_orderpriority) AS hi FROM {ITEMS} GROUP BY 1"),
    "group_return": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, c.key % 3 AS third, count(*) + 1 AS n", "SELECT c_mktsegment AS seg, c_custkey % 3 AS third, count(*) + 1 AS n FROM customer GROUP BY 1, 2"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, max(o.totalprice) AS top WHERE n > 12 RETURN c.name AS name, n, top", "SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12"),
    "with_limit_match": ("MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.key LIMIT 5 MATCH (c)-[:PLACED]->(o) RETURN c.key AS key, count(o) AS n", "SELECT c_custkey AS key, count(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n) RETURN DISTINCT n.name AS nation, c.mktsegment AS seg", "SELECT DISTINCT n_name AS nation, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "order_multi": ("MATCH (p:Part) RETURN p.brand AS brand, p.size AS size, p.key AS key ORDER BY p.brand DESC, size, key LIMIT 50", "SELECT p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_partkey AS key FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 50"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.key AS key ORDER BY key SKIP 20 LIMIT 15", "SELECT c_custkey AS key FROM customer ORDER BY key LIMIT 15 OFFSET 20"),
    "union": ("MATCH (n:Nation) RETURN n.key % 3 AS k UNION MATCH (r:Region) RETURN r.key AS k", "SELECT CAST(n_nationkey % 3 AS BIGINT) AS k FROM nation UNION SELECT CAST(r_regionkey AS BIGINT) FROM region"),
    "union_all": ("MATCH (n:Nation) RETURN n.key AS k UNION ALL MATCH (r:Region) RETURN r.key AS k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) FROM region"),
    "labels_type_id": ("MATCH (n:Nation)-[r:IN_REGION]->(m) RETURN head(labels(n)) AS label, type(r) AS type, id(n) AS id, id(m) AS to", f"SELECT 'Nation' AS label, 'IN_REGION' AS type, CAST({BASE} + n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS \"to\" FROM nation"),
    "keys_properties": ("MATCH (n:Nation) RETURN size(keys(n)) AS k, properties(n).name AS name", "SELECT CAST(2 AS BIGINT) AS k, n_name AS name FROM nation"),
    "start_end_node": ("MATCH ()-[r:IN_REGION]->() RETURN startNode(r) AS a, endNode(r) AS b", f"SELECT CAST({BASE} + n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation"),
    "nested_property": ("MATCH (e:Event) WHERE e.props.k > 50 RETURN e.key AS key, e.props.k AS k", "SELECT event_id AS key, props->>'$.k' AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 50"),
    "varlen_1_3": ("MATCH (a:Turn {turn: 0})-[:NEXT*1..3]->(b:Turn) RETURN a.conv_id AS conv, b.turn AS turn", "SELECT conv_id AS conv, CAST(turn AS BIGINT) AS turn FROM conversations WHERE turn BETWEEN 1 AND 3"),
    "varlen_exact": ("MATCH (a:Turn)-[:NEXT*2]->(b:Turn) RETURN a.turn AS a, count(*) AS n", "SELECT CAST(turn - 2 AS BIGINT) AS a, count(*) AS n FROM conversations WHERE turn >= 2 GROUP BY 1"),
    "varlen_zero": ("MATCH (a:Turn {turn: 0})-[:NEXT*0..1]->(b:Turn) RETURN a.conv_id AS conv, b.turn AS turn", "SELECT conv_id AS conv, CAST(turn AS BIGINT) AS turn FROM conversations WHERE turn <= 1"),
    "varlen_unbounded": ("MATCH (a:Turn {turn: 0})-[:NEXT*]->(b:Turn) RETURN a.conv_id AS conv, count(b) AS n", "SELECT conv_id AS conv, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY 1"),
    "shortest_path": ("MATCH (a:Turn {turn: 0}), (b:Turn {role: 'assistant'}), p = shortestPath((a)-[:NEXT*]->(b)) RETURN a.conv_id AS conv, b.turn AS turn, length(p) AS hops", "SELECT conv_id AS conv, CAST(turn AS BIGINT) AS turn, CAST(turn AS BIGINT) AS hops FROM conversations WHERE turn > 0 AND role = 'assistant'"),
    "all_shortest_paths": ("MATCH p = allShortestPaths((s:Supplier {key: 1})-[:SUPPLIES|HAS_ITEM*..2]-(o:Order)) RETURN count(p) AS n", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey = 1) s JOIN lineitem i USING (l_partkey)"),
    "path_length_nodes": ("MATCH p = (a:Turn {turn: 0})-[:NEXT]->(b)-[:NEXT]->(c) RETURN length(p) AS len, size(nodes(p)) AS nodes, size(relationships(p)) AS rels, last(nodes(p)) = id(c) AS ok, count(*) AS n", "SELECT CAST(2 AS BIGINT) AS len, CAST(3 AS BIGINT) AS nodes, CAST(2 AS BIGINT) AS rels, true AS ok, count(*) AS n FROM conversations WHERE turn = 2"),
}


def cypher_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(spark, relational_graph(spark, sf_dir)).cypher(text).df


TRADES = """trades AS (SELECT CAST(s_nationkey AS BIGINT) AS s, CAST(c_nationkey AS BIGINT) AS d, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
MARKET = f"""items AS (SELECT l_suppkey AS s, o_custkey AS c, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT CAST({BASE} + s AS BIGINT) AS s, CAST(2 * {BASE} + c AS BIGINT) AS d, CAST(n AS DOUBLE) AS w, CAST({SALES_BASE} + CAST(s AS BIGINT) * {SALES_WIDTH} + c AS BIGINT) AS id FROM items
  UNION ALL SELECT 2 * {BASE} + c_custkey, c_nationkey, 1.0, c_custkey FROM customer UNION ALL SELECT s_nationkey, {BASE} + s_suppkey, 1.0, {BASE} + s_suppkey FROM supplier),
v AS MATERIALIZED (SELECT CAST(n_nationkey AS BIGINT) AS id, 'n' || n_nationkey AS name FROM nation UNION ALL SELECT {BASE} + s_suppkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 2 * {BASE} + c_custkey, 'c' || c_custkey FROM customer),
both_ways AS MATERIALIZED (SELECT s AS a, d AS b FROM e UNION ALL SELECT d, s FROM e)"""
DEPTH = 16  # levels of a search that are written out; the market graph has fewer


def _page_rank_sql(iterations: int, seeds: str | None = None) -> str:
    jump = "1.0 / (SELECT count(*) FROM v)" if seeds is None else f"CASE WHEN name IN ({seeds}) THEN 1.0 / (SELECT count(*) FROM v WHERE name IN ({seeds})) ELSE 0.0 END"
    ctes = [MARKET, "deg AS MATERIALIZED (SELECT s, count(*) AS k FROM e GROUP BY 1)", f"r0 AS MATERIALIZED (SELECT id, CAST({jump} AS DOUBLE) AS j, CAST({jump} AS DOUBLE) AS r FROM v)"]
    for i in range(iterations):
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT x.id, x.j, 0.15 * x.j + 0.85 * coalesce(g.r, 0) AS r FROM r{i} x LEFT JOIN (SELECT d, sum(r / k) AS r FROM e JOIN deg USING (s) JOIN r{i} ON r{i}.id = s GROUP BY d) g ON g.d = x.id)")
    return f"WITH {', '.join(ctes)} SELECT id AS node_id, round(r, 6) AS score FROM r{iterations}"


def _labels_sql(iterations: int) -> str:
    ctes = [MARKET, "l0 AS MATERIALIZED (SELECT id, id AS l FROM v)"]
    for i in range(iterations):
        ctes.append(f"b{i} AS MATERIALIZED (SELECT a, l FROM (SELECT a, l, count(*) AS k FROM both_ways JOIN l{i} ON id = b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY k DESC, l) = 1)")
        ctes.append(f"l{i + 1} AS MATERIALIZED (SELECT v.id, coalesce(l, v.id) AS l FROM v LEFT JOIN b{i} ON a = v.id)")
    return f"WITH {', '.join(ctes)} "


def _levels(edges: str, a: str, b: str, starts: str = "") -> list[str]:
    """Tables f0, f1, ...: (s, t, p): nodes first met at that distance from s, and the number of shortest paths; z0, z1, ...: what is met so far."""
    ctes = [f"f0 AS MATERIALIZED (SELECT id AS s, id AS t, CAST(1 AS DOUBLE) AS p FROM v {starts})", "z0 AS MATERIALIZED (SELECT s, t FROM f0)"]
    for i in range(1, DEPTH + 1):
        ctes.append(f"f{i} AS MATERIALIZED (SELECT s, t, sum(p) AS p FROM (SELECT f.s, x.{b} AS t, f.p FROM f{i - 1} f JOIN {edges} x ON x.{a} = f.t) n ANTI JOIN z{i - 1} USING (s, t) GROUP BY 1, 2)")
        ctes.append(f"z{i} AS MATERIALIZED (SELECT s, t FROM z{i - 1} UNION ALL SELECT s, t FROM f{i})")
    return ctes


def _distances(edges: str = "e", a: str = "s", b: str = "d", starts: str = "") -> str:
    """WITH ... dist(s, t, d): hops from each start to what it reaches."""
    dist = " UNION ALL ".join(f"SELECT s, t, {i} AS d FROM f{i}" for i in range(DEPTH + 1))
    return f"WITH {', '.join([MARKET, *_levels(edges, a, b, starts), f'dist AS MATERIALIZED ({dist})'])} "


def _betweenness_sql() -> str:
    ctes = [MARKET, *_levels("e", "s", "d"), f"g{DEPTH} AS MATERIALIZED (SELECT s, t, p, CAST(0 AS DOUBLE) AS x FROM f{DEPTH})"]
    for i in range(DEPTH - 1, 0, -1):
        ctes.append(f"g{i} AS MATERIALIZED (SELECT f.s, f.t, f.p, coalesce(f.p * q.x, 0) AS x FROM f{i} f LEFT JOIN (SELECT g.s, x.s AS t, sum((1 + g.x) / g.p) AS x FROM g{i + 1} g JOIN e x ON x.d = g.t GROUP BY 1, 2) q USING (s, t))")
    parts = " UNION ALL ".join(f"SELECT t, x FROM g{i}" for i in range(1, DEPTH))
    return f"WITH {', '.join(ctes)} SELECT id AS node_id, round(coalesce(x, 0), 4) AS score FROM v LEFT JOIN (SELECT t, sum(x) AS x FROM ({parts}) GROUP BY t) ON t = id"


SETS = f"WITH {MARKET}, n AS (SELECT DISTINCT s, d FROM e), deg AS (SELECT s, count(*) AS k FROM n GROUP BY 1), sim AS (SELECT a.s AS x, b.s AS y, count(*) AS c FROM n a JOIN n b ON a.d = b.d AND a.s <> b.s GROUP BY 1, 2), j AS (SELECT x, y, c / (p.k + q.k - c) AS similarity FROM sim JOIN deg p ON p.s = x JOIN deg q ON q.s = y) "
POWER_STEPS = 5


def _power_sql() -> str:
    ctes = [MARKET, "x0 AS (SELECT id, 1 / sqrt((SELECT count(*) FROM v)) AS x FROM v)"]
    for i in range(POWER_STEPS):
        ctes.append(f"y{i} AS MATERIALIZED (SELECT v.id, coalesce(y, 0) AS y FROM v LEFT JOIN (SELECT d, sum(x) AS y FROM e JOIN x{i} ON x{i}.id = s GROUP BY d) ON d = v.id)")
        ctes.append(f"x{i + 1} AS (SELECT id, y / sqrt((SELECT sum(y * y) FROM y{i})) AS x FROM y{i})")
    return f"WITH {', '.join(ctes)} SELECT id AS node_id, round(x, 6) AS score FROM x{POWER_STEPS}"


def _weighted_sql(a: str, b: str, rounds: int = 24) -> str:
    ctes = [MARKET, f"d0 AS (SELECT id AS t, CAST(0 AS DOUBLE) AS c FROM v WHERE name = '{a}')"]
    for i in range(rounds):
        ctes.append(f"d{i + 1} AS MATERIALIZED (SELECT t, min(c) AS c FROM (SELECT t, c FROM d{i} UNION ALL SELECT d, c + w FROM d{i} JOIN e ON t = s) GROUP BY t)")
    end = f"FROM d{rounds} WHERE t = (SELECT id FROM v WHERE name = '{b}')"
    return f"WITH {', '.join(ctes)} SELECT (SELECT c {end}) AS distance, EXISTS (SELECT 1 {end}) AS found"


def _hops_sql(a: str, b: str) -> str:
    end = f"FROM dist WHERE t = (SELECT id FROM v WHERE name = '{b}')"
    start = f"WHERE name = '{a}'"
    return _distances(starts=start) + f"SELECT (SELECT CAST(d AS DOUBLE) {end}) AS distance, EXISTS (SELECT 1 {end}) AS found"


def _dfs_sql(start: str) -> str:
    """Preorder by a stack machine: one row of state (stack, what is seen, what was put out) for each step."""
    return (
        f"WITH RECURSIVE {MARKET}, adj AS MATERIALIZED (SELECT v.id AS x, coalesce((SELECT list(d ORDER BY e.id) FROM e WHERE s = v.id), []) AS l FROM v), "
        f"run(i, stack, seen, depth) AS (SELECT 0, [id], [id], [CAST(0 AS BIGINT)] FROM v WHERE name = '{start}' UNION ALL "
        "SELECT i + 1, CASE WHEN y IS NULL THEN stack[:-2] ELSE list_append(stack, y) END, CASE WHEN y IS NULL THEN seen ELSE list_append(seen, y) END, CASE WHEN y IS NULL THEN depth ELSE list_append(depth, len(stack)) END "
        "FROM (SELECT run.*, list_filter(l, lambda z: NOT list_contains(seen, z))[1] AS y FROM run JOIN adj ON x = stack[-1])), "
        "done AS (SELECT seen, depth FROM run ORDER BY i DESC LIMIT 1) "
        "SELECT unnest(seen) AS node_id, unnest(depth) AS depth, CAST(unnest(range(0, len(seen))) AS BIGINT) AS \"order\" FROM done"
    )


def _market(f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(market_graph(spark, sf_dir))


def _scored(f: Callable[[Graph], DataFrame], digits: int = 6) -> Callable[[Graph], DataFrame]:
    return lambda g: f(g).select("node_id", F.round("score", digits).alias("score"))


def _call(text: str, *columns: str) -> Callable[[Graph], DataFrame]:
    """An algorithm as a query calls it."""
    return lambda g: Session(g.spark, g).cypher(text).df.selectExpr(*columns)


#: Strong components: pairs that reach each other, from the distances of all pairs.
STRONG = "SELECT s AS node_id, dense_rank() OVER (ORDER BY f) - 1 AS component FROM (SELECT a.s, min(a.t) AS f FROM dist a JOIN dist b ON a.s = b.t AND a.t = b.s GROUP BY 1)"

#: name -> (function on the market graph, SQL or None)
ALGORITHMS: dict[str, tuple[Callable[[Graph], DataFrame], str | None]] = {
    "pagerank": (_call("RETURN pageRank(0.85, 8)", "node_id", "round(score, 6) AS score"), _page_rank_sql(8)),
    "top_pagerank": (_call("RETURN topPageRank(5, 0.85, 8)", "round(score, 6) AS score"), f"SELECT score FROM ({_page_rank_sql(8)}) ORDER BY score DESC LIMIT 5"),
    "personalized_pagerank": (_scored(lambda g: rank.page_rank(g, 0.85, 6, ["n0", "n3"])), _page_rank_sql(6, "'n0', 'n3'")),
    "label_propagation": (lambda g: community.label_propagation(g, 4).select("node_id", "community"), _labels_sql(4) + "SELECT id AS node_id, dense_rank() OVER (ORDER BY f) - 1 AS community FROM (SELECT id, min(id) OVER (PARTITION BY l) AS f FROM l4)"),
    "communities": (lambda g: community.communities(g, 4), _labels_sql(4) + "SELECT id AS node_id, l AS community FROM l4"),
    "community_of": (lambda g: community.community_of(g, 7, 4), _labels_sql(4) + "SELECT l AS community FROM l4 WHERE id = 7"),
    "community_members": (_call("RETURN communityMembers(0, 4)", "node_id"), _labels_sql(4) + "SELECT id AS node_id FROM l4 WHERE l = 0"),
    "community_count": (lambda g: community.community_count(g, 4), _labels_sql(4) + "SELECT count(DISTINCT l) AS community_count FROM l4"),
    "degree_centrality": (lambda g: centrality.degree_centrality(g).drop("user_id"), f"WITH {MARKET}, i AS (SELECT d, count(*) AS n FROM e GROUP BY 1), o AS (SELECT s, count(*) AS n FROM e GROUP BY 1) SELECT id AS node_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM v LEFT JOIN i ON d = id LEFT JOIN o ON s = id"),
    "wcc": (lambda g: components.wcc(g).select("node_id", "component"), _distances("both_ways", "a", "b") + "SELECT s AS node_id, dense_rank() OVER (ORDER BY f) - 1 AS component FROM (SELECT s, min(t) AS f FROM dist GROUP BY 1)"),
    "scc": (lambda g: components.scc(g).select("node_id", "component"), _distances() + STRONG),
    "scc_distributed": (lambda g: components.scc(g, True).select("node_id", "component"), _distances() + STRONG),
    "triangle_count": (
        lambda g: similarity.triangle_count(g).select("node_id", "triangles", F.round("clustering_coefficient", 6).alias("clustering")),
        f"WITH {MARKET}, u AS MATERIALIZED (SELECT DISTINCT least(s, d) AS a, greatest(s, d) AS b FROM e WHERE s <> d), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), c AS (SELECT n, count(*) AS k FROM (SELECT p AS n FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1), dg AS (SELECT n, count(*) AS k FROM (SELECT a AS n FROM u UNION ALL SELECT b FROM u) GROUP BY 1) SELECT id AS node_id, coalesce(c.k, 0) AS triangles, round(CASE WHEN dg.k > 1 THEN 2.0 * coalesce(c.k, 0) / (dg.k * (dg.k - 1)) ELSE 0 END, 6) AS clustering FROM v LEFT JOIN c ON c.n = id LEFT JOIN dg ON dg.n = id",
    ),
    "node_similarity": (lambda g: similarity.node_similarity(g, 0.2).select("node1", "node2", F.round("similarity", 6).alias("similarity")), SETS + "SELECT p.name AS node1, q.name AS node2, round(similarity, 6) AS similarity FROM j JOIN v p ON p.id = x JOIN v q ON q.id = y WHERE x < y AND similarity >= 0.2"),
    "node_similarity_all": (lambda g: similarity.pairs_by_similarity(g, 6), SETS + "SELECT round(coalesce(similarity, 0), 6) AS similarity, count(*) AS pairs FROM v a JOIN v b ON a.id < b.id LEFT JOIN j ON x = a.id AND y = b.id GROUP BY 1"),
    "knn": (_call("RETURN knn('s1', 5)", "neighbor", "round(similarity, 6) AS similarity", "rank"), SETS + "SELECT q.name AS neighbor, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, y) AS rank FROM j JOIN v p ON p.id = x JOIN v q ON q.id = y WHERE p.name = 's1' ORDER BY similarity DESC, y LIMIT 5"),
    "bfs": (lambda g: traversal.bfs(g, "s1").select("node_id", "depth"), _distances(starts="WHERE name = 's1'") + "SELECT t AS node_id, CAST(d AS BIGINT) AS depth FROM dist"),
    "bfs_depth": (_call("RETURN bfs('s1', 1)", "node_id", "depth", "`order`"), f"WITH {MARKET}, x AS (SELECT id FROM v WHERE name = 's1') SELECT id AS node_id, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS \"order\" FROM x UNION ALL SELECT d, 1, row_number() OVER (ORDER BY e.id) FROM e JOIN x ON s = x.id WHERE d <> s"),
    "dfs": (lambda g: traversal.dfs(g, "s1").select("node_id", "depth", "order"), _dfs_sql("s1")),
    "apsp": (paths.pairs_by_distance, _distances() + "SELECT CAST(d AS DOUBLE) AS distance, count(*) AS pairs FROM dist WHERE s <> t GROUP BY 1"),
    "dijkstra": (_call("RETURN dijkstra('n0', 'n7')", "distance", "found"), _hops_sql("n0", "n7")),
    "dijkstra_weighted": (_call("RETURN dijkstra('s1', 's2', 'weight')", "distance", "found"), _weighted_sql("s1", "s2")),
    "dijkstra_distributed": (lambda g: paths.dijkstra(g, "s1", "s2", "weight", True).select("distance", "found"), _weighted_sql("s1", "s2")),
    "astar": (_call("RETURN astar('s1', 'n7')", "distance", "found"), _hops_sql("s1", "n7")),
    "closeness": (_scored(centrality.closeness_centrality), _distances("both_ways", "a", "b") + "SELECT s AS node_id, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / ((SELECT count(*) FROM v) - 1), 6) AS score FROM dist GROUP BY 1"),
    "betweenness": (_scored(centrality.betweenness_centrality, 4), _betweenness_sql()),
    "eigenvector": (_scored(lambda g: rank.eigenvector_centrality(g, POWER_STEPS)), _power_sql()),
    "louvain": (lambda g: community.louvain(g).select("node_id", "community"), None),
}


# Writes, several graphs and files


def _write_session(spark: SparkSession, sf_dir: str) -> Session:
    """On written tables: each update reads them several times."""
    return Session(spark, trade_graph(spark, sf_dir).settled())


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _write_session(spark, sf_dir)
    s.cypher("UNWIND range(20, 29) AS k MERGE (n:Nation {id: toString(k)}) ON CREATE SET n.state = 'new' ON MATCH SET n.state = 'old'")
    return s.cypher("MATCH (n:Nation) RETURN n.id AS id, n.state AS state").df


def create_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _write_session(spark, sf_dir)
    s.cypher("MATCH (n:Nation) WHERE n.name ENDS WITH '0' CREATE (n)-[:HAS {since: 2020}]->(:Port {of: n.name})")
    return s.cypher("MATCH (n:Nation)-[h:HAS]->(p:Port) RETURN n.name AS nation, p.of AS port, h.since AS since").df


def set_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _write_session(spark, sf_dir)
    s.cypher("MATCH (a:Nation)-[r:TRADES]->(b) WITH a, count(r) AS k SET a.partners = k, a:Trader")
    return s.cypher("MATCH (n:Trader) RETURN n.name AS name, n.partners AS partners, size(labels(n)) AS labels").df


def remove_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _write_session(spark, sf_dir)
    s.cypher("MATCH (n:Nation) WHERE toInteger(n.id) < 10 REMOVE n.name")
    return s.cypher("MATCH (n:Nation) RETURN n.id AS id, n.name AS name").df


def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _write_session(spark, sf_dir)
    s.cypher("MATCH (n:Nation {id: '0'}) DETACH DELETE n")
    return s.cypher("MATCH (a)-[r:TRADES]->(b) RETURN id(a) AS a, id(b) AS b").df


def foreach_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.cypher("FOREACH (x IN range(1, 4) | CREATE (:Num {v: x, sq: x * x}))")
    return s.cypher("MATCH (n:Num) RETURN n.v AS v, n.sq AS sq").df


def from_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, relational_graph(spark, sf_dir), {"trade": trade_graph(spark, sf_dir)})
    return s.cypher("MATCH (a:Nation)-[r:TRADES]->(b) FROM trade RETURN graph(a) AS g, a.name AS a, b.name AS b, r.weight AS w").df


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, relational_graph(spark, sf_dir))
    return s.cypher("MATCH (c:Customer) WHERE c.mktsegment IN $segs AND c.acctbal > $least RETURN c.key AS key, $tag AS tag", {"segs": ["BUILDING", "MACHINERY"], "least": 2500.5, "tag": "x"}).df


def apsp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, trade_graph(spark, sf_dir)).cypher("RETURN apsp()").df


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.csv(path, header=True, sep=";")
    return Session(spark).cypher(f"LOAD CSV WITH HEADERS FROM '{path}' AS row FIELDTERMINATOR ';' RETURN toInteger(row.n_nationkey) AS key, row.n_name AS name").df


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, relational_graph(spark, sf_dir)).cypher(f"EXPLAIN {CYPHER['flagship'][0]}").df


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "merge_upsert": (merge_upsert, "SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k >= 25 THEN 'new' WHEN k >= 20 THEN 'old' END AS state FROM range(0, 30) t(k)"),
    "create_read_back": (create_read_back, "SELECT n_name AS nation, n_name AS port, CAST(2020 AS BIGINT) AS since FROM nation WHERE ends_with(n_name, '0')"),
    "set_read_back": (set_read_back, f"WITH {TRADES} SELECT n_name AS name, count(*) AS partners, CAST(2 AS BIGINT) AS labels FROM trades JOIN nation ON n_nationkey = s GROUP BY 1"),
    "remove_prop": (remove_prop, "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey >= 10 THEN n_name END AS name FROM nation"),
    "detach_delete": (detach_delete, f"WITH {TRADES} SELECT s AS a, d AS b FROM trades WHERE s <> 0 AND d <> 0"),
    "foreach_create": (foreach_create, "SELECT v, v * v AS sq FROM range(1, 5) t(v)"),
    "from_graph": (from_graph, f"WITH {TRADES} SELECT 'trade' AS g, p.n_name AS a, q.n_name AS b, CAST(n AS DOUBLE) AS w FROM trades JOIN nation p ON p.n_nationkey = s JOIN nation q ON q.n_nationkey = d"),
    "params": (params, "SELECT c_custkey AS key, 'x' AS tag FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 2500.5"),
    "apsp_pairs": (apsp_pairs, f"WITH RECURSIVE {TRADES}, hops(s, t, d) AS (SELECT s, d, 1 FROM trades UNION SELECT hops.s, trades.d, hops.d + 1 FROM hops JOIN trades ON hops.t = trades.s WHERE hops.d < 25) SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target, CAST(min(d) AS DOUBLE) AS distance FROM hops WHERE s <> t GROUP BY 1, 2"),
    "load_csv": (load_csv, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation"),
    "explain": (explain, None),
}

CYPHER |= queries_api.CYPHER
OTHERS |= queries_api.OTHERS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: cypher_query(q) for k, (q, _) in CYPHER.items()} | {k: _market(f) for k, (f, _) in ALGORITHMS.items()} | {k: f for k, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {k: sql for table in (CYPHER, ALGORITHMS, OTHERS) for k, (_, sql) in table.items() if sql}
