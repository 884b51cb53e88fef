"""The driver's relational tables seen as a property graph."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.graph import EdgeTable, Graph, NodeTable
from orrery.storage import shares

BASE = 1_000_000_000


def _id(kind: int, key) -> Column:
    return F.lit(BASE * kind) + F.col(key).cast("long") if isinstance(key, str) else F.lit(BASE * kind) + key


@lru_cache(maxsize=8)
def relational_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, Nation, Customer, Supplier, Part, Order, User, Event and Turn nodes with their relationships.

    A graph is a bundle of lazy tables, so one for each session and folder does for all queries.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def node(label: str, df: DataFrame, ident, **props) -> NodeTable:
        return NodeTable(frozenset([label]), df.select(ident.alias("id"), *[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in props.items()]))

    def edge(kind: str, df: DataFrame, a, b, ident, src: str, dst: str, **props) -> EdgeTable:
        return EdgeTable(kind, df.select(ident.cast("long").alias("id"), a.alias("src"), b.alias("dst"), *[F.col(c).alias(k) for k, c in props.items()]), src, dst)

    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    part, orders, lineitem, events, turns = t("part"), t("orders"), t("lineitem"), t("events"), t("conversations")
    whole = lambda c: F.col(c).cast("long")
    turn = F.col("conv_id") * 1000 + F.col("turn")
    nodes = [
        node("Region", region, _id(0, "r_regionkey"), key=whole("r_regionkey"), name="r_name"),
        node("Nation", nation, _id(1, "n_nationkey"), key=whole("n_nationkey"), name="n_name"),
        node("Customer", customer, _id(2, "c_custkey"), key="c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        node("Supplier", supplier, _id(3, "s_suppkey"), key="s_suppkey", name="s_name", acctbal="s_acctbal"),
        node("Part", part, _id(4, "p_partkey"), key="p_partkey", name="p_name", brand="p_brand", type="p_type", size=whole("p_size"), retailprice="p_retailprice"),
        node("Order", orders, _id(5, "o_orderkey"), key="o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
        node("User", events.select("user_id").distinct(), _id(6, "user_id"), key="user_id"),
        node("Event", events, _id(7, "event_id"), key="event_id", event_type="event_type", value="value", ts="ts", props="props"),
        node("Turn", turns, _id(8, turn), conv_id="conv_id", turn=whole("turn"), role="role"),
    ]
    pairs = lineitem.select("l_suppkey", "l_partkey").distinct()
    edges = [
        edge("IN_REGION", nation, _id(1, "n_nationkey"), _id(0, "n_regionkey"), F.col("n_nationkey"), "Nation", "Region"),
        edge("IN_NATION", customer, _id(2, "c_custkey"), _id(1, "c_nationkey"), _id(1, "c_custkey"), "Customer", "Nation"),
        edge("PLACED", orders, _id(2, "o_custkey"), _id(5, "o_orderkey"), _id(3, "o_orderkey"), "Customer", "Order"),
        edge("HAS_ITEM", lineitem, _id(5, "l_orderkey"), _id(4, "l_partkey"), _id(4, F.col("l_orderkey") * 100 + F.col("l_linenumber")), "Order", "Part", linenumber="l_linenumber", quantity="l_quantity", extendedprice="l_extendedprice", discount="l_discount", tax="l_tax", returnflag="l_returnflag", shipdate="l_shipdate"),
        edge("SUPPLIES", pairs, _id(3, "l_suppkey"), _id(4, "l_partkey"), _id(6, F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")), "Supplier", "Part"),
        edge("DID", events, _id(6, "user_id"), _id(7, "event_id"), _id(7, "event_id"), "User", "Event"),
        edge("NEXT", turns.filter("turn > 0"), _id(8, turn - 1), _id(8, turn), _id(8, turn), "Turn", "Turn"),
    ]
    supply = edge("IN_NATION", supplier, _id(3, "s_suppkey"), _id(1, "s_nationkey"), _id(2, "s_suppkey"), "Supplier", "Nation")
    edges[1] = replace(edges[1], df=edges[1].df.union(supply.df), src_label=None)
    return Graph.from_tables(spark, nodes, edges)


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations (property id: the key) with TRADES to every nation that takes line items of their suppliers."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    sold = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    n = sold.groupBy(F.col("s_nationkey").cast("long").alias("s"), F.col("c_nationkey").cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("string").alias("id_"), F.col("n_name").alias("name"))
    edges = n.select((F.col("s") * 100 + F.col("d")).alias("id"), F.col("s").alias("src"), F.col("d").alias("dst"), F.col("n").cast("double").alias("weight"))
    return Graph.from_tables(spark, [NodeTable(frozenset(["Nation"]), nodes)], [EdgeTable("TRADES", edges, "Nation", "Nation")])


SALES_BASE, SALES_WIDTH = 10_000_000_000, 10_000_000_000


def market_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, suppliers and customers (property id: n, s or c and the key). A supplier SOLD to each customer that bought
    line items of it (weight: how many), a customer LIVES_IN a nation, which HOSTS its suppliers.

    It has cycles, triangles and dangling nodes, and grows with the tables. The algorithms are registered on it.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, supplier, customer = t("nation"), t("supplier"), t("customer")

    def node(label: str, df: DataFrame, kind: int, letter: str, key: str) -> NodeTable:
        return NodeTable(frozenset([label]), df.select(_id(kind, key).alias("id"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("id_")))

    lines, orders = t("lineitem").select("l_orderkey", "l_suppkey"), t("orders").select("o_orderkey", "o_custkey")
    n = shares(lines)  # so that no task's share of the joins and sums grows with the tables
    items = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("c")).repartition(n, "s", "c").groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"))
    items = items.join(supplier, F.col("s") == F.col("s_suppkey"), "left_semi").join(customer, F.col("c") == F.col("c_custkey"), "left_semi")
    sold = items.select((F.lit(SALES_BASE) + F.col("s") * SALES_WIDTH + F.col("c")).alias("id"), _id(1, "s").alias("src"), _id(2, "c").alias("dst"), F.col("n").cast("double").alias("weight"))
    lives = customer.select(F.col("c_custkey").cast("long").alias("id"), _id(2, "c_custkey").alias("src"), _id(0, "c_nationkey").alias("dst"))
    hosts = supplier.select(_id(1, "s_suppkey").alias("id"), _id(0, "s_nationkey").alias("src"), _id(1, "s_suppkey").alias("dst"))
    nodes = [node("Nation", nation, 0, "n", "n_nationkey"), node("Supplier", supplier, 1, "s", "s_suppkey"), node("Customer", customer, 2, "c", "c_custkey")]
    edges = [EdgeTable("SOLD", sold, "Supplier", "Customer"), EdgeTable("LIVES_IN", lives, "Customer", "Nation"), EdgeTable("HOSTS", hosts, "Nation", "Supplier")]
    return Graph.from_tables(spark, nodes, edges)
