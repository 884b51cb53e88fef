"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orrery import queries as core
from orrery.graph import EdgeTable, Graph, NodeTable
from orrery.operators import community, rank
from orrery.session import Session
from orrery.storage import cut

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RING = int(os.environ.get("BENCH_RING", "1000000"))
TABLE_QUERIES = ["flagship", "label_scan", "two_hop", "three_hop", "comma_patterns", "optional_match", "not_exists", "pattern_comprehension", "with_having", "varlen_1_3", "sum_avg_min_max", "pagerank", "label_propagation", "wcc", "triangle_count"]


def ring(spark: SparkSession, n: int, k: int = 5) -> Graph:
    """n nodes, node x with edges to the next k."""
    nodes = spark.range(n).select("id", F.col("id").alias("id_"))
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    edges = edges.select((F.col("src") * k + F.col("j")).alias("id"), "src", ((F.col("src") + F.col("j")) % n).alias("dst"))
    return Graph.from_tables(spark, [NodeTable(frozenset(["Node"]), cut(nodes, "ring"))], [EdgeTable("EDGE", cut(edges, "ring"), "Node", "Node")])


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        try:
            run()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as e:
            print(f"{name}: {e}", file=sys.stderr)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    core.QUERIES["flagship"](spark, SF_DIR).collect()  # warm-up
    for q in TABLE_QUERIES:
        timed(q, lambda q=q: noop(core.QUERIES[q](spark, SF_DIR)))
    held: list[Graph] = []
    timed("ring_load", lambda: held.append(ring(spark, RING)))
    if held:
        s = Session(spark, held[0])
        timed("ring_match_all", lambda: s.cypher("MATCH (n:Node) RETURN count(n) AS n").rows())
        timed("ring_filter", lambda: s.cypher(f"MATCH (n:Node) WHERE n.id > {RING // 2} RETURN count(n) AS n").rows())
        timed("ring_aggregates", lambda: s.cypher("MATCH (n:Node) RETURN count(n) AS n, min(n.id) AS lo, max(n.id) AS hi").rows())
        timed("ring_lookup", lambda: s.cypher(f"MATCH (n:Node {{id: {RING // 2}}}) RETURN n").rows())
        for hops in (1, 2, 3, 6):
            timed(f"ring_hop{hops}", lambda h=hops: s.cypher(f"MATCH (a:Node {{id: 1}}){'-[:EDGE]->()' * (h - 1)}-[:EDGE]->(x) RETURN count(x) AS n").rows())
        timed("ring_pagerank_3", lambda: noop(rank.page_rank(held[0], 0.85, 3)))
        timed("ring_labelprop_3", lambda: noop(community.label_propagation(held[0], 3)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
