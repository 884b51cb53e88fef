"""Algorithm calls in a query: RETURN pageRank(0.85, 20)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from orrery.graph import Graph
from orrery.operators import centrality, community, components, paths, rank, similarity, traversal
from orrery.plans import ast as A


def _similarity(g: Graph, *args) -> DataFrame:
    if len(args) == 2 and all(isinstance(a, str) for a in args):
        return similarity.pair_similarity(g, *args)
    return similarity.node_similarity(g, *args)


def _personalized(g: Graph, seeds, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    seeds = json.loads(seeds) if isinstance(seeds, str) else seeds
    return rank.page_rank(g, damping, iterations, [str(s) for s in seeds]).select("node_id", "score")


ALGORITHMS = {
    "pagerank": rank.page_rank,
    "toppagerank": rank.top_page_rank,
    "personalizedpagerank": _personalized,
    "labelpropagation": community.label_propagation,
    "communities": community.communities,
    "communityof": community.community_of,
    "communitymembers": community.community_members,
    "communitycount": community.community_count,
    "louvain": community.louvain,
    "degreecentrality": centrality.degree_centrality,
    "betweennesscentrality": centrality.betweenness_centrality,
    "betweenness": centrality.betweenness_centrality,
    "closenesscentrality": centrality.closeness_centrality,
    "closeness": centrality.closeness_centrality,
    "eigenvectorcentrality": rank.eigenvector_centrality,
    "wcc": components.wcc,
    "connectedcomponents": components.wcc,
    "weaklyconnectedcomponents": components.wcc,
    "scc": components.scc,
    "stronglyconnectedcomponents": components.scc,
    "dijkstra": paths.dijkstra,
    "astar": paths.astar,
    "apsp": paths.all_pairs,
    "allpairsshortestpath": paths.all_pairs,
    "bfs": traversal.bfs,
    "breadthfirstsearch": traversal.bfs,
    "dfs": traversal.dfs,
    "depthfirstsearch": traversal.dfs,
    "nodesimilarity": _similarity,
    "knn": similarity.knn,
    "trianglecount": similarity.triangle_count,
    "triangles": similarity.triangle_count,
}


def algorithm_call(c, q: A.Query) -> DataFrame | None:
    """The result of a query that is RETURN with an algorithm as its first item; None for any other query."""
    if len(q.clauses) != 1 or not isinstance(q.clauses[0], A.Project) or not q.clauses[0].items:
        return None
    call = q.clauses[0].items[0].expr
    if not isinstance(call, A.Call) or call.name not in ALGORITHMS:
        return None
    args = []
    for x in call.args:
        if isinstance(x, A.Param):
            args.append(c.param(x.name))
        elif isinstance(x, A.ListLit):
            args.append([y.value for y in x.items])
        elif isinstance(x, A.Lit):
            args.append(x.value)
        else:
            raise ValueError(f"{call.name}() takes literals and parameters")
    c.log.append(f"Algorithm {call.name}")
    return ALGORITHMS[call.name](c.graph(), *args)
