"""Variable-length and shortest-path expansion by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.storage import cut

UNROLLED = 6  # levels planned without an action in between
IDS = "array<bigint>"


def _zero(starts: DataFrame) -> DataFrame:
    start = F.col("start")
    return starts.select("start", start.alias("end"), F.array(start).alias("nodes"), F.array().cast(IDS).alias("rels"))


def _grow(paths: DataFrame, steps: DataFrame, simple: bool) -> DataFrame:
    """Paths one step longer over steps(from, to, rel); simple: no node twice (a first step may be a loop)."""
    more = paths.join(steps, paths["end"] == steps["from"])
    if simple:
        more = more.filter((F.size("rels") == 0) | ~F.array_contains("nodes", F.col("to")))
    return more.select("start", F.col("to").alias("end"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"))


def variable_paths(starts: DataFrame, steps: DataFrame, lo: int, hi: int) -> DataFrame:
    """(start, end, nodes, rels) of all node-simple walks of lo to hi steps from starts(start).

    Short ranges are one lazy plan; longer ones run level by level, each written out, until no path is left.
    """
    level = _zero(starts)
    if hi > UNROLLED:
        steps, level = cut(steps, "steps"), cut(level, "walk")
    out = [level] if lo == 0 else []
    for depth in range(1, hi + 1):
        level = _grow(level, steps, True)
        if hi > UNROLLED:
            level = cut(level, "walk")
            if level.isEmpty():
                break
        if depth >= lo:
            out.append(level)
    if not out:
        return level.filter("false")
    all_levels = out[0]
    for x in out[1:]:
        all_levels = all_levels.union(x)
    return all_levels


def shortest_paths(starts: DataFrame, steps: DataFrame, lo: int, hi: int, single: bool, ends: DataFrame | None = None) -> DataFrame:
    """(start, end, nodes, rels) of the shortest walks of up to hi steps between each start and every reached end.

    Breadth first: a (start, node) pair is settled at the first level that reaches it. single: of equally short
    walks the one with the smallest list of relationship ids; else all of them.
    """
    steps = cut(steps, "steps")
    level = cut(_zero(starts), "walk")
    settled, out = level.select("start", "end"), [level] if lo == 0 else []
    for depth in range(1, hi + 1):
        new = _grow(level, steps, False).join(settled, ["start", "end"], "left_anti").select("start", "end", "nodes", "rels")
        if single:
            best = F.min_by(F.struct("nodes", "rels"), F.col("rels")).alias("p")
            new = new.groupBy("start", "end").agg(best).select("start", "end", "p.nodes", "p.rels")
        level = cut(new, "walk")
        if level.isEmpty():
            break
        settled = settled.union(level.select("start", "end").distinct())
        if depth >= lo:
            out.append(level)
    if not out:
        return level.filter("false")
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every.join(ends, "end", "left_semi").select("start", "end", "nodes", "rels") if ends is not None else every
