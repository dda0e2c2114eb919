"""Bounded walks over the edges of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.storage import settled

#: Most hops where the pattern gives a least number and no most.
DEFAULT_MOST = 10


def walk_pairs(edges: DataFrame, starts: DataFrame, first_ends: DataFrame, least: int, most: int) -> DataFrame:
    """Distinct (s, t) such that a walk of least..most edges leads from s to t.

    edges has s and t; starts and first_ends have id: the first hop leads from one of
    the former to one of the latter.  Nodes and edges may repeat.  What is asked for is
    distinct pairs, so each level keeps distinct pairs only, and a level has at most
    |V|**2 rows whatever the number of walks.  With least <= 1 a pair seen before leads
    nowhere new and isn't extended again; with more, the pairs at each exact depth
    count.  Levels are written to the shared folder, which cuts the lineage.
    """
    most = DEFAULT_MOST if most == 0 else most
    edges = edges.select("s", "t").distinct()
    level = edges.join(starts.select(F.col("id").alias("s")), "s", "left_semi").join(first_ends.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t")
    if most < max(1, least):
        return level.limit(0)
    if most == 1:
        return level
    level = settled(level, "walks")
    found = [level] if least <= 1 else []
    hop = edges.withColumnsRenamed({"s": "via", "t": "end"})
    seen = level
    for depth in range(2, most + 1):
        following = level.join(hop, F.col("t") == F.col("via")).select("s", F.col("end").alias("t")).distinct()
        if least <= 1:
            following = following.join(seen, ["s", "t"], "left_anti")
        level = settled(following, "walks")
        if level.isEmpty():
            break
        if least <= 1:
            seen = seen.union(level)
        if depth >= least:
            found.append(level)
    if not found:
        return level.limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out if least <= 1 else out.distinct()


def both_ways(edges: DataFrame, s: str = "source_entity_id", t: str = "target_entity_id") -> DataFrame:
    """The edges and their reverses, a loop once."""
    back = edges.filter(F.col(s) != F.col(t)).withColumnsRenamed({s: "_s", t: "_t"}).withColumnsRenamed({"_s": t, "_t": s})
    return edges.unionByName(back)


