"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and a join back, and is written to the shared folder, so that
lineage stays short and a lost executor costs one step.  Vertices and edges never come to the driver.

Defined cases: an edge with a null end is left out; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written as stored

MAX_STEPS = 100
#: Most rows of merged groups that are broadcast, 16 bytes each; more are joined in so many salted parts of each group.
SENT_ROWS, SALTS = 500_000, 32


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v).  Large: every larger neighbour of u is linked to the least of u and its neighbours; small: every smaller one and u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every end of an edge of (u, v), the least node of its component.  Loops and repeated edges are allowed."""
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(MAX_STEPS):
        now = stored(_star(_star(now, True), False).distinct(), "edges")
        mark = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20)))")).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (u, v) join groups of ``roots``: u and v are roots, or nodes that are in no group yet.  Only the groups are searched, not their nodes."""
    if not links.limit(1).count():
        return roots
    up = stored(components(links), "merged")
    to = up.select(F.col("node").alias("of"), F.col("root").alias("to"))
    if up.count() <= SENT_ROWS:
        moved = roots.join(F.broadcast(to), F.col("root") == F.col("of"), "left")
    else:  # one group may hold most nodes
        parts = to.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
        moved = roots.withColumn("own", own).join(parts, (F.col("root") == F.col("of")) & (F.col("own") == F.col("part")), "left")
    new = up.join(roots.select("node"), "node", "left_anti")
    return stored(moved.select("node", F.coalesce("to", "root").alias("root")).union(new.select("node", "root")), "roots")
