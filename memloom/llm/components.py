"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import discard, stored


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Link the neighbours of every node to the smallest node it knows."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = pairs.join(least, "u")
    out = linked.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if "v <= u" in keep:  # the node itself is linked, too
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node either has one edge, to a smaller node, or none but from larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    each = ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return not each.agg(F.count_if(F.expr("n > 1 OR n = 1 AND least = 0"))).first()[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and the smallest ``root`` it is connected with, for every node of ``edges``.

    ``edges`` has columns ``u`` and ``v`` (bigint) in any order, repeats allowed.  A round
    aggregates by node with partial sums and joins back, so a node with a third of all
    edges is split like any skewed join; each round is written to the shared folder, and
    the one before it deleted.  The rounds end when only stars are left, which costs one
    aggregate to see instead of a round that changes nothing.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")

    for left in range(rounds, -1, -1):
        if _settled(edges):
            break
        if not left:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before_it, edges = edges, stored(_star(large, "v <= u"), "edges")
        discard(before_it)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select("v", "v").distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """What :func:`components` of the edges of ``roots`` and of ``links`` is, from ``roots`` of the former; stored.

    Only links between different roots are followed, so what is connected already is not
    connected once more.
    """
    ends = links.select("u", "v")
    for c in "uv":
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    found = components(ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")))
    found = stored(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "merged")
    known = roots.join(found, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    alone = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().join(roots, "node", "left_anti")
    fresh = alone.join(found, alone["node"] == found["root"], "left").select("node", F.coalesce("to", "node").alias("root"))
    out = stored(known.union(fresh), "roots")
    discard(found)
    return out
