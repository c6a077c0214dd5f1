"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import attach_groups, forget, save


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """edges (a > b). Each node links its neighbours (large star: the greater; small star: the smaller and itself) to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = save(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    joined = attach_groups(both, least, "u", "n", 2 * total)
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    else:
        own = least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(own)
    out = save(out.where("a <> b").distinct(), "edges")
    forget(least)
    return out


def _unfinished(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars: those linked to several lesser ones, or to a lesser and a greater one."""
    one = F.lit(1)
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), one.alias("lower"), F.lit(0).alias("upper")), F.struct(F.col("b").alias("u"), F.lit(0).alias("lower"), one.alias("upper")))).alias("end"))
    nodes = ends.groupBy("end.u").agg(F.sum("end.lower").alias("lower"), F.max("end.upper").alias("upper"))
    n, open_ = nodes.agg(F.sum("lower"), F.count_if(F.col("lower") + F.col("upper") > 1)).first()
    return n or 0, open_


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least member) for every node with a link to another; links are pairs of ids, in any order."""
    edges = save(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while True:
        n, left = _unfinished(edges)
        if not left:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        halfway = _star(edges, n, large=True)
        forget(edges)
        edges = _star(halfway, n, large=False)
        forget(halfway)
