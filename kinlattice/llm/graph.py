"""Connected components by rounds of small-label spreading, on nodes named by strings or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, compact, cut


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b): the smallest node of its component.

    Alternates two star operations (Kiveris et al., 2014): large-star hangs a node's larger neighbours on the smallest node of its
    neighbourhood, small-star its smaller ones and itself. Both keep the components and end in stars, in
    rounds that grow with the square of the logarithm of the longest path at most. Each is a group-by with
    partial aggregation and a join, so a hub's links are never gathered in one row.
    """
    edges, seen = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, edges = state, compact(edges, state[0])
        pair = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
        both = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.where("y > x").join(beside(low, 2 * state[0]), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        hung = large.join(beside(large.groupBy("u").agg(F.min("v").alias("m")), 2 * state[0]), "u")
        edges = cut(hung.select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct())
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return edges.select(F.explode(ends).alias("e")).select("e.*").distinct()


def absorb(roots: DataFrame, n: int, links: DataFrame) -> DataFrame:
    """roots (node, root; n rows) with further links(a, b) taken in.

    Links are carried over to the components they touch, so what is solved anew is what the links join, and not the graph so far.
    """
    of = lambda end: beside(roots.select(F.col("node").alias(f"n{end}"), F.col("root").alias(f"r{end}")), n)
    ends = links.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    merged = cut(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    n_merged = merged.count()
    merged = compact(merged, n_merged)
    to = beside(merged.select(F.col("node").alias("old"), F.col("root").alias("new")), n_merged)
    kept = roots.join(to, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return cut(kept.unionByName(merged.join(beside(roots.select("node"), n), "node", "left_anti")))
