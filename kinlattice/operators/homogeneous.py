"""A sample's typed instances and edges as one graph of numbered nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shape import cut, with_position

#: Edges at one end from which that end is split, and rows that may be broadcast (two numbers and a name each).
HOT_END, FEW_ROWS = 100_000, 100_000


def numbered_nodes(nodes: DataFrame, root_type: str, keep: tuple[str, ...] = ("root_id", "hop", "row_id")) -> DataFrame:
    """node, type_code, node_type, inst_id and the columns to keep: types are laid end to end, the root's first, instances of a type in the order of their names.

    Numbers are dense and given over ranges of the order. An instance that is in nodes twice is an error of the caller.
    """
    kept = nodes.select("node_type", "inst_id", *keep)
    numbered = with_position(kept, F.col("node_type") != root_type, "node_type", "inst_id", position="node")
    types = numbered.select("node_type").distinct()
    codes = types.select("node_type", (F.row_number().over(Window.orderBy(F.col("node_type") != root_type, "node_type")) - 1).alias("type_code"))  # one row per type
    return numbered.join(F.broadcast(cut(codes)), "node_type").select("node", "type_code", "node_type", "inst_id", *keep)


def relation_codes(edges: DataFrame) -> DataFrame:
    """edge_type, relation: a dense code from 0 in the order of names. One row per edge type."""
    types = edges.select("edge_type").distinct()
    return types.select("edge_type", (F.row_number().over(Window.orderBy("edge_type")) - 1).alias("relation"))


def _numbered_end(edges: DataFrame, counted: DataFrame, end: str, other: Column, numbers: DataFrame, name: str, hot_end: int) -> DataFrame:
    """edges with the number of the instance at one end, whose edges are counted in another frame. An end with very many edges is dealt out over several rows of its number.

    Ends are counted by a hash of 8 bytes: what shares it with a hot end is dealt out likewise, on both sides.
    """
    hashed = F.xxhash64(end)
    hot = cut(counted.groupBy(hashed.alias("__end")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= hot_end).select("__end", F.ceil(F.col("k") / hot_end).alias("parts")))
    n_hot = hot.count()
    ends = numbers.select(F.col("inst_id").alias(end), F.col("node").alias(name))
    if not n_hot:
        return edges.join(ends, end, "left")
    beside = F.broadcast(hot) if n_hot <= FEW_ROWS else hot
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    salted = edges.join(beside, hashed == F.col("__end"), "left").withColumn("__part", F.pmod(F.xxhash64(other), parts)).drop("parts", "__end")
    each = ends.join(beside, hashed == F.col("__end"), "left").select(end, name, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__part"))
    return salted.join(each, [end, "__part"], "left").drop("__part")


def numbered_edges(edges: DataFrame, nodes: DataFrame, hot_end: int = HOT_END) -> DataFrame:
    """src, dst, relation, edge_type of edges (src_inst, dst_inst, edge_type) between nodes that numbered_nodes made.

    An edge whose end isn't a node is an error: a graph with numbers for some ends only would be wrong silently. Edges are made twice: for the few relations,
    and with codes in place of names; what made them is released before ends are looked up.
    """
    numbers = nodes.select("inst_id", "node")
    codes = cut(relation_codes(edges))
    coded = cut(edges.join(F.broadcast(codes), "edge_type").select("src_inst", "dst_inst", "relation"))
    known = lambda number, end: F.coalesce(number, F.raise_error(F.concat(F.lit("no such instance: "), F.coalesce(end, F.lit("null")))).cast("long"))
    one = _numbered_end(coded, coded, "src_inst", F.col("dst_inst"), numbers, "src", hot_end)
    one = one.select(known(F.col("src"), F.col("src_inst")).alias("src"), "dst_inst", "relation")
    both = _numbered_end(one, coded, "dst_inst", F.col("src"), numbers, "dst", hot_end).join(F.broadcast(codes), "relation")
    return both.select("src", known(F.col("dst"), F.col("dst_inst")).alias("dst"), "relation", "edge_type")


def unify(nodes: DataFrame, edges: DataFrame, root_type: str, keep: tuple[str, ...] = ("root_id", "hop", "row_id")) -> tuple[DataFrame, DataFrame]:
    """Numbered nodes and edges of a sample, or of a main sample and its examples' samples with their links; keep: columns of nodes that are wanted beside numbers and names."""
    numbered = numbered_nodes(nodes, root_type, keep)
    return numbered, numbered_edges(edges, numbered)
