"""Time-bounded, fanout-limited neighbour sampling.

The sample is a tree: a row reached on two paths, or over two parallel edges, is there twice. Every hop keeps the root's cutoff. An instance is
named by the md5 of its path, so draws differ by path and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_number, hash_text, let
from ..plans.shape import cut
from ..plans.specs import SampleSpec
from .adjacency import Adjacency, adjacency_index, eligible

NODE_COLUMNS = ["root_id", "inst_id", "parent_inst", "hop", "node_type", "row_id", "edge_type", "cutoff"]


def seeds(df: DataFrame, node_type: str, row_id: str, cutoff: str | None = None) -> DataFrame:
    """Root instances. A null cutoff means no time filter."""
    when = F.col(cutoff).cast("timestamp_ntz") if cutoff else F.lit(None).cast("timestamp_ntz")
    key = F.col(row_id).cast("long")
    return df.select(key.alias("root_id"), hash_text("root", F.lit(node_type), key).alias("inst_id"), F.lit(None).cast("string").alias("parent_inst"), F.lit(0).alias("hop"), F.lit(node_type).alias("node_type"), key.alias("row_id"), F.lit(None).cast("string").alias("edge_type"), when.alias("cutoff"))


def drawn_positions(n: Column, fanout: int, seed: object, *keys: Column | str) -> Column:
    """An array of min(fanout, n) distinct positions below n, every set of them as likely: Floyd's method on a seeded hash.

    For j from n - fanout to n - 1 a position up to j is drawn, and j itself is taken where that one is taken already.
    """
    taken = F.array().cast("array<bigint>")

    def take(found: Column, j: Column) -> Column:
        return let(hash_number(seed, *keys, j) % (j + 1), lambda at: F.array_append(found, F.when(F.array_contains(found, at), j).otherwise(at)))

    return F.aggregate(F.sequence(F.greatest(n - fanout, F.lit(0).cast("long")), n - 1), taken, take)


def expand(frontier: DataFrame, index: Adjacency, to_type: str, spec: SampleSpec, hop: int) -> DataFrame:
    """The neighbours of a frontier over the edges of an index.

    Strictly older than the cutoff; edges without a time pass. At most fanout per parent and edge type, without replacement: positions are drawn among
    the neighbours that are old enough and looked up by equality, so a parent costs fanout rows however many neighbours it has. An instance is named
    by its parent and its position, so a row that parallel edges lead to is an instance for each of them.
    """
    if spec.fanout is None:
        older = (F.col("row_id") == F.col("src")) & (F.col("cutoff").isNull() | F.col("ts").isNull() | (F.col("ts") < F.col("cutoff")))
        met = frontier.drop("edge_type").join(index.edges, older)
    else:
        drawn = drawn_positions(F.col("n_older"), spec.fanout, spec.seed, F.lit(hop), "inst_id", "edge_type")
        draws = eligible(index, frontier.select("root_id", "inst_id", "row_id", "cutoff")).select("root_id", "inst_id", "cutoff", "edge_type", F.col("row_id").alias("src"), F.explode(drawn).alias("pos"))
        met = draws.join(index.edges.select("edge_type", "src", "pos", "dst"), ["edge_type", "src", "pos"])
    return met.select("root_id", hash_text("path", "inst_id", "edge_type", "pos").alias("child"), F.col("inst_id").alias("parent_inst"), F.lit(hop).alias("hop"), F.lit(to_type).alias("node_type"), F.col("dst").alias("row_id"), "edge_type", "cutoff").withColumnRenamed("child", "inst_id").select(*NODE_COLUMNS)


def sample(roots: DataFrame, root_type: str, edges: dict[tuple[str, str, str], DataFrame | Adjacency], spec: SampleSpec, walls: frozenset[str] = frozenset()) -> DataFrame:
    """All instances of the sample: roots and spec.hops hops over edges[(from_type, edge_type, to_type)], flat or as an index that was made or stored before.

    walls: node types that aren't walked from (targets). From three hops on, each hop is cut so that plans stay small.
    """
    frontiers = {root_type: roots.select(*NODE_COLUMNS)}
    found = [frontiers[root_type]]
    indexes: dict[tuple[str, str, str], Adjacency] = {}
    for hop in range(1, spec.hops + 1):
        reached: dict[str, DataFrame] = {}
        for key, table in edges.items():
            here, _, there = key
            if here in frontiers and here not in walls:
                if key not in indexes:
                    indexes[key] = table if isinstance(table, Adjacency) else adjacency_index(table)
                more = expand(frontiers[here], indexes[key], there, spec, hop)
                reached[there] = reached[there].unionByName(more) if there in reached else more
        if spec.hops >= 3:
            reached = {t: cut(df) for t, df in reached.items()}
        frontiers = reached
        found += list(reached.values())
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def sub_edges(nodes: DataFrame) -> DataFrame:
    """root_id, src_inst, dst_inst, edge_type of a sample."""
    return nodes.where("parent_inst is not null").select("root_id", F.col("parent_inst").alias("src_inst"), F.col("inst_id").alias("dst_inst"), "edge_type")


def with_features(nodes: DataFrame, table: DataFrame, node_type: str, key: str, columns: list[str]) -> DataFrame:
    """Instances of a type with columns of their rows; called last, when the sample is small."""
    side = table.select(F.col(key).cast("long").alias("row_id"), *columns)
    return nodes.where(F.col("node_type") == node_type).join(side, "row_id")


def type_offsets(nodes: DataFrame, root_type: str) -> DataFrame:
    """node_type, n, first: where each type starts if types are laid end to end, the root's first. One row per type."""
    n = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy((F.col("node_type") != root_type), "node_type").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("node_type", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("first"))
