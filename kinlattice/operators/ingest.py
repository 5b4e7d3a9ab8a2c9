"""From tables and catalogues to node types, typed edges and adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import HEAD_OF, TAIL_OF, edge_part
from ..plans.shape import with_position

#: The time of a static row.
STATIC = -(2**63)
TEXT_PREFIX = "text_"


def qualified(node_type: Column | str, column: Column | str) -> Column:
    return F.concat_ws("___", node_type, column)


def qualify_columns(df: DataFrame, node_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed to type___column, but for those in keep."""
    return df.withColumnsRenamed({c: f"{node_type}___{c}" for c in df.columns if c not in keep})


def feature_catalogue(tables: dict[str, DataFrame], targets: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """node_type, column, name, dtype, is_target of every column of the tables; metadata only."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, f"{t}___{c}", k, (t, c) in targets) for t, df in tables.items() for c, k in df.dtypes]
    if len({r[2] for r in rows}) < len(rows):
        raise ValueError("a qualified feature name is used twice")
    return spark.createDataFrame(rows, "node_type string, column string, name string, dtype string, is_target boolean")


def supersede(features: DataFrame, prefix: str = TEXT_PREFIX) -> DataFrame:
    """Features without those for which the same type has a text version named prefix + column."""
    text = features.where(F.col("column").startswith(prefix)).select(F.col("node_type").alias("__t"), F.col("column").substr(F.lit(len(prefix) + 1), F.length("column")).alias("__c"))
    return features.join(text, (F.col("node_type") == F.col("__t")) & (F.col("column") == F.col("__c")), "left_anti")


def target_types(features: DataFrame) -> DataFrame:
    """node_type, n_features, is_target; a target type with more than one feature is an error."""
    t = features.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_features"), F.bool_or("is_target").alias("is_target"))
    wrong = F.col("is_target") & (F.col("n_features") != 1)
    return t.withColumn("is_target", F.when(wrong, F.raise_error(F.concat(F.lit("a target type needs exactly one feature: "), F.col("node_type")))).otherwise(F.col("is_target")))


def static_times(rows: DataFrame, by: str = "node_type", ts: str = "ts") -> DataFrame:
    """ts with the static sentinel for all rows of types whose times are all 0."""
    kinds = rows.groupBy(F.col(by).alias("__by")).agg(F.bool_and(F.col(ts) == 0).alias("__static"))
    joined = rows.join(kinds, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.withColumn(ts, F.when(F.col("__static"), F.lit(STATIC)).otherwise(F.col(ts))).select(*rows.columns)


def parse_edges(catalogue: DataFrame, edge: str = "edge_type") -> DataFrame:
    """head_type, rel, tail_type beside each head:name:tail."""
    c = F.col(edge)
    return catalogue.select("*", edge_part(c, 0).alias("head_type"), edge_part(c, 1).alias("rel"), edge_part(c, 2).alias("tail_type"))


def filter_edges(edges: DataFrame) -> DataFrame:
    """Without self loops and stored reverses."""
    return edges.where(~F.col("rel").endswith("-self_loop") & ~F.col("rel").startswith("reverse_"))


def unique_edge_types(edges: DataFrame) -> DataFrame:
    """The catalogue; an edge type that comes twice is an error."""
    n = Window.partitionBy("edge_type")
    twice = F.count(F.lit(1)).over(n) > 1
    return edges.withColumn("edge_type", F.when(twice, F.raise_error(F.concat(F.lit("edge type twice: "), F.col("edge_type")))).otherwise(F.col("edge_type")))


def edge_directions(edges: DataFrame) -> DataFrame:
    """directed, direction, from_type, to_type: both directions of each type, one of a type that links a type to itself."""
    out = edges.select(F.concat(F.lit(HEAD_OF), "edge_type").alias("directed"), F.lit("out").alias("direction"), F.col("head_type").alias("from_type"), F.col("tail_type").alias("to_type"))
    back = edges.where("head_type <> tail_type").select(F.concat(F.lit(TAIL_OF), "edge_type").alias("directed"), F.lit("in").alias("direction"), F.col("tail_type").alias("from_type"), F.col("head_type").alias("to_type"))
    return out.unionByName(back)


def edges_of(df: DataFrame, edge_type: str, src: str, dst: str, ts: str | None = None) -> DataFrame:
    """edge_type, src, dst, ts from a table that holds both keys; ts is the time of the row at dst."""
    when = F.col(ts).cast("timestamp_ntz") if ts else F.lit(None).cast("timestamp_ntz")
    return df.select(F.lit(edge_type).alias("edge_type"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), when.alias("ts"))


def reversed_edges(edges: DataFrame, edge_type: str) -> DataFrame:
    """The other direction, without times: add those of the new far end with denormalize_times."""
    return edges.select(F.lit(edge_type).alias("edge_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))


def denormalize_times(edges: DataFrame, tails: DataFrame, row_id: str, ts: str, dangling: str = "error") -> DataFrame:
    """Edges with the time of the row at dst. An edge whose row is missing is an error, or is kept without a time with dangling="keep"."""
    if dangling not in ("error", "keep"):
        raise ValueError(f"dangling {dangling}")
    times = tails.select(F.col(row_id).cast("long").alias("dst"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.lit(True).alias("__there"))
    met = edges.drop("ts").join(times, "dst", "left")
    if dangling == "error":
        missing = F.raise_error(F.concat(F.lit("an edge leads to no row: "), F.coalesce(F.col("dst").cast("string"), F.lit("null")))).cast("long")
        met = met.withColumn("dst", F.when(F.col("__there"), F.col("dst")).otherwise(missing))
    return met.drop("__there")


def adjacency(nodes: DataFrame, edges: DataFrame, row_id: str) -> DataFrame:
    """src, degree, neighbours (sorted) for every node, with an empty list where there are none.

    The list is the result's unit; keep edges flat (src, dst) wherever a list isn't asked for.
    """
    ids = nodes.select(F.col(row_id).cast("long").alias("src"))
    return ids.join(edges.select("src", "dst"), "src", "left").groupBy("src").agg(F.count("dst").alias("degree"), F.sort_array(F.collect_list("dst")).alias("neighbours"))


def out_degree(nodes: DataFrame, edges: DataFrame, row_id: str) -> DataFrame:
    """src, degree. Edges are counted first, so the join carries one row per node."""
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(F.col(row_id).cast("long").alias("src")).join(degrees, "src", "left").select("src", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def pointers(degrees: DataFrame) -> DataFrame:
    """src, degree, pointer: degrees of the nodes before, in order of src."""
    return with_position(degrees, "src", before={"pointer": "degree"}).select("src", "degree", F.col("pointer").cast("long").alias("pointer"))
