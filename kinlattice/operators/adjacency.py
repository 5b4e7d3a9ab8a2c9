"""Edges with the position of each neighbour in its source's order of time, so that neighbours are drawn by position.

The neighbours older than a cutoff are the first so many of a source. How many they are is found in two steps: the times of LEAF neighbours make a leaf, and
the first times of all leaves but a source's first one are marks. A cutoff's leaf is the number of its source's marks below it, found by sorting cutoffs among
marks; the rest is counted in that leaf. Neither step touches more than one leaf a cutoff, however many neighbours a source has.

All three tables can be stored once, bucketed by what they are looked up with; then only cutoffs and draws move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shape import cut, with_position

#: Neighbours whose times are in one row.
LEAF = 256
_SOURCE = ("edge_type", "src")


@dataclass(frozen=True)
class Adjacency:
    """edges: edge_type, src, pos, dst, ts; leaves: edge_type, src, leaf, n, times (without nulls); marks: edge_type, src, ts, None without any; types: the edge types."""

    edges: DataFrame
    leaves: DataFrame
    marks: DataFrame | None
    types: tuple[str, ...]


def positioned(edges: DataFrame) -> DataFrame:
    """edge_type, src, pos, dst, ts: the position from 0 of each edge among its source's, by time (edges without one first), then by dst.

    Numbered over ranges of the whole table, so a source isn't one task. Edges without a source are left out.
    """
    numbered = with_position(edges.where("src is not null").select(*_SOURCE, "dst", "ts"), *_SOURCE, "ts", "dst", position="__at")
    first = numbered.groupBy(*_SOURCE).agg(F.min("__at").alias("__first"))
    return cut(numbered.join(first, list(_SOURCE)).select(*_SOURCE, (F.col("__at") - F.col("__first")).alias("pos"), "dst", "ts"))


def adjacency_index(edges: DataFrame) -> Adjacency:
    """The index of flat edges (edge_type, src, dst, ts); edge types are few, and are listed on the driver."""
    table = positioned(edges)
    leaf = F.floor(F.col("pos") / LEAF).alias("leaf")
    leaves = cut(table.groupBy(*_SOURCE, leaf).agg(F.count(F.lit(1)).alias("n"), F.collect_list("ts").alias("times")))
    marks = table.where((F.col("pos") % LEAF == 0) & (F.col("pos") > 0)).select(*_SOURCE, "ts")
    types = tuple(r[0] for r in table.select("edge_type").distinct().orderBy("edge_type").collect())
    return Adjacency(table, leaves, None if marks.isEmpty() else marks, types)


def save_index(index: Adjacency, name: str, buckets: int = 64, path: str | None = None) -> None:
    """The index as three tables called name_edges, name_leaves and name_marks, the first two bucketed by what they are looked up with; path makes them external."""

    def put(df: DataFrame, part: str, keys: tuple[str, ...] | None) -> None:
        out = df.write.mode("overwrite").format("parquet")
        out = out.bucketBy(buckets, *keys).sortBy(*keys) if keys else out
        (out.option("path", f"{path}/{part}") if path else out).saveAsTable(f"{name}_{part}")

    put(index.edges, "edges", (*_SOURCE, "pos"))
    put(index.leaves, "leaves", (*_SOURCE, "leaf"))
    put(index.marks if index.marks is not None else index.edges.select(*_SOURCE, "ts").limit(0), "marks", None)


def load_index(spark: SparkSession, name: str) -> Adjacency:
    """A stored index, without reading it; the types come from the leaves' metadata-sized column."""
    edges, leaves, marks = (spark.read.table(f"{name}_{part}") for part in ("edges", "leaves", "marks"))
    types = tuple(r[0] for r in leaves.select("edge_type").distinct().orderBy("edge_type").collect())
    return Adjacency(edges, leaves, None if marks.isEmpty() else marks, types)


def eligible(index: Adjacency, frontier: DataFrame) -> DataFrame:
    """frontier (row_id, cutoff, …) with edge_type and n_older: how many neighbours of each edge type are older than the cutoff; none is no row.

    Edges without a time are older than any cutoff; without a cutoff all neighbours count.
    """
    rows = frontier.withColumn("edge_type", F.explode(F.array(*[F.lit(t) for t in index.types]))) if index.types else frontier.withColumn("edge_type", F.lit(None).cast("string"))
    if index.marks is None:
        placed = rows.withColumn("leaf", F.lit(0).cast("long"))
    else:
        # cutoffs among marks, in order: a cutoff comes before a mark of the same time, and none after all marks
        whole = F.struct(*frontier.columns)
        asked = rows.select("edge_type", F.col("row_id").alias("src"), F.col("cutoff").isNull().alias("after"), F.col("cutoff").alias("at"), F.lit(0).alias("mark"), whole.alias("row"))
        marks = index.marks.select(*_SOURCE, F.lit(False).alias("after"), F.col("ts").alias("at"), F.lit(1).alias("mark")).withColumn("row", F.lit(None).cast(asked.schema["row"].dataType))
        run = with_position(asked.unionByName(marks), *_SOURCE, "after", "at", "mark", before={"below": "mark"}).drop("pos")
        base = run.groupBy(*_SOURCE).agg(F.min("below").alias("base"))
        placed = run.where("mark = 0").join(base, list(_SOURCE)).select("row.*", "edge_type", (F.col("below") - F.col("base")).alias("leaf"))
    met = placed.join(index.leaves.select(F.col("edge_type"), F.col("src").alias("row_id"), "leaf", "n", "times"), ["edge_type", "row_id", "leaf"])
    dated = F.when(F.col("cutoff").isNull(), F.size("times")).otherwise(F.size(F.filter("times", lambda t: t < F.col("cutoff"))))
    n = F.col("leaf") * LEAF + F.col("n") - F.size("times") + dated
    return met.select(*frontier.columns, "edge_type", n.cast("long").alias("n_older")).where("n_older > 0")
