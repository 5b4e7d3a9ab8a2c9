"""Whole prepared datasets: read as one typed graph, and merged as one transaction.

A dataset is a folder: node/<type>/feat and node/<type>/text, edge by edge_type, task by task and split, metadata as JSON (``METADATA``, one row a key), and
vectors of names (``VECTORS``: name, emb). Any part may be missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import directed_head
from ..operators import encoders, merge
from .catalog import exists

#: Metadata tables and their keys, tables of name vectors, and partitioned tables with the column that a merge replaces by.
METADATA = {"metanode": "node_type", "metaadj": "node_type", "metatask": "task"}
VECTORS = ("edge_name", "feature_name", "task_name")
PARTITIONED = {"edge": "edge_type", "task": "task"}
#: Names that an error lists.
TOLD = 10


@dataclass(frozen=True)
class NodeTable:
    """features: the rows as stored; decoded: with vectors for the codes of text columns; edges: those that leave the type; meta: its metadata row. None where a part isn't stored."""

    features: DataFrame
    decoded: DataFrame
    text: DataFrame | None
    edges: DataFrame | None
    meta: DataFrame | None


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    store, at = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def _parquet(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def _json(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.json(path) if exists(spark, path) else None


def decode_texts(features: DataFrame, text: DataFrame | None, prefix: str = "text_") -> DataFrame:
    """features with the vector in place of the code in each column whose name begins with prefix; text: code, emb. A code that isn't there gives null."""
    for c in [c for c in features.columns if text is not None and c.startswith(prefix)]:
        features = encoders.decode(features, text.select("code", F.col("emb").alias("value")), c).drop(c).withColumnRenamed("value", c)
    return features


def load_dataset(spark: SparkSession, path: str) -> dict[str, NodeTable]:
    """Every node type of a prepared dataset: a lazy catalogue, with metadata of nodes and adjacency joined and text codes decoded."""
    edges, meta, adjacent = _parquet(spark, f"{path}/edge"), _json(spark, f"{path}/metanode"), _json(spark, f"{path}/metaadj")
    known = meta.join(adjacent, "node_type", "left") if meta is not None and adjacent is not None else meta
    out = {}
    for t in children(spark, f"{path}/node"):
        features, text = spark.read.parquet(f"{path}/node/{t}/feat"), _parquet(spark, f"{path}/node/{t}/text")
        own = edges.where(directed_head(F.col("edge_type")) == t) if edges is not None else None
        out[t] = NodeTable(features, decode_texts(features, text), text, own, known.where(F.col("node_type") == t) if known is not None else None)
    return out


def merge_report(spark: SparkSession, a: str, b: str, tolerance: float = 1e-5) -> DataFrame:
    """part, key, what, left, right, fatal: all that the datasets at a and b disagree on. Vectors that differ by more than the tolerance are fatal; elsewhere b wins."""
    rows = spark.createDataFrame([], "part string, key string, what string, left string, right string, fatal boolean")
    for part, key in METADATA.items():
        mine, theirs = _json(spark, f"{a}/{part}"), _json(spark, f"{b}/{part}")
        if mine is not None and theirs is not None:
            shared = [c for c in mine.columns if c in theirs.columns and c != key]
            if shared:
                found = merge.conflicts(mine, theirs, [key], shared)
                rows = rows.unionByName(found.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), F.col("column").alias("what"), "left", "right", F.lit(False).alias("fatal")))
    for part in VECTORS:
        mine, theirs = _parquet(spark, f"{a}/{part}"), _parquet(spark, f"{b}/{part}")
        if mine is not None and theirs is not None:
            gaps = merge.vector_gap(mine, theirs).where(F.col("gap") > tolerance)
            rows = rows.unionByName(gaps.select(F.lit(part).alias("part"), F.col("name").alias("key"), F.lit("emb").alias("what"), F.lit(None).cast("string").alias("left"), F.col("gap").cast("string").alias("right"), F.lit(True).alias("fatal")))
    shared = sorted(set(children(spark, f"{a}/node")) & set(children(spark, f"{b}/node")))
    replaced = [("node", t, "replaced", None, None, False) for t in shared]
    return rows.unionByName(spark.createDataFrame(replaced, rows.schema)) if replaced else rows


def _staged(spark: SparkSession, a: str, b: str, stage: str) -> None:
    types = {t: s for s in (a, b) for t in children(spark, f"{s}/node")}
    for t in types:
        for part in ("feat", "text"):
            source = next((p for s in (b, a) if exists(spark, p := f"{s}/node/{t}/{part}")), None)
            if source:
                spark.read.parquet(source).write.parquet(f"{stage}/node/{t}/{part}")
    for part, by in PARTITIONED.items():
        mine, theirs = _parquet(spark, f"{a}/{part}"), _parquet(spark, f"{b}/{part}")
        if theirs is not None and mine is not None:
            newer = [r[0] for r in theirs.select(by).distinct().collect()]  # edge types or tasks: few
            mine = mine.where(~F.col(by).isin(newer) | F.col(by).isNull()).unionByName(theirs, allowMissingColumns=True)
        every = mine if mine is not None else theirs
        if every is not None:
            every.write.partitionBy(*([by, "split"] if part == "task" and "split" in every.columns else [by])).parquet(f"{stage}/{part}")
    for part, key in METADATA.items():
        mine, theirs = _json(spark, f"{a}/{part}"), _json(spark, f"{b}/{part}")
        if mine is not None and theirs is not None:
            for c in set(theirs.columns) - set(mine.columns):
                mine = mine.withColumn(c, F.lit(None).cast(theirs.schema[c].dataType))
            for c in set(mine.columns) - set(theirs.columns):
                theirs = theirs.withColumn(c, F.lit(None).cast(mine.schema[c].dataType))
            mine = merge.merge(mine, theirs, [key])
        every = mine if mine is not None else theirs
        if every is not None:
            every.coalesce(1).write.json(f"{stage}/{part}")
    for part in VECTORS:
        mine, theirs = _parquet(spark, f"{a}/{part}"), _parquet(spark, f"{b}/{part}")
        every = merge.checked_union(mine, theirs) if mine is not None and theirs is not None else mine if mine is not None else theirs
        if every is not None:
            every.write.parquet(f"{stage}/{part}")


def merge_datasets(spark: SparkSession, a: str, b: str, out: str, replace: bool = False, tolerance: float = 1e-5) -> DataFrame:
    """Write the union of two prepared datasets to out, whole or not at all, and return its merge_report.

    Where both have a node type, an edge type, a task or a metadata row, b's is taken whole; vectors of names must agree. All parts are written beside out and
    take its place by renaming when all are there. After a crash a second run starts over, and gives what one run would have given.
    An existing out is an error, or is replaced with replace=True, which also lets out be a or b.
    """
    out = out.rstrip("/")
    stage, old = f"{out}.merging", f"{out}.replaced"
    store, at = _store(spark, out)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if store.exists(path(old)):  # a run ended between the two renames, or before it had cleaned up
        if store.exists(at):
            store.delete(path(old), True)
        else:
            store.rename(path(old), at)
    if store.exists(at) and not replace:
        raise ValueError(f"{out} exists")
    report = merge_report(spark, a, b, tolerance)
    fatal = report.where("fatal").orderBy("part", "key").limit(TOLD + 1).collect()
    if fatal:
        raise ValueError("vectors disagree: " + ", ".join(f"{r['part']} {r['key']}" for r in fatal[:TOLD]) + (" and more" if len(fatal) > TOLD else ""))
    kept = spark.createDataFrame(report.collect(), report.schema)  # metadata: out may be one of its inputs
    store.delete(path(stage), True)
    _staged(spark, a.rstrip("/"), b.rstrip("/"), stage)
    if store.exists(at) and not store.rename(at, path(old)):
        raise OSError(f"{out} can't be renamed")
    if not store.rename(path(stage), at):
        raise OSError(f"{stage} can't be renamed")
    store.delete(path(old), True)
    return kept
