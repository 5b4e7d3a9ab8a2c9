"""Readers. Tables are parquet; array and tensor files go through Spark's binary reader, so any store that Spark reads will do."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import HEAD_OF, TAIL_OF, directed_head
from ..operators.ingest import filter_edges, parse_edges
from ..plans.shape import with_position
from ..plans.specs import TaskSpec

#: Rows of an array that a reader passes on at once.
SLICE = 1_000_000
TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """A lazy catalogue of tables."""
    return {n: read_table(spark, folder, n) for n in names}


def read_text(spark: SparkSession, path: str) -> str:
    """A small metadata file, whole."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]).decode()


def read_catalogue(spark: SparkSession, path: str) -> dict:
    """Metadata in YAML (if a parser is installed) or JSON."""
    text = read_text(spark, path)
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def node_catalogue(spark: SparkSession, config: dict) -> DataFrame:
    """node_type, num, n_features, has_time of a catalogue; types and qualified features must be unique, and every type needs a time."""
    nodes = {}
    for n in config["graph"]["nodes"]:
        if n["type"] in nodes:
            raise ValueError(f"node type twice: {n['type']}")
        nodes[n["type"]] = n["num"]
    times, features = set(), set()
    for f in config["graph"].get("feature_data", []) + config.get("feature_data", []):
        if f["name"] == "__timestamp__":
            times.add(f["type"])
            continue
        name = f"{f['type']}___{f['name']}"
        if name in features:
            raise ValueError(f"feature twice: {name}")
        features.add(name)
    if missing := set(nodes) - times:
        raise ValueError(f"no time for {', '.join(sorted(missing))}")
    rows = [(t, n, sum(f.startswith(f"{t}___") for f in features), t in times) for t, n in nodes.items()]
    return spark.createDataFrame(rows, "node_type string, num long, n_features long, has_time boolean")


def read_array(spark: SparkSession, path: str, kind: str = "array<double>") -> DataFrame:
    """pos, value of a .npy column of that kind (long, double, boolean or string), or of a matrix's rows (array<long> or array<double>).

    Whole numbers read as long are exact. Each file is read by one task, in slices.
    """
    of = {"long": "int64", "double": "float64", "boolean": "bool", "string": "str"}[kind.removeprefix("array<").removesuffix(">")]
    listed = kind.startswith("array<")

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if not listed and a.ndim != 1:
                    raise ValueError(f"{a.ndim} dimensions where a column is asked for")
                for at in range(0, len(a), SLICE):
                    part = a[at : at + SLICE].astype(of)
                    yield pd.DataFrame({"pos": np.arange(at, at + len(part)), "value": list(part.reshape(len(part), -1)) if listed else part})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, f"pos long, value {kind}")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of 2 x E array files, in slices of each."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if a.ndim != 2 or len(a) != 2:
                    raise ValueError(f"not a 2 x E array of edges: {a.shape}")
                for at in range(0, a.shape[1], SLICE):
                    yield pa.record_batch([pa.array(x[at : at + SLICE].astype("int64")) for x in a], names=["src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(load, "src long, dst long")


def edge_catalogue(spark: SparkSession, config: dict, folder: str) -> DataFrame:
    """edge_type, path, head_type, rel, tail_type of a catalogue's relations, without self loops and stored reverses.

    Of a type that comes twice the later path counts.
    """
    paths = {e["type"]: f"{folder}/{e['path']}" for e in config["graph"].get("edges", [])}
    return filter_edges(parse_edges(spark.createDataFrame(list(paths.items()), "edge_type string, path string")))


def catalogue_edges(spark: SparkSession, config: dict, folder: str) -> DataFrame:
    """edge_type (directed), src, dst of all relations of a catalogue in both directions, one of a type that links a type to itself."""
    out = spark.createDataFrame([], "edge_type string, src long, dst long")
    # one row per relation
    for e in edge_catalogue(spark, config, folder).collect():
        pairs = read_edges(spark, e["path"])
        out = out.unionByName(pairs.select(F.lit(HEAD_OF + e["edge_type"]).alias("edge_type"), "src", "dst"))
        if e["head_type"] != e["tail_type"]:
            out = out.unionByName(pairs.select(F.lit(TAIL_OF + e["edge_type"]).alias("edge_type"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out


def task_specs(config: dict, features: dict[str, list[str]], prefix: str = "text_") -> list[TaskSpec]:
    """The tasks of a catalogue: roles exchanged for regression, the target column masked, regression on another type left out.

    features: the qualified feature names of each node type. A class task's target column is what its seed type adds to the target type, in
    its text version; a regression's is the last part of its name.
    """
    out = []
    for task in config.get("tasks", []):
        x = task["extra_fields"]
        seed, target = x["seed_type"].split(":")[-1], x["target_type"]
        if x["task_type"] == "regression":
            if seed != target:
                continue
            column = x["name"].split("-")[-1]
        elif not seed.startswith(target):
            raise ValueError(f"{x['name']}: seed type {seed} isn't a column of {target}")
        else:
            column = prefix + seed[len(target) + 1 :]
        every = tuple(features.get(target, ()))
        classes = x["num_classes"] if x["task_type"] == "retrieval" else 1
        out.append(TaskSpec(x["name"], x["task_type"], seed, target, x["evaluation_metric"], every, tuple(f for f in every if f != f"{target}___{column}"), classes=classes))
    return out


def catalogue_tasks(spark: SparkSession, config: dict, folder: str, names: list[str] | None = None) -> DataFrame:
    """task, split, pos, nodeidx, label, cutoff (null where a task has no times) of a catalogue's tasks.

    Pairs of a class task outside of train count only if labelled 1; pos is dense within a split after that.
    """
    out = spark.createDataFrame([], "task string, split string, pos long, nodeidx long, label double, cutoff long")
    for task in config.get("tasks", []):
        x = task["extra_fields"]
        if names is not None and x["name"] not in names:
            continue
        for split, key in (("train", "train_set"), ("valid", "validation_set"), ("test", "test_set")):
            paths = {e["name"]: f"{folder}/{e['path']}" for e in task[key][0]["data"]}
            labels = lambda p=paths: read_array(spark, p["labels"], "double").withColumnRenamed("value", "label")
            if x["task_type"] == "retrieval":
                rows = read_array(spark, paths["node_pairs"], "array<long>").select("pos", F.get("value", F.lit(0)).alias("nodeidx"), F.get("value", F.lit(1)).cast("double").alias("label"))
                if split != "train":
                    rows = rows.join(labels().where("label = 1").select("pos"), "pos", "left_semi")
            else:
                rows = read_array(spark, paths["seed_nodes"], "long").withColumnRenamed("value", "nodeidx").join(labels(), "pos")
            times = read_array(spark, paths["timestamp"], "long").withColumnRenamed("value", "cutoff") if "timestamp" in paths else None
            rows = rows.join(times, "pos") if times is not None else rows.withColumn("cutoff", F.lit(None).cast("long"))
            if x["task_type"] == "retrieval" and split != "train":
                rows = with_position(rows.withColumnRenamed("pos", "__row"), "__row").drop("__row")
            out = out.unionByName(rows.select(F.lit(x["name"]).alias("task"), F.lit(split).alias("split"), "pos", "nodeidx", "label", "cutoff"))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_graph(spark: SparkSession, path: str, node_types: list[str]) -> dict[str, dict[str, DataFrame | None]]:
    """Of a prepared dataset, per node type: features, text dictionary and edges that leave the type, the last two None if not written. All lazy."""
    edges = spark.read.parquet(f"{path}/edge") if exists(spark, f"{path}/edge") else None
    out = {}
    for t in node_types:
        text = f"{path}/node/{t}/text"
        own = edges.where(directed_head(F.col("edge_type")) == t) if edges is not None else None
        out[t] = {"features": spark.read.parquet(f"{path}/node/{t}/feat"), "text": spark.read.parquet(text) if exists(spark, text) else None, "edges": own}
    return out


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The task rows of a prepared dataset; a filter on task or split reads only its folders."""
    return spark.read.parquet(f"{path}/task")


def find_column(df: DataFrame, name: str, required: bool = True):
    """A column by name; null where a column that isn't required is missing."""
    if name in df.columns:
        return F.col(name)
    if required:
        raise ValueError(f"no column {name}")
    return F.lit(None)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """name, emb dictionaries."""
    return spark.read.parquet(path).select("name", "emb")


def read_task_groups(spark: SparkSession, path: str) -> DataFrame:
    """group_name, task of a file that maps groups to lists."""
    rows = [(g, t) for g, tasks in read_catalogue(spark, path).items() for t in tasks]
    return spark.createDataFrame(rows, "group_name string, task string")


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Model weights from an .npz file."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def joined_metadata(nodes: DataFrame, directions: DataFrame) -> DataFrame:
    """node_type, num and the sorted directed edges that leave the type (an empty list where none do)."""
    out = directions.groupBy(F.col("from_type").alias("node_type")).agg(F.sort_array(F.collect_list("directed")).alias("edges"))
    return nodes.join(out, "node_type", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))
