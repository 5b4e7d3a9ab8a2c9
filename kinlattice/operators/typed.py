"""A sampled subgraph as the model's input: the columns of every node type as vectors, names of columns and relations as vectors, one graph of numbers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shape import cut
from . import encoders, homogeneous, sampling

#: Rows of a text dictionary that may be broadcast, if their vectors have some hundred numbers: 100 MB.
TEXT_ROWS = 100_000


@dataclass(frozen=True)
class FeatureTable:
    """Of a node type: its rows, their key, the columns that are features, and for text columns a dictionary (value, emb)."""

    table: DataFrame
    key: str
    columns: tuple[str, ...]
    texts: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class ModelInput:
    """nodes: node, node_type, type_code, inst_id, root_id, hop, row_id, feats, mask; edges: center, rel, nbr, relation; names: type -> a vector per column; relations: rel, emb."""

    nodes: DataFrame
    edges: DataFrame
    names: dict[str, list[list[float]]]
    relations: DataFrame


def column_vectors(rows: DataFrame, columns: list[str], width: int, weights=None, texts: dict[str, DataFrame] | None = None, model=None) -> DataFrame:
    """rows with feats (a vector of that width for each column, in order) and mask (true where the value is null or NaN; its vector is zeros).

    What encodes a column follows from its type: whole numbers and booleans go through the cosine bank, floats through the frozen encoder, arrays are normalised,
    text is looked up in its dictionary, or encoded by model without one. Each distinct value is encoded once a batch, nothing is shuffled, and a dictionary
    is broadcast if it is small enough; a text that isn't in its dictionary is masked.
    """
    texts, found = texts or {}, rows
    vectors: list[Column] = []
    for i, c in enumerate(columns):
        if c in texts:
            side = texts[c].select(F.col("value").alias(f"__value{i}"), F.col("emb").cast("array<double>").alias(f"__emb{i}"))
            found = found.join(F.broadcast(side) if side.count() <= TEXT_ROWS else side, F.col(c) == F.col(f"__value{i}"), "left").drop(f"__value{i}")
        else:
            found = found.withColumn(f"__emb{i}", encoders.encode_column(rows, c, width, weights, model))
        # a vector of another width is an error, not a shorter row
        right = F.when(F.size(f"__emb{i}") == width, F.col(f"__emb{i}")).otherwise(F.raise_error(F.lit(f"{c}: a vector isn't of width {width}")).cast("array<double>"))
        vectors.append(F.when(F.col(f"__emb{i}").isNotNull(), right))
    zeros = F.array_repeat(F.lit(0.0), width)
    feats, mask = F.array(*[F.coalesce(v, zeros) for v in vectors]), F.array(*[F.col(f"__emb{i}").isNull() for i in range(len(columns))])
    return found.withColumns({"feats": feats, "mask": mask}).drop(*[f"__emb{i}" for i in range(len(columns))])


def typed_nodes(nodes: DataFrame, tables: dict[str, FeatureTable], width: int, weights=None, model=None, hidden: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """nodes (node_type, row_id, hop, …) with feats and mask of their rows, over all node types; columns in hidden[type] are masked in roots (hop 0).

    The raw columns of each type are joined to its instances, so what moves are values and not vectors. A type has as many vectors as columns. A node whose row is missing is an error.
    """
    missing = [r[0] for r in nodes.select("node_type").distinct().collect() if r[0] not in tables]  # types are few
    if missing:
        raise ValueError(f"no feature table for {', '.join(map(str, missing))}")
    parts = []
    for t, own in tables.items():
        raw = own.table.select(F.col(own.key).cast("long").alias("row_id"), F.lit(True).alias("__there"), *[F.col(c).alias(f"__raw_{c}") for c in own.columns])
        met = nodes.where(F.col("node_type") == t).join(raw, "row_id", "left")
        known = F.when(F.col("__there"), F.col("row_id")).otherwise(F.raise_error(F.concat(F.lit(f"{t} has no row "), F.col("row_id").cast("string"))).cast("long"))
        stacked = column_vectors(met.withColumn("row_id", known).drop("__there"), [f"__raw_{c}" for c in own.columns], width, weights, {f"__raw_{c}": d for c, d in own.texts.items()}, model)
        secret = F.array(*[F.lit(c in (hidden or {}).get(t, ())) for c in own.columns])
        stacked = stacked.withColumn("mask", F.zip_with("mask", secret, lambda m, s: m | s & (F.col("hop") == 0)))
        parts.append(stacked.select(*nodes.columns, "feats", "mask"))
    return reduce(DataFrame.unionByName, parts)


def model_input(nodes: DataFrame, edges: DataFrame, root_type: str, tables: dict[str, FeatureTable], width: int, weights: list[tuple[np.ndarray, np.ndarray]] | None = None, model=encoders.name_vector, hidden: dict[str, tuple[str, ...]] | None = None, vectors: dict[str, list[float]] | None = None) -> ModelInput:
    """All of a sample (instances of ``sampling.sample`` and edges of ``sampling.sub_edges``) in the form that ``model.forward`` takes.

    vectors: vectors of column names (type___column) and edge types that are known; others are encoded by model, a stand-in by default.
    """
    numbered, coded = homogeneous.unify(nodes, edges, root_type)
    name = lambda n: list((vectors or {}).get(n) or model(n, width))
    relations = coded.select("edge_type").distinct()
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([(r[0], name(r[0])) for r in relations.collect()], "rel string, emb array<double>")  # one row per edge type
    return ModelInput(
        typed_nodes(numbered, tables, width, weights, model, hidden),
        coded.select(F.col("src").alias("center"), F.col("edge_type").alias("rel"), F.col("dst").alias("nbr"), "relation"),
        {t: [name(f"{t}___{c}") for c in own.columns] for t, own in tables.items()},
        kinds,
    )


def with_vectors(rows: DataFrame, names: DataFrame, column: str, alias: str = "emb", required: bool = True) -> DataFrame:
    """rows with the vector of the name in a column: of a feature, an edge type or a task. names: name, emb, one row a name, broadcast if they are few.

    A name without a vector is an error, or has null with required=False.
    """
    side = names.select(F.col("name").alias("__name"), F.col("emb").alias(alias))
    met = rows.join(F.broadcast(side) if side.count() <= TEXT_ROWS else side, F.col(column) == F.col("__name"), "left")
    if required:
        met = met.withColumn(alias, F.coalesce(F.col(alias), F.raise_error(F.concat(F.lit("no vector for "), F.coalesce(F.col(column), F.lit("null")))).cast(met.schema[alias].dataType)))
    return met.drop("__name")


def sampled_input(roots: DataFrame, root_type: str, graph: dict, spec, tables: dict[str, FeatureTable], width: int, **more) -> ModelInput:
    """Roots to model input in one call: sample over graph (as ``sampling.sample`` takes it), number, and stack; more goes to model_input."""
    nodes = cut(sampling.sample(roots, root_type, graph, spec))
    return model_input(nodes, sampling.sub_edges(nodes), root_type, tables, width, **more)
