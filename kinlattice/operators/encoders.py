"""Columns as vectors: dictionaries, cosine banks, frozen float encoders and name vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans.shape import with_position


def dictionary(columns: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """code, column, value: the distinct values of each column in order, columns one after another.

    Codes are dense. Distinct values are numbered over ranges of (column, value), not in one window.
    """
    parts = [df.select(F.lit(i).alias("part"), F.lit(name).alias("column"), F.col(value).alias("value")).distinct() for i, (name, df) in enumerate(columns.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return with_position(every, "part", "value", position="code").select("code", "column", "value")


def encode(df: DataFrame, codes: DataFrame, column: str, value: str = "value") -> DataFrame:
    """df with the code of its value in that column of the dictionary; null where the value is null or isn't there."""
    side = codes.where(F.col("column") == column).select(F.col("value").alias(value), "code")
    return df.join(side, value, "left")


def decode(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """df with the value of its code, null where it has none; Spark broadcasts the dictionary if it is small."""
    return df.join(codes.select(F.col("code").alias(code), F.col("value")), code, "left")


def encode_column(df: DataFrame, column: str, width: int, weights: list[tuple[np.ndarray, np.ndarray]] | None = None, model=None) -> Column:
    """A column's values as vectors by its type: whole numbers and booleans through the cosine bank, floats and decimals through the frozen encoder of weights, text through
    model(text, width), vectors normalised. Null and NaN give null. A type without an encoder, or without what its encoder needs, is an error."""
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.when(F.col(column).isNotNull(), scalar.cosine_bank(F.col(column).cast("long"), width))
    if kind.startswith("array<"):
        return scalar.l2_normalize(F.col(column))
    if (kind in ("float", "double") or kind.startswith("decimal")) and weights is not None:
        return _each_value(lambda values: encode_floats(values.astype(np.float64), weights))(F.col(column).cast("double"))
    if kind == "string" and model is not None:
        return _each_value(lambda values: [model(v, width) for v in values])(F.col(column))
    raise TypeError(f"{column}: no encoder for {kind}")


def _each_value(encoder):
    """A vectorised function that encodes each distinct value of a batch once; null and NaN stay null."""

    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        vectors = np.empty(len(distinct) + 1, object)
        for i, v in enumerate(encoder(np.asarray(distinct)) if len(distinct) else []):
            vectors[i] = v
        return pd.Series(vectors[codes])  # what has no code takes the last place, which is null

    return F.pandas_udf(run, "array<double>")


def float_weights(width: int, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stand-in weights of a frozen encoder: three linear layers, 1 to root of width, the same, to width."""
    mid = int(width**0.5 + 0.1)
    rng = np.random.default_rng(seed)
    sizes = [(1, mid), (mid, mid), (mid, width)]
    return [(rng.standard_normal((a, b)) / np.sqrt(a), rng.standard_normal(b) * 0.1) for a, b in sizes]


def encode_floats(x: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear, layer norm and SiLU, three times."""
    h = np.asarray(x, np.float64).reshape(-1, 1)
    for w, b in weights:
        h = h @ w + b
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
        h = h / (1 + np.exp(-h))
    return h


def float_encoder(df: DataFrame, key: str, column: str, weights: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """key, emb for every row, without a shuffle; null and NaN have the vector null."""
    numbers = df.select(F.col(key), F.col(column).cast("double").alias("__v"))
    return numbers.select(key, encode_column(numbers, "__v", 0, weights).alias("emb"))


def decode_floats(emb: Column, weights: list[float]) -> Column:
    """Layer norm, then a linear map to one number."""
    return scalar.dot(scalar.layer_norm(emb), F.array(*[F.lit(float(w)) for w in weights]))


def name_vector(name: str, width: int) -> list[float]:
    """A stand-in for a sentence encoder: signed hashed words, of unit length."""
    v = np.zeros(width)
    for word in name.lower().replace("_", " ").replace(":", " ").split():
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        v[h % width] += 1 if h >> 40 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def name_vectors(names: DataFrame, width: int = 32, model=name_vector) -> DataFrame:
    """name, emb for distinct names; model(name, width) may be any encoder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "emb": [model(n, width) for n in f["name"]]})

    return names.select("name").distinct().mapInPandas(run, "name string, emb array<double>")


def edge_name_vectors(edges: DataFrame, width: int = 32, model=name_vector) -> DataFrame:
    """Vectors of all directed edge names, and of the few-shot relation."""
    extra = edges.sparkSession.range(1).select(F.lit("fewshot").alias("name"))
    return name_vectors(edges.select(F.col("directed").alias("name")).unionByName(extra), width, model)


def default_task_vector(vectors: DataFrame) -> DataFrame:
    """node_type, pos, x: the mean of the name vectors of a type's columns (node_type, name, emb)."""
    return vectors.select("node_type", F.posexplode("emb").alias("pos", "v")).groupBy("node_type", "pos").agg(F.avg("v").alias("x"))
