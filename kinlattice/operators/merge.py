"""Merging prepared datasets: right-biased keyed union, conflict checks, whole-partition overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have a key, b's row. Keys are matched null-safely and a null value of b stays."""
    mine = a.join(b.select(*[F.col(k).alias(f"__{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return mine.unionByName(b.select(*a.columns))


def conflicts(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that both have with other values: keys, column, left, right (as text)."""
    both = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values]), keys)
    pairs = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"a_{v}").cast("string").alias("left"), F.col(f"b_{v}").cast("string").alias("right"), (~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))).alias("differs")) for v in values])
    return both.select(*keys, F.explode(pairs).alias("p")).where("p.differs").select(*keys, "p.column", "p.left", "p.right")


def vector_gap(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """key, gap: the largest absolute difference of the vectors of shared keys; infinite if lengths differ."""
    both = a.select(key, F.col("emb").alias("a")).join(b.select(key, F.col("emb").alias("b")), key)
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return both.select(key, F.when(F.size("a") != F.size("b"), F.lit(float("inf"))).otherwise(F.coalesce(gap, F.lit(0.0))).alias("gap"))


def checked_union(a: DataFrame, b: DataFrame, key: str = "name", tolerance: float = 1e-5) -> DataFrame:
    """Vectors of both; shared keys must agree within the tolerance, or the query fails."""
    gaps = vector_gap(a, b, key).withColumnRenamed("gap", "__gap")
    wrong = F.raise_error(F.concat(F.lit("vectors disagree: "), F.col(key).cast("string")))
    theirs = b.join(gaps, key, "left").withColumn(key, F.when(F.coalesce("__gap", F.lit(0.0)) > tolerance, wrong).otherwise(F.col(key))).drop("__gap")
    return a.join(b.select(key), key, "left_anti").unionByName(theirs.select(*a.columns))


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace whole partitions of a stored dataset with those of df; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
