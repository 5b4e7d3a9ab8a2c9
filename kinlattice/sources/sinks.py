"""Writers of prepared datasets: parquet throughout, partitioned where readers select."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_features(df: DataFrame, path: str, node_type: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/node/{node_type}/feat")


def save_text_dictionary(df: DataFrame, path: str, node_type: str) -> bool:
    """Written only if there is a row."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(f"{path}/node/{node_type}/text")
    return True


def save_edges(df: DataFrame, path: str) -> bool:
    """Flat edges, one folder per edge type, sorted by src within files so that scans for a source skip row groups."""
    if df.isEmpty():
        return False
    df.repartition("edge_type", F.pmod(F.xxhash64("src"), F.lit(64))).sortWithinPartitions("edge_type", "src").write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edge")
    return True


def save_tasks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("task", "split").parquet(f"{path}/task")


def save_metadata(df: DataFrame, path: str, name: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def save_vectors(df: DataFrame, path: str, kind: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{kind}")


def save_weights(spark: SparkSession, path: str, weights: dict[str, np.ndarray], value: float | None = None) -> bool:
    """Model weights as an .npz file in any store that Spark writes; with a value (higher is better), only if it beats that of the file there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if value is not None and store.exists(at):
        from .catalog import read_weights

        had = read_weights(spark, path).get("__value__")
        if had is not None and float(had) >= value:
            return False
    packed = io.BytesIO()
    np.savez(packed, **weights, **({} if value is None else {"__value__": np.float64(value)}))
    # beside the file, then in its place at once: a crash leaves the old weights or the new ones
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".writing")
    out = store.create(beside, True)
    try:
        out.write(packed.getvalue())
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(beside), store.makeQualified(at), how)
    return True


def append_metrics(df: DataFrame, path: str) -> None:
    """One more set of rows in the log of metrics (run, step, name, value)."""
    df.write.mode("append").parquet(path)
