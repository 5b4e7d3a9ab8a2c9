"""Plan-shape helpers: cutting lineage, and global order without a one-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; make a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinlattice-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: Bits of monotonically_increasing_id() below those of the partition.
PLACE_BITS = 33
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that a lost executor loses nothing.

    The shuffle files behind it aren't needed any more and go at once, so that a loop of many rounds holds one round's at most.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    was = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame of its own: the setting is read when a frame is made
    finally:
        spark.conf.set(_CLEAN_UP, was)


def with_position(df: DataFrame, *order: Column | str, position: str = "pos", before: dict[str, str] | None = None) -> DataFrame:
    """df with its dense 0-based position in a global order, and exclusive running sums of columns.

    before: name of a sum -> column. The order must be total for reruns to agree. Rows are dealt out by ranges of the order and
    sorted there; one row per range carries what went before, so no task sees more than its range. Only sums need a window, and move rows again.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    sums = before or {}
    # the id has the range in its upper bits and the place in it below, so that rows needn't move again to be numbered
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__id", PLACE_BITS))
    totals = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{s}") for s, c in sums.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = totals.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"), *[F.coalesce(F.sum(f"__s_{s}").over(earlier), F.lit(0)).alias(f"__b_{s}") for s in sums])
    so_far = Window.partitionBy("__range").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    out = ranged.join(F.broadcast(bases), "__range").withColumn(position, (F.col("__base") + place).cast("long"))
    for s, c in sums.items():
        out = out.withColumn(s, F.col(f"__b_{s}") + F.coalesce(F.sum(c).over(so_far), F.lit(0)))
    return out.select(*df.columns, position, *sums)
