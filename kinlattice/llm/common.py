"""Small helpers that every training-data operator uses."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import let
from ..plans.shape import cut, ensure_checkpoint_dir

__all__ = ["BLANKS", "BROADCAST_ROWS", "ODD_BLANK", "COMPACT_ROWS", "WORD", "beside", "compact", "cut", "documents", "ensure_checkpoint_dir", "let", "map_arrow", "shuffle_partitions", "small_side", "text_of", "words"]

#: Rows of (long, long) that may be broadcast: 16 bytes each, so 16 MB at most before hashing.
BROADCAST_ROWS = 1_000_000
#: Narrow rows (of some 100 bytes) that one task may hold alone, or each task beside its own: 5 MB.
COMPACT_ROWS = 50_000
#: Bytes of a batch that goes to a Python worker at once.
BATCH_BYTES = 8 << 20
#: Characters that separate words, the complement of [^\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"
#: What str.split() would cut at besides BLANKS.
ODD_BLANK = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if its counted rows are few enough; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df in one partition if its counted rows are few: with ``beside`` for its joins, nothing moves and no idle tasks start.

    The same plan runs over many partitions where there are more rows.
    """
    return df.coalesce(1) if rows <= COMPACT_ROWS else df


def beside(df: DataFrame, rows: int) -> DataFrame:
    """df as the broadcast side of a join with a compact frame, if it has few rows itself; rows is its count or a bound of it."""
    return F.broadcast(df) if rows <= COMPACT_ROWS else df


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES, unless the session names a size of its own.

    Batches are cut by rows otherwise, and some thousand long texts would be in memory several times over. Workers are used again, by other
    stages too: a task gives back what Arrow holds for it beyond its data, some 50 MB a worker.
    """

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64MB", "67108864"):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run_and_release, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: str) -> list[str]:
    """The matches of WORD."""
    return re.findall(WORD, text) if ODD_BLANK.search(text) else text.split()
