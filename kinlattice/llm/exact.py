"""Exact deduplication through counting quotient filters.

Each partition packs the 64-bit fingerprints of its texts into counting quotient filters, one per
block of the fingerprint space. A fingerprint is its block, a quotient (its place in the filter) and a remainder
(stored), so it can be read back whole: merging filters is a merge of sorted remainders and
loses nothing. A filter holds a fingerprint once with a count, however often a partition has the text, so a hot
text costs each merge one entry per partition. Fingerprints whose merged count is above one route their
texts, and only those, to byte verification: a group-by on the text itself.

Defined cases: a null text is the empty text; of equal texts the row with the largest doc_id stays
(null below all others), and of rows that also share that doc_id exactly one; an empty table gives
an empty result; other columns, whatever their names, are ignored (``drop_copies`` keeps them).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, small_side, text_of

#: Fingerprints that a task gathers before it writes filters: 32 MB.
GATHER = 4_000_000
#: Fingerprints of a block on average, if all are distinct: a merge holds some 32 bytes for each.
BLOCK = 4_000_000
LOAD = 0.8


class CountingQuotientFilter:
    """Distinct fingerprints of ``bits`` bits in order, each with a count.

    Stored: one bit per quotient (is it occupied), one bit per entry (does its run end here),
    the remainders of all entries in as many bytes as they need, and counts of one byte with
    an overflow list for counts of 255 or more.
    """

    def __init__(self, bits: int, values: np.ndarray, counts: np.ndarray):
        self.bits, self.values, self.counts = bits, values, counts

    @classmethod
    def build(cls, bits: int, fingerprints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(bits, values, counts.astype(np.int64))

    def quotient_bits(self) -> int:
        return min(self.bits - 1, max(1, math.ceil(math.log2(max(1, len(self.values)) / LOAD))))

    def to_bytes(self) -> bytes:
        q = self.quotient_bits()
        r = self.bits - q
        quotients = (self.values >> np.uint64(r)).astype(np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
        width = (r + 7) // 8
        remainders = (self.values & np.uint64((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = self.counts[self.counts >= 255]
        head = struct.pack("<BBQQ", self.bits, q, len(self.values), len(many))
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), np.minimum(self.counts, 255).astype(np.uint8).tobytes(), many.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n, n_many = struct.unpack_from("<BBQQ", data)
        r, at = bits - q, struct.calcsize("<BBQQ")
        width = (r + 7) // 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
        ends = np.unpackbits(take((n + 7) // 8), count=n)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width).reshape(n, width)
        counts = take(n).astype(np.int64)
        counts[counts == 255] = take(8 * n_many).view("<i8")
        runs = np.cumsum(ends) - ends  # which run an entry belongs to
        values = (occupied[runs].astype(np.uint64) << np.uint64(r)) | remainders.view("<u8").reshape(-1)
        return cls(bits, values, counts)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Merge the sorted remainders (a stable sort merges the runs it finds) and add the counts of equal ones."""
        values = np.concatenate([f.values for f in filters])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([f.counts for f in filters])[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        return cls(filters[0].bits, values[starts], np.add.reduceat(counts, starts) if len(starts) else counts)


def _filters(block_bits: int):
    bits = 64 - block_bits

    def write(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        blocks = (h >> np.uint64(bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1)) if len(h) else np.zeros(0, np.int64)
        parts = np.split(h & np.uint64((1 << bits) - 1), cuts[1:])
        data = [CountingQuotientFilter.build(bits, p).to_bytes() for p in parts] if len(h) else []
        return pa.record_batch([pa.array(blocks[cuts], pa.int64()), pa.array(data, pa.binary())], names=["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= GATHER:
                yield write(held)
                held, n = [], 0
        if n:
            yield write(held)

    return run


def _repeated(block_bits: int):
    bits = 64 - block_bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()])
        keep = merged.counts > 1
        values = merged.values[keep] | np.uint64(key[0].as_py() << bits)
        return pa.table({"fingerprint": pa.array(values.view(np.int64), pa.int64()), "n": pa.array(merged.counts[keep], pa.int64())})

    return run


def repeated_fingerprints(fingerprints: DataFrame, blocks: int | None = None) -> DataFrame:
    """fingerprint, n: those of the single long column that occur more than once.

    blocks: parts of the fingerprint space, each merged by one task; if not given, twice the shuffle partitions, or as many more
    as keep a block near BLOCK rows (the rows are counted, which a Parquet table answers from its footers).
    """
    block_bits = max(4, math.ceil(math.log2(blocks or max(2 * shuffle_partitions(fingerprints.sparkSession), fingerprints.count() // BLOCK))))
    filters = fingerprints.mapInArrow(_filters(block_bits), "block long, filter binary")
    return filters.groupBy("block").applyInArrow(_repeated(block_bits), "fingerprint long, n long")


def _with_fingerprints(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", text_of(text).alias("t")).withColumn("f", F.xxhash64("t"))


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _with_fingerprints(docs, text)
    repeated = cut(repeated_fingerprints(keyed.select("f"))).select(F.col("fingerprint").alias("f"))
    side = small_side(repeated, repeated.count())
    sha = F.sha2("t", 256).alias("text_sha256")
    single = keyed.join(side, "f", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    routed = keyed.join(side, "f", "left_semi")
    # byte verification: the grouping key is the text
    verified = routed.groupBy("f", "t").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).select("f", sha, "group_size", "keep_id")
    rows = routed.select("doc_id", "f", sha).join(verified, ["f", "text_sha256"])
    of_kept = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("f"))
    many = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (of_kept == 1)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return single.unionByName(many)


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns; only texts whose fingerprint repeats are moved."""
    names = docs.columns
    row = F.struct(F.col("doc_id").alias("__id"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    keyed = docs.select(row.alias("row"), text_of(text).alias("t")).withColumn("f", F.xxhash64("t"))
    repeated = cut(repeated_fingerprints(keyed.select("f"))).select(F.col("fingerprint").alias("f"))
    side = small_side(repeated, repeated.count())
    single = keyed.join(side, "f", "left_anti").select("row")
    # the text is left out of what is aggregated: it is the grouping key
    at = [i for i, c in enumerate(names) if c == text]
    slim = F.struct("row.__id", *[F.col(f"row.__{i}") for i in range(len(names)) if i not in at], *[F.col(f"row.__{i}").isNotNull().alias(f"__{i}") for i in at])
    many = keyed.join(side, "f", "left_semi").groupBy("f", "t").agg(F.max(slim).alias("m"))
    back = F.struct("m.__id", *[(F.when(F.col(f"m.__{i}"), F.col("t")) if i in at else F.col(f"m.__{i}")).alias(f"__{i}") for i in range(len(names))])
    kept = single.unionByName(many.select(back.alias("row")))
    return kept.select(*[F.col(f"row.__{i}").alias(c) for i, c in enumerate(names)])
