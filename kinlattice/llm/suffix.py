"""Exact removal of repeated 200-byte strings by pruned, distributed prefix doubling.

Plain prefix doubling sorts a (rank, rank at offset) pair for every byte in every round, some tens of times the input. Here
most positions leave before they are ever written.

Round 0, length 32. Every window of 200 bytes holds 169 strings of 32 bytes; the leftmost of those with the smallest hash is
its anchor. Anchors depend on a window's bytes alone, so equal windows have equal anchors at equal places, and a window can only
repeat if its anchor's 32 bytes do. There is about one anchor per 70 bytes. Spark groups anchors by
their rank (the hash of the 32 bytes); unique ranks leave, and with them all windows that they own.

Round 1, length up to 368. Each remaining anchor gets the rank of the whole stretch of windows that it owns. If all anchors
of a rank have equal stretches, or if an anchor's stretch occurs twice, its windows are settled.

Round 2, length 200. One anchor of each distinct stretch is compared with the others of its rank, now per window: a worker makes pairs (rank at i,
rank at i + h) into ranks of twice the length until they are past 200 and counts those only, so 64 and 128 are no rounds of Spark's; ranks that occur twice are repeated windows.
Spark sorts stretches by their first rank, so that many small groups are doubled in one batch; the few
ranks with more than ``SPLIT`` distinct stretches are dealt out window by window in a group-by instead.

Ranks are 64-bit hashes of content in place of dense numbers, so no round has to count. Texts are known by a 128-bit hash:
equal texts share their spans, and a text with a thousand copies is looked at once.

Defined cases: a null text is empty; a text under 200 bytes keeps all; matches end at the ends of a text; occurrences in the same
text count, overlapping ones too; repeated rows repeat each other's strings; null doc_ids are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, map_arrow, text_of

LENGTH = 200
FIRST = 32
#: Distinct stretches of one rank above which their windows are grouped by Spark.
SPLIT = 20_000
#: Windows of a text that are looked at together, and rows of stretches that a worker doubles together.
SEGMENT = 1 << 20
TOGETHER = 20_000
_PLACE = np.uint64(SEGMENT * 2 - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(200).integers(0, 2**64, 256, dtype=np.uint64)


def doubled(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of the pairs (rank at i, rank at i + offset)."""
    out = ranks[: len(ranks) - offset] if offset else ranks
    out = (out ^ (out >> np.uint64(29))) * _A + ranks[offset:]
    out ^= out >> np.uint64(32)
    out *= _B
    return out


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of the string of that length at every position, by prefix doubling."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    ranks, n = _BYTES[data], 1
    while n < length:
        step = min(n, length - n)
        ranks, n = doubled(ranks, step), n + step
    return ranks ^ (ranks >> np.uint64(31))


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rank and place of each anchor, and the first and last start of the windows it owns."""
    for base in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[base : base + SEGMENT + LENGTH - 1]
        ranks = prefix_ranks(part, FIRST)
        # the low bits of what is minimised are the place, so that the leftmost of equal hashes is the least
        least = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=np.uint64)
        n, width = 1, LENGTH - FIRST + 1
        while n < width:
            step = min(n, width - n)
            least, n = np.minimum(least[: len(least) - step], least[step:]), n + step
        owner = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        last = np.append(first[1:], len(owner)) - 1
        yield ranks[owner[first]], owner[first] + base, first + base, last + base


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.zeros(0, np.uint64)]
        for text in b.column(0):
            found += [a[0] for a in anchors(np.frombuffer(text.as_py().encode(), np.uint8))]
        yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["rank"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, stretch, t1, t2, id, at of every anchor; at packs its place, and how far before it its windows start."""
    for b in batches:
        out: list[list] = [[np.zeros(0, np.uint64)], [], [], []]
        for row, text in enumerate(b.column(0)):
            data = text.as_py().encode()
            for rank, place, first, last in anchors(np.frombuffer(data, np.uint8)):
                far, near = place - first, place - last
                out[0].append(rank)
                out[1] += [xxhash.xxh3_64_intdigest(data[s : e + LENGTH], seed=d) for s, e, d in zip(first.tolist(), last.tolist(), far.tolist(), strict=True)]
                out[2].append(np.full(len(rank), row))
                out[3].append((place << 16) | (far << 8) | near)
        rows = pa.array(np.concatenate([np.zeros(0, np.int64), *out[2]]))
        at = np.concatenate([np.zeros(0, np.int64), *out[3]])
        ids = [b.column(i).take(rows) for i in (1, 2, 3)]
        stretch = np.asarray(out[1], np.uint64).view(np.int64)
        yield pa.record_batch([pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(stretch), *ids, pa.array(at)], names=["rank", "stretch", "t1", "t2", "id", "at"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with lists of anchors: the bytes of each anchor's stretch."""
    for b in batches:
        rows: list[tuple] = []
        for text, t1, t2, found in zip(*(b.column(i) for i in range(4)), strict=True):
            data = text.as_py().encode()
            for a in found.as_py():
                place, far, near = a["at"] >> 16, a["at"] >> 8 & 255, a["at"] & 255
                rows.append((a["rank"], t1.as_py(), t2.as_py(), a["at"], a["twice"], a["split"], data[place - far : place - near + LENGTH]))
            if len(rows) >= 50_000:
                yield _stretch_batch(rows)
                rows = []
        yield _stretch_batch(rows)


_STRETCH = "rank long, t1 long, t2 long, at long, twice boolean, split boolean, bytes binary"
_SPANS = "t1 long, t2 long, start long, stop long"


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    long, flag = pa.int64(), pa.bool_()
    columns = zip(*rows, strict=True) if rows else [()] * 7
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (long, long, long, long, flag, flag, pa.binary()), strict=True)], names=["rank", "t1", "t2", "at", "twice", "split", "bytes"])


def _window_ranks(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all stretches: its rank at full length, the stretch it is of, and its start in there."""
    sizes = np.asarray([len(x) for x in blobs], np.int64)
    ranks = prefix_ranks(np.frombuffer(b"".join(blobs), np.uint8), LENGTH)
    counts = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(blobs)), counts)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return ranks[np.repeat(np.cumsum(sizes) - sizes, counts) + within], of, within


def _runs(of: np.ndarray, within: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first and last window of each maximal run of hits."""
    of, within = of[hit], within[hit]
    if not len(of):
        return of, within, within
    new = np.append(True, (of[1:] != of[:-1]) | (within[1:] != within[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    return of[first], within[first], within[last]


def _double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, from stretches sorted by rank."""
    held: list[pa.RecordBatch] = []
    n = 0

    def solve(table: pa.Table) -> pa.RecordBatch:
        rank = table.column("rank").to_numpy()
        at, twice = table.column("at").to_numpy(), table.column("twice").to_numpy(zero_copy_only=False)
        ranks, of, within = _window_ranks(table.column("bytes").to_pylist())
        keys = doubled(np.stack([rank[of].view(np.uint64), ranks], 1).reshape(-1), 1)[::2]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        settled = np.bincount(inverse, weights=twice[of]) > 0
        hit = ((counts > 1) | settled)[inverse] & ~twice[of]
        stretch, first, last = _runs(of, within, hit)
        base = (at >> 16) - (at >> 8 & 255)
        rows = pa.array(stretch)
        return pa.record_batch([table.column("t1").combine_chunks().take(rows), table.column("t2").combine_chunks().take(rows), pa.array(base[stretch] + first), pa.array(base[stretch] + last + LENGTH)], names=["t1", "t2", "start", "stop"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            ranks = table.column("rank").to_numpy()
            whole = int(np.searchsorted(ranks, ranks[-1], side="left"))  # the last group may go on
            if whole:
                yield solve(table.slice(0, whole).combine_chunks())
                table = table.slice(whole).combine_chunks()
            held, n = table.to_batches(), table.num_rows
    if n:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a stretch as a row."""
    for b in batches:
        for i in range(0, b.num_rows, TOGETHER // 4):
            part = b.slice(i, TOGETHER // 4)
            ranks, of, within = _window_ranks(part.column("bytes").to_pylist())
            at = part.column("at").to_numpy()
            rows = pa.array(of)
            start = ((at >> 16) - (at >> 8 & 255))[of] + within
            yield pa.record_batch([*(part.column(c).take(rows) for c in ("rank", "t1", "t2", "twice")), pa.array(ranks.view(np.int64)), pa.array(start)], names=["rank", "t1", "t2", "twice", "window", "start"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lists of spans to lists of maximal spans."""
    for b in batches:
        out = []
        for found in b.column(2):
            x = np.asarray([(s["start"], s["stop"]) for s in found.as_py()], np.int64)
            x = x[np.argsort(x[:, 0], kind="stable")]
            upto = np.maximum.accumulate(x[:, 1])
            new = np.append(True, x[1:, 0] > upto[:-1])
            out.append(np.stack([x[new, 0], upto[np.append(np.flatnonzero(new)[1:], len(x)) - 1]], 1).reshape(-1))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["t1", "t2", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """t1, t2, spans: per distinct text with any, the maximal repeated spans as start, stop, start, stop, ..."""
    keyed = _keyed(docs)
    texts = keyed.select("text", "t1", "t2", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"))
    shared = cut(map_arrow(texts.select("text"), _ranks, "rank long").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank"))
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    found = map_arrow(texts, _stretches, "rank long, stretch long, t1 long, t2 long, id long, at long").join(side, "rank", "left_semi")
    found = cut(found.groupBy("rank", "stretch", "t1", "t2", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")))

    one = found.groupBy("rank", "stretch").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "id", "at")).alias("x"))
    classes = cut(one.select("rank", "stretch", "n", "x.*"))
    # counted by tasks first, so that a rank with very many stretches isn't one task
    several = classes.groupBy("rank").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    place = F.shiftright("at", 16)
    start = place - F.shiftright("at", 8).bitwiseAND(F.lit(255))
    stop = place - F.col("at").bitwiseAND(F.lit(255)) + LENGTH
    settled = found.join(classes.where("n > 1").select("rank", "stretch"), ["rank", "stretch"], "left_semi").select("t1", "t2", start.alias("start"), stop.alias("stop"))

    unsettled = cut(classes.join(several, "rank"))
    lists = unsettled.groupBy("t1", "t2", "id").agg(F.collect_list(F.struct("rank", "at", (F.col("n") > 1).alias("twice"), (F.col("different") > SPLIT).alias("split"))).alias("anchors"))
    size = unsettled.count()
    lists = F.broadcast(lists) if size <= BROADCAST_ROWS else lists
    stretches = map_arrow(texts.join(lists, ["t1", "t2", "id"]).select("text", "t1", "t2", "anchors"), _cut_out, _STRETCH)
    even = unsettled.where(F.col("different") > SPLIT).isEmpty()
    if not even:
        stretches = cut(stretches)
    local = map_arrow(stretches.where("not split").repartition("rank").sortWithinPartitions("rank"), _double, _SPANS)
    spans = settled.unionByName(local)
    if not even:
        windows = cut(map_arrow(stretches.where("split"), _windows, "rank long, t1 long, t2 long, twice boolean, window long, start long"))
        many = windows.groupBy("rank", "window").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("rank", "window")
        hits = windows.where("not twice").join(many, ["rank", "window"], "left_semi")
        spans = spans.unionByName(hits.select("t1", "t2", "start", (F.col("start") + LENGTH).alias("stop")))
    lists = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    return cut(map_arrow(lists, _merge, "t1 long, t2 long, spans array<long>"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): what is left of every text, and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, n_spans, kept = [], [], [], []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                data, s = text.as_py().encode(), spans.as_py() or []
                n_bytes.append(len(data))
                removed.append(sum(s[1::2]) - sum(s[::2]))
                n_spans.append(len(s) // 2)
                kept.append(b"".join(data[a:z] for a, z in zip([0, *s[1::2]], [*s[::2], len(data)], strict=True)))
            yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), b.column(2), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    spans = repeated_spans(docs)
    size = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    side = F.broadcast(spans) if size <= BROADCAST_ROWS else spans
    rows = _keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(side, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
