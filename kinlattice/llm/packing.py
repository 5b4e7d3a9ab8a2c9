"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are encoded where they lie and cut into pieces of at most ``capacity`` tokens. Best-fit decreasing then
runs on the driver over counts by length, of which there are at most ``capacity``, however many pieces there are: sequences with
the same room left form one block, and a length fills a whole block at a time. The plan says which ranks
within a length go to which sequences. Pieces take their slots by joining on their rank within their length.

Ranks are dealt out without bringing a length together, and without moving a piece: the task that encodes numbers its own pieces of each
length, and the numbers of a task are shifted by the counts of those before it. So a length that a third of all
pieces have costs no more than any other, and ids stay where they were made unless the table of shifts (a row per task and length) outgrows
a broadcast. The plan is broadcast; it has a few rows per length and so at most some ten thousand, whatever the input.

Encoding: where the tokenizer is known to drop blanks before it merges (see ``WORDWISE``), texts are cut at ASCII blanks in Arrow, the chunks
of a block are looked up, all at once, among those of a bounded table of chunks and ids, and ids are gathered by offsets, which gives the same ids; a chunk that isn't known is
put together from the ids of its letter runs, digits and signs, looked up in the same way. With any other tokenizer every text is encoded whole.

Defined cases: a null text is empty; an empty text is one piece that holds the end id alone; very long texts are encoded in blocks that end at blanks;
repeated rows and ties are packed each, and ``instance`` tells them apart; a null doc_id is kept; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, cut, map_arrow, small_side, text_of

CAPACITY = 4096
END_ID = 1
#: Chunks of text, and parts of chunks, whose ids a worker keeps, so many each. They lie in flat arrays, some 20 MB in all.
CACHED = 200_000
CACHED_CHARS = 48
#: Characters (or bytes) that a worker cuts into chunks at a time.
BLOCK_CHARS = 2 << 20
#: A task's pieces are numbered from its own start.
TASK_BITS = 33
PIECES = "doc_id long, instance long, piece int, start long, length long, ids binary, task long, own long"
PLAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("p_length", "lo", "hi", "per", "first", "at")])
# The pattern by which the public tokenizer cuts a text into words, and the parts of its file that make it drop blanks.
CLIPPED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": CLIPPED}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The same pattern for lower-case text without characters from FAR on (letters, numbers and the rest of Latin); a blank is a part of its own.
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]| |[^ a-zªµºß-öø-ſ0-9²³¹¼-¾]+")
#: Chunks with characters that normal forms join, or whose lower case hangs on their place, go to the tokenizer whole.
FAR = re.compile(r"[\u0130\u0180-\U0010ffff]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ids that begin at starts, on end."""
    upto = np.cumsum(sizes)
    return ids[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


class Aging:
    """Ids by text, on end; of more than CACHED texts the half that was asked for last is kept."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.make, self.turn = make, 0
        self.young = pa.array([], pa.large_string())
        self.ids, self.sizes, self.asked = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and each one's number; those of texts that aren't known are made together."""
        known = len(self.young)
        coded = pa.concat_arrays([self.young, texts]).dictionary_encode()
        at = coded.indices.slice(known).to_numpy()
        if late := len(coded.dictionary) - known:
            ids, sizes = self.make(coded.dictionary.slice(known))
            self.young = coded.dictionary
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.asked = np.append(self.asked, np.zeros(late, np.int32))
        self.turn += 1
        self.asked[at] = self.turn
        sizes = self.sizes[at]
        ids = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[at], sizes)
        if late:
            self._settle(known)
        return ids, sizes

    def _settle(self, known: int) -> None:
        short = pc.utf8_length(self.young.slice(known)).to_numpy() <= CACHED_CHARS
        if short.all() and len(self.young) <= CACHED:
            return
        keep = np.append(np.arange(known), known + np.flatnonzero(short))
        if len(keep) > CACHED:
            last = np.argpartition(self.asked[keep], len(keep) - CACHED // 2)[len(keep) - CACHED // 2 :]
            keep = np.sort(keep[last])
        self.ids = gather(self.ids, (np.cumsum(self.sizes) - self.sizes)[keep], self.sizes[keep])
        self.young, self.sizes, self.asked = self.young.take(pa.array(keep)), self.sizes[keep], self.asked[keep]


class Encoder:
    """Ids of texts as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the model spells the characters that plain parts may hold.
        self.spelled = {c: spell(chr(c))[0][0] for c in range(0x80, 0x180)}
        told = json.loads(Path(path).read_text())
        model = told["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        self.wordwise = plain and all(told[k] == v for k, v in WORDWISE.items())
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.chunks = Aging(self._parts), Aging(self._chunks)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each))

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of letter runs, digits and runs of signs, straight from the merges; a blank has none."""
        merge = self.merge
        each = [array("I", [t.id for t in merge(p)]) if p != " " else array("I") for p in (p if p.isascii() else p.translate(self.spelled) for p in parts.to_pylist())]
        return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without blanks: plain ones together, from their parts."""
        # one text with blanks between is a quick way to bring them over
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(chunks)], chunks), pa.scalar(" ", chunks.type))[0].as_py()
        odd: set[int] = set()
        if not joined.isascii() or not joined.isprintable() or any(x in joined for x in self.special):
            names = joined.split(" ")
            odd.update(i for i, c in enumerate(names) if not c.isascii() and FAR.search(c) or not c.isprintable())
            for x in self.special:
                if x in joined:
                    odd.update(i for i, c in enumerate(names) if x in c)
        if odd:
            far = np.asarray(sorted(odd))
            near = np.delete(np.arange(len(names)), far)
            ids, sizes = self._whole([names[i] for i in far])
            if len(near):
                more = self._chunks(chunks.take(pa.array(near)))
                ids, sizes = np.concatenate([ids, more[0]]), np.concatenate([sizes, more[1]])
            order = np.argsort(np.concatenate([far, near]))
            return gather(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]
        parts = pa.array(_PARTS.findall(f" {joined}".lower()), pa.large_string())
        ids, sizes = self.parts.all(parts)
        # each chunk has a blank before it
        return ids, np.add.reduceat(sizes, np.flatnonzero(pc.equal(parts, " ").to_numpy(zero_copy_only=False)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's ids begin and the last ones end."""
        if not self.wordwise:
            ids, sizes = self._whole(texts.to_pylist())
            return ids, np.append(0, np.cumsum(sizes))
        chunks = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ids, sizes = self.chunks.all(chunks.flatten())
        bounds = np.append(0, np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
        return ids, np.append(0, np.cumsum(sizes))[bounds]


def blocks(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK_CHARS characters that end at blanks; longer where there is no blank, one where the text is short."""
    at = 0
    while at < len(text) or not at:
        stop = at + BLOCK_CHARS
        while stop < len(text) and text[stop] not in BLANKS:
            stop += 1
        yield text[at:stop]
        at = max(stop, 1)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about BLOCK_CHARS bytes; a longer text is alone."""
    sizes = pc.binary_length(texts).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > BLOCK_CHARS:
            yield texts.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield texts.slice(at)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids (little-endian unsigned 32-bit), its row's instance, its task and its number among the task's pieces of that length.

    The numbers hold for one evaluation of docs, whose rows may come in another order the next time: store the result before it is used twice.
    """
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "instance", "piece", "start", "length", "ids", "task", "own"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())

    def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) > 1 or not encoder(path).wordwise:
            return encoder(path).encode(texts)
        ids = np.concatenate([encoder(path).encode(pa.array([x], pa.string()))[0] for x in blocks(texts[0].as_py())])
        return ids, np.asarray([0, len(ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        instance = task << TASK_BITS
        for b in batches:
            docs_of = iter(b.column(0).to_pylist())
            for texts in slices(b.column(1)):
                rows: list[tuple] = []
                ids, bounds = encoded(texts)
                for lo, hi, doc_id in zip(bounds[:-1].tolist(), bounds[1:].tolist(), docs_of, strict=False):
                    own = np.append(ids[lo:hi], np.uint32(END_ID)).astype("<u4", copy=False)
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((doc_id, instance, piece, at, len(part), part.tobytes(), task, seen[len(part)]))
                        seen[len(part)] += 1
                    instance += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, lo, hi, per, first, at).

    The pieces of that length with ranks lo <= rank < hi go to sequence first + (rank - lo) // per, at offset
    at + (rank - lo) % per * length.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    blocks: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, number of sequences)
    rooms: list[int] = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in blocks:
                blocks[room] = []
                insort(rooms, room)
            blocks[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = blocks[room].pop()
                if not blocks[room]:
                    del blocks[room], rooms[i]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, rank + full * per, per, first, capacity - room))
                put(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and 0 < left < per:
                plan.append((length, rank, rank + left, left, first, capacity - room))
                put(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(room, first, n)
    return plan


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (of ``tokenize``, stored) with sequence_id and offset in place of task and own."""
    spark = pieces.sparkSession
    # own numbers of a task and length are dense, so the last one tells the count
    sizes = cut(pieces.groupBy("length", "task").agg((F.max("own") + 1).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = F.broadcast(spark.createDataFrame(best_fit(counts, capacity), PLAN))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(small_side(shifts, sizes.count()), ["length", "task"]).withColumn("rank", F.col("shift") + F.col("own"))
    placed = ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    sequence = (F.col("first") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id")
    offset = (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset")
    return placed.select(*[F.col(c) for c in pieces.columns if c not in ("task", "own")], sequence, offset)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids and its slot: doc_id, instance, piece, start, length, ids, sequence_id, offset."""
    return assign(cut(tokenize(docs, tokenizer, capacity)), capacity)


def pack_digests(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the crc32 of its ids in place of the ids, and its slot."""
    slim = tokenize(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(cut(slim), capacity)
