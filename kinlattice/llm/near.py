"""Near-duplicate detection by order MinHash and banded alignment.

Texts are sequences of lower-cased words; their k-mers are runs of five words, each labelled with its occurrence number,
so that a repeated run counts as often as it is there. For each of ``FUNCTIONS`` hash functions the ``LENGTH``
labelled k-mers with the smallest hashes are taken in the order of the text (Marcais et al., 2019), and each two of them make a sketch: two texts agree in a sketch if
two k-mers are among the first of both and in the same order, which falls with edit distance and not only with the overlap of sets.
Three k-mers of a function agree in some two about 3.5 times as often as its first two do, where a fifth of k-mers is shared.

Texts that agree in a sketch are candidates, less those that can't have enough words in common, by an exact bound from the number of
words in each of 1,024 cells. A candidate pair is verified by an alignment of the two word sequences in the band of diagonals that
the threshold allows, column by column with a column's differences in the bits of two whole numbers (Myers, 1999). Its similarity is
1 - edits / words of the longer text, with insertions, deletions and substitutions of words as edits; at 0.8 or more the
texts are linked. Classes are connected components.

Identical texts collapse first and are one node. Within a bucket a leader is compared with each other node, a
number of pairs linear in the bucket. Leaders are chosen by popularity, the summed sizes of a node's buckets: copies
share more sketches with the text they were made from than with each other, so the original leads. Linked nodes then
collapse to their component, and in buckets that still hold several components the leaders of more of them are compared
with the nodes of all others (3, then 7, then 15, and fewer in larger buckets, see ``LEADERS``), until a round
links nothing new or has the full width. These rounds only spare work: a component's leader needn't be in a bucket, nor all its nodes be compared there. So all
untested pairs of several components in a bucket of up to 64 nodes follow, and the nodes of larger buckets that still hold several components
go through an exact prefix filter on labelled words (see ``_sharing``), whichever of their buckets the rounds searched; where these pairs are many, the
likeliest of each node are tested first, and what they bring into one component isn't tested any more. Every pair that agrees in
a sketch is then in one class, or tested, or excluded by an exact bound; pairs that agree in no sketch are the only loss: fewer than one in ten at 0.81
similarity, and most where a text of a few words is edited (no run of five words is left).

Defined cases: a null text is empty; equal texts, the empty one included, form a class; a text of fewer than five words has one
k-mer, the whole of it; rows without words are linked to identical texts only; memory for a pair of very long texts is linear in them; a null doc_id is kept, and a
class is named by its smallest doc_id (null if it has none); an empty table gives an empty result; other columns
are ignored (``drop_near_copies`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import COMPACT_ROWS, beside, compact, cut, map_arrow, small_side, text_of, words
from .graph import absorb

K = 5
#: Hash functions, and smallest labelled runs that each takes; each two of them, in the order of the text, are a sketch.
FUNCTIONS = 18
LENGTH = 3
THRESHOLD = 0.8
#: (nodes of a bucket up to, components whose leaders are compared with all its nodes by the rounds). What they leave out follows.
LEADERS = ((64, 15), (None, 7))
WIDEST = 15
#: Large buckets that a node is searched in by the rounds of leaders, its largest ones; the exact pass behind them covers all.
CROWDS = 2
#: Cells in which the words of a text are counted by hash, to bound how many two texts can have in common.
CELLS = 1024
#: Occurrences of a word that share a cell. So a word that fills a text doesn't fill a cell, whose count has 7 bits.
AGAIN = 16
#: Cells in which the words of all texts of the prefix filter are counted, so that rare ones come first: 1 MB.
RARITY_BITS = 18
#: Bits in which a text of the prefix filter marks its labelled words, 128 bytes: the words that most texts list first have one of the OWN lower bits each, all others share the rest by hash.
MARKS = 1024
OWN = 512
#: Untested pairs of the last pass that are aligned at once. Of more, the BEST likeliest of each node go first, and pairs that these bring into one component are spared.
FEW = 10_000
BEST = 3
#: Words whose hashes a worker keeps, and words and texts that it sketches together; a longer text is alone.
CACHED = 100_000
TOGETHER = 200_000
TEXTS = 2_000
#: Columns of an alignment between moves of its band.
STEP = 512
_RNG = np.random.default_rng(20_190_708)
_SEEDS = _RNG.integers(0, 2**64, FUNCTIONS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


class Hashes(dict):
    """64-bit hashes of words, computed when first asked for and kept while there is room."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED:
            self[word] = h
        return h


_HASHES = Hashes()


def word_hashes(text: str) -> np.ndarray:
    w = words(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))


def runs(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word runs; a shorter text is one run."""
    k = min(K, len(h))
    out = np.zeros(max(0, len(h) - k + 1) if k else 0, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _P + h[i : len(h) - k + 1 + i]
    return out


def occurrence(r: np.ndarray, of: np.ndarray | None = None) -> np.ndarray | None:
    """How often each hash came before, in each of the texts that ``of`` names if given; None if none comes again."""
    keys = r if of is None else r ^ (of.astype(np.uint64) + np.uint64(1)) * _P
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1])
    if new.all():
        return None
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return nth


def labelled(r: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Hashes mixed with the number of their occurrence, in each of the texts that ``of`` names if given."""
    nth = occurrence(r, of)
    return r if nth is None else r + nth * _Q


def cell_of(h: np.ndarray, bits: int) -> np.ndarray:
    y = h * _P
    y = (y ^ (y >> np.uint64(32))) * _Q
    return (y >> np.uint64(64 - bits)).astype(np.int64)


def order_minhash(hashes: list[np.ndarray]) -> np.ndarray:
    """Per text (all with words) a sketch for each function and each two of its LENGTH smallest labelled runs, hashed in text order.

    A text of fewer runs has fewer sketches, or one of its only run; the places left are filled with the function's first.
    """
    each = [runs(h) for h in hashes]
    sizes = np.asarray([len(r) for r in each])
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(each)), sizes)
    x = labelled(np.concatenate(each), of)
    place = np.arange(len(x), dtype=np.uint64) - starts[of].astype(np.uint64)
    pairs = [(c, d) for d in range(1, LENGTH) for c in range(d)]
    out = np.zeros((len(each), FUNCTIONS * len(pairs)), np.uint64)
    inner = np.uint64((1 << max(20, int(sizes.max()).bit_length())) - 1)
    for j in range(FUNCTIONS):
        y = (x ^ _SEEDS[j]) * _ODD[j]
        # the low bits of what is minimised are the place
        y = (y & ~inner) | place
        found = np.empty((LENGTH, len(each)), np.uint64)
        for c in range(LENGTH):
            found[c] = least = np.minimum.reduceat(y, starts)
            there = np.flatnonzero(least != _NONE)
            y[starts[there] + (least[there] & inner).astype(np.int64)] = _NONE
        found = np.sort(np.where(found == _NONE, _NONE, found & inner), axis=0)
        held = found != _NONE
        run = x[starts + np.where(held, found, np.uint64(0)).astype(np.int64)]
        value = np.where(held[1], ((run[0] * _P) ^ (run[0] >> np.uint64(31))) * _P + run[1], run[0])
        for i, (c, d) in enumerate(pairs):
            both = ((run[c] * _P) ^ (run[c] >> np.uint64(31))) * _P + run[d]
            out[:, j * len(pairs) + i] = np.where(held[d], both, value)
    return out


def cells(hashes: list[np.ndarray]) -> np.ndarray:
    """Per text the number of words in each of CELLS cells by hash. Each AGAIN further occurrences of a word have a cell of their own, in all texts the same."""
    of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    h = np.concatenate(hashes)
    count = lambda h, of: np.bincount(of * CELLS + cell_of(h, CELLS.bit_length() - 1), minlength=CELLS * len(hashes)).reshape(-1, CELLS)
    low = count(h, of)
    full = low.max(axis=1) > AGAIN  # in the others no word comes so often
    if full.any():
        h, of = h[full[of]], of[full[of]]
        nth = occurrence(h, of)
        if nth is not None:
            low[full] = count(h + nth // np.uint64(AGAIN) * _Q, of)[full]
    return low


def _masks(rows: np.ndarray, columns: list[int]) -> dict[int, int]:
    """For the words of the columns: the rows that hold them, as bits."""
    found: dict[int, int] = {}
    if len(rows) <= 4 * STEP:
        for i, x in enumerate(rows.tolist()):
            found[x] = found.get(x, 0) | 1 << i
    else:
        for x in set(columns):
            if (here := rows == np.uint64(x)).any():
                found[x] = int.from_bytes(np.packbits(here, bitorder="little").tobytes(), "little")
    return found


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions, deletions and substitutions that turn a into b at the least; None if more than ``most``.

    A column of the table of distances is kept as the differences of neighbours, +1 in ``up`` and -1 in ``down``. Only rows within ``most``
    of the diagonal are kept: beyond, distances are taken to grow by 1 a step, which is never too low, and no way
    of at most ``most`` edits leads there.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return None
    lo = hi = up = down = score = 0
    for at in range(0, len(b), STEP):
        part = b[at : at + STEP].tolist()
        lo, before, bottom, hi = max(0, at - most), lo, hi, min(len(a), at + len(part) + most)
        up = up >> (lo - before) | ((1 << (hi - bottom)) - 1) << (bottom - lo)
        down >>= lo - before
        score += hi - bottom
        if hi == lo:
            return len(b) if len(b) <= most else None
        every, last = (1 << (hi - lo)) - 1, 1 << (hi - lo - 1)
        masks = _masks(a[lo:hi], part)
        for x in part:
            same = masks.get(x, 0)
            level = (((same & up) + up) ^ up) | same | down
            right, left = down | every & ~(level | up), up & level
            score += (1 if right & last else 0) - (1 if left & last else 0)
            right, left = right << 1 & every | 1, left << 1 & every
            up, down = left | every & ~(level | right), right & level
    if not len(b):
        score = len(a)
    return score if score <= most else None


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """1 - edits / words of the longer of two sequences of word hashes; 0 where that is below the threshold."""
    longer = max(len(a), len(b))
    if not len(a) or not len(b):
        return 0.0
    most = int((1 - threshold) * longer + 1e-9)
    la, lb = np.sort(labelled(a)), np.sort(labelled(b))
    common = int((la[np.minimum(np.searchsorted(la, lb), len(la) - 1)] == lb).sum())
    if common < longer - most:
        return 0.0
    d = edits(a, b, most)
    return 0.0 if d is None else 1 - d / longer


def _key(text: Column) -> Column:
    """What names a text: its md5 in 16 bytes, half of what its digits take in every shuffle and broadcast."""
    return F.unhex(F.md5(text))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (md5 of the text, 16 bytes), n_words, the order MinHash sketches and the cells of every row; without cells where one holds more than 127 words (texts of some 50,000)."""
    names = ["doc_id", "key", "n_words", "sketch", "cells"]

    def lists(rows: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
        """n lists; those of ``of`` are the rows, the others are null."""
        sizes = np.zeros(n, np.int64)
        sizes[of] = rows.shape[1] if len(of) else 0
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), kind), mask=pa.array(sizes == 0))

    def told(ids: pa.Array, keys: pa.Array, hashes: list[np.ndarray]) -> pa.RecordBatch:
        n = np.asarray([len(h) for h in hashes], np.int64)
        of = np.flatnonzero(n)
        held = [hashes[i] for i in of]
        sketch = order_minhash(held).view(np.int64) if held else np.zeros((0, 1), np.int64)
        low = cells(held) if held else np.zeros((0, CELLS), np.int64)
        few = low.max(axis=1, initial=0) <= 127
        return pa.record_batch([ids, keys, pa.array(n), lists(sketch, of, len(n), pa.int64()), lists(low[few], of[few], len(n), pa.int8())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size, hashes = 0, 0, []
            for i, text in enumerate(b.column(2)):
                h = word_hashes(text.as_py())
                if hashes and (size + len(h) > TOGETHER or len(hashes) == TEXTS):
                    yield told(b.column(0).slice(at, i - at), b.column(1).slice(at, i - at), hashes)
                    at, size, hashes = i, 0, []
                hashes.append(h)
                size += len(h)
            if hashes:
                yield told(b.column(0).slice(at), b.column(1).slice(at), hashes)

    text = text_of()
    return map_arrow(docs.select(F.col("doc_id").cast("long"), _key(text).alias("key"), text.alias("text")), run, "doc_id long, key binary, n_words long, sketch array<long>, cells array<tinyint>")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough, with their similarity."""
    need = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    n = need.count()
    keyed = docs.select(text_of().alias("text")).withColumn("key", _key(F.col("text")))
    texts = cut(keyed.join(small_side(need, n), "key", "left_semi").dropDuplicates(["key"]))
    one = pairs.repartition("b").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ha = None, None
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, ha = a, word_hashes(ta.as_py())
                s = similarity(ha, word_hashes(tb.as_py()))
                if s >= THRESHOLD:
                    keep.append((i, s))
            at = pa.array([i for i, _ in keep], pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array([s for _, s in keep], pa.float64())], names=["a", "b", "similarity"])

    return map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a binary, b binary, similarity double")


def _leaders(member: DataFrame, n: int, roots: DataFrame, used: DataFrame | None, n_used: int, width: int) -> tuple[DataFrame, DataFrame]:
    """member with the root of each node, and the leaders (t, of, leader, length) that a bucket hasn't had yet.

    A component's leader is its most popular node, in whichever buckets the component is, so that buckets that hold nearly the same
    nodes ask for nearly the same pairs. A bucket has the leaders of its ``width`` most popular components; ranking is cut to width
    rows per bucket in each task before it is shuffled. n is the number of rows of member, which bounds roots and leaders too.
    """
    grouped = member.join(beside(roots, n), F.col("key") == F.col("node"), "left").select("t", "n", "key", "size", "popularity", F.coalesce("root", "key").alias("root"))
    tops = grouped.groupBy("root").agg(F.max(F.struct("popularity", "key", "size")).alias("top"))
    held = grouped.select("t", "n", "root").distinct().join(beside(tops, n), "root")
    order = Window.partitionBy("t").orderBy(F.col("top").desc())
    most = F.coalesce(*[F.when(F.col("n") <= size, F.lit(w)) for size, w in LEADERS if size], F.lit(LEADERS[-1][1]))
    ranked = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width).where(F.col("rank") <= most)
    leaders = ranked.select("t", F.col("root").alias("of"), F.col("top.key").alias("leader"), F.col("top.size").alias("length"))
    return grouped, cut(leaders.join(beside(used, n_used), ["t", "leader"], "left_anti") if used is not None else leaders)


def _candidates(grouped: DataFrame, leaders: DataFrame, n: int, tested: DataFrame | None, n_tested: int) -> DataFrame:
    """Untested pairs (a < b): the new leaders of each bucket with all its nodes of other components.

    A leader may be outside the bucket, and then says nothing of its component's nodes inside: see ``_rest`` and ``_sharing``.
    """
    # texts of too different lengths can't be similar
    fits = 5 * F.least("size", "length") >= 4 * F.greatest("size", "length")
    pairs = grouped.join(beside(leaders, n), ["t"]).where((F.col("root") != F.col("of")) & fits).select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct()
    return cut(pairs.join(beside(tested, n_tested), ["a", "b"], "left_anti") if tested is not None else pairs)


def _possible(pairs: DataFrame, counts: DataFrame, n: int, n_pairs: int | None = None) -> DataFrame:
    """The pairs whose texts may have enough words in common: no more than the lesser counts of their cells, an exact bound.

    n is the number of rows of counts, which are some four times as wide as others. Where n_pairs tells that pairs are few, only the counts of their ends move.
    """
    if n_pairs is not None and n_pairs <= COMPACT_ROWS < 4 * n:
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        n = ends.count()
        counts = counts.join(F.broadcast(ends), "key", "left_semi")
    side = lambda end: beside(counts.select(F.col("key").alias(end), F.col("cells").alias(f"x_{end}"), F.col("size").alias(f"n_{end}")), 4 * n)
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.aggregate(F.zip_with("x_a", "x_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    # each word of the longer text that the other hasn't is an edit
    return cut(both.where(F.coalesce(5 * common >= 4 * F.greatest("n_a", "n_b"), F.lit(True))).select("a", "b"))


def _open(held: DataFrame, roots: DataFrame, n_roots: int) -> DataFrame:
    """The rows of held, with the root of each node, in buckets that hold several components."""
    rooted = held.join(beside(roots, n_roots), F.col("key") == F.col("node"), "left").select("t", "n", "key", "size", F.coalesce("root", "key").alias("root"))
    return rooted.join(rooted.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t"), ["t"], "left_semi")


def _rest(held: DataFrame) -> DataFrame:
    """All pairs (a < b) of held's rows that share a bucket and not a component, for buckets of bounded size."""
    other = held.select("t", *[F.col(c).alias(f"{c}_b") for c in ("key", "size", "root")])
    fits = 5 * F.least("size", "size_b") >= 4 * F.greatest("size", "size_b")
    pairs = held.join(other, ["t"]).where((F.col("key") < F.col("key_b")) & (F.col("root") != F.col("root_b")) & fits)
    return pairs.select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct()


def _sharing(nodes: DataFrame, n: int, docs: DataFrame) -> DataFrame:
    """The pairs of ``_met``, once each."""
    return _met(nodes, n, docs).distinct()


def _met(nodes: DataFrame, n: int, docs: DataFrame) -> DataFrame:
    """All pairs (a < b) of nodes (key: md5 of the text in digits, root) of several components that may be similar, and the words they miss at least: an exact prefix filter on labelled words.

    A pair at the threshold has 4/5 of the longer text's words in common at least. So if all texts list their words in one order, the first fifth of
    each, and one more, have a word in common, and behind the first such word enough is left in both. Rare words come first: words are
    counted in cells of fixed number, so that the order is known to every task without a join. Texts also mark their labelled words in MARKS bits: a bit that only one
    of two texts has set is a word that the other hasn't, so most pairs that share a rare word and are not similar aren't made.

    A pair is wanted once, at the first word that both list, and not at each. The words that most texts list have bits of their own, in the order of
    words: where two texts have such a bit in common below a shared word, it isn't their first, and the pair is left to an earlier one. None is lost, as nothing is below the first.
    """
    keyed = docs.select(F.md5(text_of()).alias("key"), text_of().alias("text"))
    texts = keyed.join(small_side(nodes, n), "key").select("key", "root", "text").dropDuplicates(["key"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([labelled(word_hashes(t.as_py())).view(np.int64) for t in b.column(2)], pa.list_(pa.int64()))], names=["key", "root", "words"])

    each = cut(map_arrow(texts, listed, "key string, root string, words array<long>"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            often += np.bincount(cell_of(b.column(0).flatten().to_numpy().view(np.uint64), RARITY_BITS), minlength=len(often))
        at = np.flatnonzero(often)
        yield pa.record_batch([pa.array(at), pa.array(often[at])], names=["cell", "often"])

    often = np.zeros(1 << RARITY_BITS, np.float64)
    # a row per cell, of which there are 2**RARITY_BITS
    for r in map_arrow(each.select("words"), counted, "cell long, often long").groupBy("cell").agg(F.sum("often").alias("often")).collect():
        often[r["cell"]] = r["often"]
    level = docs.sparkSession.sparkContext.broadcast(np.ceil(4 * np.log2(1 + often)).astype(np.uint8))

    def in_order(w: np.ndarray) -> np.ndarray:
        return w[np.lexsort((w, level.value[cell_of(w, RARITY_BITS)]))]

    def listed_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.asarray(x.values.to_numpy()).view(np.uint64) for x in b.column(0)]
            word, times = np.unique(np.concatenate([in_order(w)[: len(w) // 5 + 1] for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(times, pa.int64())], names=["word", "times"])

    usual = map_arrow(each.select("words"), listed_first, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).where("times > 1")
    # OWN rows
    top = np.asarray([r["word"] for r in usual.orderBy(F.col("times").desc(), "word").limit(OWN).collect()], np.int64).view(np.uint64)
    place = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(in_order(top).tolist())})

    def first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out, below, bits = [], [], [], []
            for words in b.column(2):
                w = in_order(np.asarray(words.values.to_numpy()).view(np.uint64))
                own = np.fromiter((place.value.get(x, -1) for x in w.tolist()), np.int64, len(w))
                sizes.append(len(w))
                set_ = np.zeros(MARKS, bool)
                set_[own[own >= 0]] = True
                set_[OWN + cell_of(w[own < 0], 64) % (MARKS - OWN)] = True
                bits.append(np.packbits(set_, bitorder="little").view(np.int64))
                most = len(w) // 5 + 1
                out.append(w[:most].view(np.int64))
                # own bits of the words before each: all below the last one's
                below.append(np.append(0, np.maximum.accumulate(own[:most] + 1))[: len(own[:most])].astype(np.int32))
            firsts = pa.StructArray.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(below))], names=["word", "below"]) if out else pa.array([], pa.struct([("word", pa.int64()), ("below", pa.int32())]))
            firsts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in out])), pa.int32()), firsts)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), firsts], names=["key", "root", "n", "bits", "first"])

    first = cut(map_arrow(each, first_words, "key string, root string, n long, bits array<long>, first array<struct<word: long, below: int>>"))
    first = first.select("key", "root", "n", "bits", F.posexplode("first").alias("at", "f")).select("key", "root", "n", "bits", "at", "f.word", "f.below")
    one = first.select("word", *[F.col(c).alias(f"{c}_a") for c in ("key", "root", "n", "bits", "at")])
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at"))
    longer = F.greatest("n_a", "n")
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda t, k: t + k)
    sizes = (F.col("root_a") != F.col("root")) & (F.col("key_a") < F.col("key")) & (5 * F.least("n_a", "n") >= 4 * longer) & (5 * left >= 4 * longer)
    # texts list their words in one order, so an own bit of both is before the word in both or in neither
    under = lambda i: F.when(F.col("below") >= 64 * (i + 1), F.lit(-1)).when(F.col("below") <= 64 * i, F.lit(0)).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("below") - 64 * i)))
    own = F.zip_with(F.slice("bits_a", 1, OWN // 64), F.slice("bits", 1, OWN // 64), lambda u, v: u.bitwiseAND(v))
    first_shared = ~F.exists(F.transform(own, lambda v, i: v.bitwiseAND(under(i).cast("long"))), lambda v: v != 0)
    both = one.join(first, "word").where(sizes & first_shared & (5 * (F.col("n_a") - only("bits_a", "bits")) >= 4 * longer) & (5 * (F.col("n") - only("bits", "bits_a")) >= 4 * longer))
    missing = F.greatest(only("bits_a", "bits"), only("bits", "bits_a"))
    return both.select(F.col("key_a").alias("a"), F.col("key").alias("b"), missing.alias("missing"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, missing), each told whether it is among the BEST of one of its ends that miss the fewest words: a number linear in the nodes."""
    rank = lambda end: F.row_number().over(Window.partitionBy(end).orderBy("missing", "a", "b"))
    return pairs.withColumn("likely", (rank("a") <= BEST) | (rank("b") <= BEST))


def _apart(pairs: DataFrame, roots: DataFrame, n_roots: int) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda end: beside(roots.select(F.col("node").alias(f"n{end}"), F.col("root").alias(f"r{end}")), n_roots)
    ends = pairs.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
    return ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (doc_id, key), links (a, b, similarity) between keys, and roots (node, root) of the linked keys."""
    sketched = cut(sketches(docs))
    # only the rows of texts that come again are moved to find one of each
    again = cut(sketched.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    again = small_side(again, again.count())
    nodes = sketched.join(again, "key", "left_anti").unionByName(sketched.join(again, "key", "left_semi").dropDuplicates(["key"]).select(*sketched.columns))
    buckets = nodes.select("key", F.col("n_words").alias("size"), F.explode(F.array_distinct("sketch")).alias("t"))
    # near copies agree in many sketches: of buckets that hold the same nodes one is enough, and counts for all
    same = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"h{i}") for i in range(2)]
    shared = buckets.groupBy("t").agg(F.count(F.lit(1)).alias("n"), *same).where("n > 1").groupBy("n", "h0", "h1").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("alike"))
    shared = cut(shared.select("t", "n", "alike"))  # and what it was counted from is gone before buckets move
    every = member = cut(buckets.join(shared, ["t"]))
    popularity = member.groupBy("key").agg(F.sum(F.col("n") * F.col("alike")).alias("popularity"))
    counts = cut(nodes.join(popularity, "key", "left_semi").select("key", F.col("n_words").alias("size"), "cells"))
    n_counts = counts.count()
    size = F.row_number().over(Window.partitionBy("key", F.col("n") > LEADERS[0][0]).orderBy(F.col("n").desc(), "t"))
    member = cut(every.withColumn("nth", size).where((F.col("n") <= LEADERS[0][0]) | (F.col("nth") <= CROWDS)).select("t", "n", "key", "size").join(popularity, "key"))
    n = member.count()
    member = compact(member, n)

    links = docs.sparkSession.createDataFrame([], "a binary, b binary, similarity double")
    roots, tested, used, width = links.select(F.col("a").alias("node"), F.col("b").alias("root")), None, None, 1
    n_links = n_tested = n_used = n_roots = 0

    def take(pairs: DataFrame, n_pairs: int) -> int:
        """Verify pairs, take those that are similar into links and roots, and tell their number."""
        nonlocal links, n_links, roots, n_roots
        possible = _possible(compact(pairs, n_pairs), counts, n_counts, n_pairs)
        more = None if possible.isEmpty() else cut(_verified(possible, docs))
        found = 0 if more is None else more.count()
        if found:
            n_links += found
            links = compact(links.unionByName(more), n_links)
            roots = absorb(roots, n_roots, more)
            n_roots = roots.count()
            roots = compact(roots, n_roots)
        return found

    while True:
        grouped, leaders = _leaders(member, n, roots, used, n_used, width)
        pairs = _candidates(grouped, leaders, n, tested, n_tested)
        n_used += leaders.count()
        mine = leaders.select("t", "leader")
        used = compact(mine if used is None else used.unionByName(mine), n_used)
        n_pairs = pairs.count()
        n_tested += n_pairs
        tested = compact(pairs if tested is None else tested.unionByName(pairs), n_tested)
        found = take(pairs, n_pairs)
        if not found or width == WIDEST:
            break
        width = min(2 * width + 1, WIDEST)
    # CROWDS and LEADERS say what is searched first; all that they leave out follows
    left = cut(_open(every, roots, n_roots))
    pairs = _rest(compact(left.where(F.col("n") <= LEADERS[0][0]), n)).withColumn("missing", F.lit(0))
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    nodes = cut(left.where(F.col("n") > LEADERS[0][0]).select("key", "root").distinct().select(digits("key"), digits("root")))
    n_nodes = nodes.count()
    if n_nodes:
        pairs = pairs.unionByName(_sharing(nodes, n_nodes, docs).select(F.unhex("a").alias("a"), F.unhex("b").alias("b"), "missing"))
        pairs = pairs.groupBy("a", "b").agg(F.max("missing").alias("missing"))
    pairs = cut(pairs.join(beside(tested, n_tested), ["a", "b"], "left_anti"))
    n_pairs = pairs.count()
    if n_pairs > FEW:
        told = cut(_likeliest(pairs))
        first = told.where("likely").select("a", "b")
        take(first, first.count())
        pairs = cut(_apart(told.where("not likely"), roots, n_roots))
        n_pairs = pairs.count()
    take(pairs.select("a", "b"), n_pairs)
    return sketched.select("doc_id", "key"), links, roots


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (its smallest doc_id), class_size, n_links (verified, of its text), kept."""
    members, links, roots = near_links(docs)
    per_key = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    ids = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, F.col("key") == F.col("node"), "left")
    ids = ids.withColumn("root", F.coalesce("root", "key")).join(per_key, "key", "left")
    ids = cut(ids.select("key", "root", "least", "n", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    classes = ids.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    told = ids.join(classes, "root").select("key", "class_id", "class_size", "n_links")
    rows = members.join(told, "key")
    once = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("class_id")) == 1
    return rows.select("doc_id", "class_id", "class_size", "n_links", (F.col("doc_id").eqNullSafe(F.col("class_id")) & once).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each class, with all their columns.

    Rows are dropped by the key of their text and their doc_id; only texts in classes of several rows are looked up.
    """
    members, _, roots = near_links(docs)
    ids = members.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, F.col("key") == F.col("node"), "left")
    ids = cut(ids.select("key", F.coalesce("root", "key").alias("root"), "least", "n"))
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "key"))["key"].alias("keeps"), F.sum("n").alias("size")).where("size > 1")
    several = cut(ids.join(best, "root").select(F.col("key").alias("k"), "least", "keeps", F.col("n").alias("copies")))
    side = small_side(several, several.count())
    row = F.struct(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), _key(text_of()).alias("key"))
    judged = rows.join(side, F.col("key") == F.col("k"), "left")
    sure = judged.where("k is null or (key = keeps and copies = 1)").select("row")
    copies = judged.where("key = keeps and copies > 1").where(F.col("id").eqNullSafe(F.col("least"))).groupBy("key").agg(F.first("row").alias("row")).select("row")
    return sure.unionByName(copies).select(*[F.col(f"row.__{i}").alias(c) for i, c in enumerate(docs.columns)])
