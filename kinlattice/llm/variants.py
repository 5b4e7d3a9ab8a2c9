"""Spelling variants: words one edit apart, found by bands of their letter-parity masks, and the usual form of each word.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One edit flips at most two bits: an inserted or deleted letter one, a
replaced one two. The mask is split into three bands (code point mod 3), so two words one edit apart agree in a band: in one of three if
a letter is replaced, in one of the first two if a letter is too many. They also agree in length but for that letter, and before or after the middle
of the shorter word, since the edit lies on one side. Words meet if length, band and that half agree; a pair is made where it first agrees, and verified by its edit distance.
Without the halves a bucket holds some hundredth of the words of a length and its pairs grow with the square of the vocabulary; with them nearly all pairs that meet are near.

A form is a near word that occurs ten times as often or more, so chains of forms grow by that factor at each step and end; roots are found by doubling steps.

All of it is DataFrame functions. Counts are aggregated before the shuffle. Only the vocabulary is joined, never the running text.

Defined cases: a null text has no words; a null doc_id hashes as the empty text; repeated rows count each; texts are read whole; of near words that occur equally often
the smallest in code-point order is the form; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as its word.
TIMES = 10
#: One occurrence in so many loses a letter, by the hash of its document and run.
DAMAGED = 31


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc, run: every maximal run of at least that many letters, lower-cased in A-Z; doc is the document's id as text."""
    lower = F.translate(text_of(), UPPER, LOWER)
    found = F.regexp_extract_all(lower, F.lit(rf"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))


def damaged(doc: Column, run: Column) -> Column:
    """run, without one of its letters if the hash of document and run says so."""
    n = F.length(run)

    def word(h: Column) -> Column:
        at = (h % n).cast("int")
        return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)

    return let(F.crc32(F.concat(doc, F.lit(":"), run).cast("binary")), word)


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n of words (word) that are long and frequent enough."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def bands(word: Column) -> list[Column]:
    """The three bands of a word's parity mask. Each letter has its own bit: a-z the lowest nine of a band, U+00C0 to U+00FF the next 22."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c))

    def flipped(mask: Column, c: Column) -> Column:
        place = F.when(c < 128, (c - 97) / 3).otherwise(F.lit(9) + (c - 192) / 3).cast("int")
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))

    def band(k: int) -> Column:
        return F.aggregate(F.filter(codes, lambda c: c % 3 == k), F.lit(0).cast("long"), flipped)

    return [band(k) for k in range(3)]


def _met(words: DataFrame, shorter_by: int, n_bands: int) -> DataFrame:
    """A row for each band and side on which a word can agree with one that has shorter_by letters less."""
    word, length = F.col("word"), F.length("word") - shorter_by
    half = F.floor(length / 2).cast("int")
    sides = [F.substring(word, F.lit(1), half), F.substring(word, half + 1 + shorter_by, F.length(word))]
    places = F.array(
        *[
            F.struct(F.xxhash64(length, F.lit(k), F.col(f"b{k}"), F.lit(s), side).alias("key"), F.lit(k).alias("band"), F.lit(s).alias("side"), sides[0].alias("start"))
            for s, side in enumerate(sides)
            for k in range(n_bands)
        ]
    )
    return words.select("word", "n", "b0", "b1", F.explode(places).alias("p")).select("word", "n", "b0", "b1", "p.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words of a vocabulary (word, n) that one inserted, deleted or replaced letter tells apart, once."""
    masked = words.select("word", "n", *[b.alias(f"b{k}") for k, b in enumerate(bands(F.col("word")))])
    even, longer = _met(masked, 0, 3), _met(masked, 1, 2)
    found = []
    for right, apart in ((even, F.col("x.word") < F.col("y.word")), (longer, F.lit(True))):
        # of the places where two words agree, the first one
        first_band = (F.col("x.band") == 0) | (F.col("x.b0") != F.col("y.b0")) & ((F.col("x.band") == 1) | (F.col("x.b1") != F.col("y.b1")))
        first_side = (F.col("x.side") == 0) | (F.col("x.start") != F.col("y.start"))
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.side") == F.col("y.side"))
        one = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
        met = even.alias("x").join(right.alias("y"), same & apart & first_band & first_side & one)
        found.append(met.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")))
    return found[0].unionByName(found[1])


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n for every word of a vocabulary (word, n)."""
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    links = near_pairs(words).select(F.explode(ends).alias("e")).select("e.*", F.lit(None).cast("long").alias("n"))
    own = words.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), "near"))).alias("best")
    rows = links.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    near_n = -F.col("best").getField("col1")
    usual = near_n >= TIMES * F.col("n")
    return rows.select("word", "n", "n_near", F.when(usual, F.col("best.near")).alias("form"), F.when(usual, near_n).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of each chain of links (word, form) that has no circles; every round doubles the steps taken."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        now = cut(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variant_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents, with occurrences damaged as the contract asks."""
    words = cut(vocabulary(runs(docs).select(damaged(F.col("doc"), F.col("run")).alias("word"))))
    return group_words(words)


def group_words(words: DataFrame) -> DataFrame:
    """The same for a vocabulary (word, n) of lower-case letters a-z and U+00C0 to U+00FF."""
    found = cut(forms(words))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
