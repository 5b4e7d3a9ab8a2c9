"""Quality rules whose thresholds come from the corpus itself (native DataFrame code only).

Every document gets four ratios in thousandths. Over those that pass the base rules, for each language and source, each ratio is summed
up in a mergeable quantile sketch: a histogram over buckets of bounded relative width (a bucket
keeps the leading bits of the number, so its width is at most 1/32 of its value). Such
sketches merge by adding counts, which is what a group-by with partial aggregation does: the
shuffle carries one row per task, group, ratio and occupied bucket however many rows a group has, and
the result doesn't depend on the order of rows. Quantiles are read from the sketch with a running sum
over its buckets.

Sketches are merged by weight, without a least size at which a group counts: to a source's documents come ``PRIOR`` documents spread
as those of its language, and to a language's as many spread as those of the corpus. So a source of ten documents has nearly the
quantiles of its language, and one of a million its own.

Bounds. A mean word length is out of bounds if it is further from the median than ``WIDE`` times the distance of the quartiles and
one bucket. The other
ratios count what is unwanted, and in most sources most documents have none of it, so the quartiles of all documents may be 0; then the
quantiles of the non-zero part tell what is usual where it occurs at all. Their bound is the larger of upper quartile + ``SPREAD`` * (upper quartile - median)
and a multiple of a quantile of the non-zero part (see ``RATIOS``: symbols are tolerated up to half of the lower quartile, repeated lines and words
up to a multiple of the upper one). A source full of junk can't lift its own bounds out of reach: none is more than
``REACH`` times that of the whole corpus.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources form
groups of their own; ties fall in one bucket and repeated rows count each; very long texts are measured whole; an empty table gives an empty result; columns
other than doc_id, text, lang and source, whatever their names, are ignored (``filter_documents`` returns them unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, small_side, text_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Ratio -> (numerator, denominator, quarter of the non-zero part, its multiple, and that by which it is divided).
RATIOS = {
    "word_length": ("word_chars", "n_words", 2, 0, 1),
    "symbols": ("n_symbols", "n_words", 1, 1, 2),
    "dup_lines": ("n_dup_lines", "n_lines", 3, 2, 1),
    "repeats": ("n_repeat_words", "n_words", 3, 8, 1),
}
PRIOR = 100
WIDE = 5
SPREAD = 12
REACH = 2
FINE_BITS = 6
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only texts in which some hash repeats go on to sort (hash, position)
    pairs; equal neighbours mark the repeated positions, and windows that overlap count their words once.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def repeated(pairs: Column) -> Column:
        same = lambda s, i: F.coalesce(F.get(pairs, i)["h"] == s["h"], F.lit(False))
        marked = F.filter(pairs, lambda s, i: same(s, i - 1) | same(s, i + 1))
        return let(F.sort_array(F.transform(marked, lambda s: s["i"])), covered)

    def hashed(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    def windows(w: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(rows, hashed))

    return let(words, windows)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, lang, source, the columns of keep, and the counts of every whole text; one narrow pass."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        *keep,
        let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    ).select(
        "doc_id",
        "lang",
        "source",
        *keep,
        F.col("w.n").alias("n_words"),
        F.col("w.c").alias("word_chars"),
        "n_symbols",
        F.col("l.d").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name][:2]
    return F.when(F.col(bottom) > 0, F.floor(F.col(top) * 1000 / F.col(bottom))).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """The value with all but its FINE_BITS leading bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - FINE_BITS, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return (value - value % step).cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: the mergeable sketches of the documents that pass the base rules, one per language, source and ratio."""
    pairs = F.array(*[F.struct(F.lit(n).alias("ratio"), bucket(ratio(n)).alias("bucket")) for n in RATIOS])
    return measured.where(~base_failed()).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.ratio", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def _merged(own: DataFrame, keys: list[str], wider: DataFrame, on: list[str]) -> DataFrame:
    """keys, ratio, bucket, weight: own (keys, ratio, bucket, weight), and PRIOR documents of a thousand each for every group of keys, spread as the wider sketches.

    wider: on, ratio, bucket, weight. A group's ratio meets the wider buckets of that ratio, which are some hundreds.
    """
    share = wider.withColumn("total", F.sum("weight").over(Window.partitionBy(*on, "ratio")))
    share = share.select(*[F.col(k).alias(f"w_{k}") for k in on], F.col("ratio").alias("w_ratio"), "bucket", F.floor(F.col("weight").cast("double") * float(1000 * PRIOR) / F.col("total").cast("double")).cast("long").alias("weight"))
    share = cut(share)
    match = F.col("ratio") == F.col("w_ratio")
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    prior = own.select(*keys, "ratio").distinct().join(small_side(share, share.count()), match).select(*keys, "ratio", "bucket", "weight")
    return own.unionByName(prior).groupBy(*keys, "ratio", "bucket").agg(F.sum("weight").alias("weight"))


def _bounds(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and for each ratio low_, high_ (long): what a document may have, from weighted sketches."""
    group = Window.partitionBy(*keys, "ratio")
    zero = F.sum(F.when(F.col("bucket") == 0, F.col("weight")).otherwise(F.lit(0)))
    run = sketches.select(*keys, "ratio", "bucket", F.sum("weight").over(group.orderBy("bucket")).alias("upto"), F.sum("weight").over(group).alias("total"), zero.over(group).alias("zero"))
    quarter = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    own = lambda i: F.element_at(F.create_map(*[x for n, r in RATIOS.items() for x in (F.lit(n), F.lit(r[i]))]), F.col("ratio"))
    usual = F.min(F.when((F.col("bucket") > 0) & ((F.col("upto") - F.col("zero")) * 4 >= (F.col("total") - F.col("zero")) * own(2)), F.col("bucket")))
    marks = run.groupBy(*keys, "ratio").agg(quarter(1).alias("low"), quarter(2).alias("mid"), quarter(3).alias("high"), usual.alias("usual"))
    apart = WIDE * (F.col("high") - F.col("low") + F.floor(F.col("mid") / 32))
    unwanted = F.greatest(F.col("high") + SPREAD * (F.col("high") - F.col("mid")), F.floor(F.coalesce("usual", F.lit(0)) * own(3) / own(4)))
    length = F.col("ratio") == "word_length"
    marks = marks.select(*keys, "ratio", "mid", F.when(length, apart).otherwise(unwanted).cast("long").alias("reach"))
    return marks


def thresholds(measured: DataFrame) -> DataFrame:
    """t_lang, t_source, and what each ratio must not be below (min_word_length) or above (max_...): one row per language and source."""
    fine = cut(sketch(measured)).withColumn("weight", F.col("n") * 1000).drop("n")
    coarse = fine.groupBy("ratio", "bucket").agg(F.sum("weight").alias("weight"))
    langs = cut(_merged(fine.groupBy("lang", "ratio", "bucket").agg(F.sum("weight").alias("weight")), ["lang"], coarse, []))
    own = _bounds(_merged(fine, ["lang", "source"], langs, ["lang"]), ["lang", "source"])
    # at most one row per ratio
    most = F.broadcast(_bounds(coarse, []).select(F.col("ratio").alias("r"), (F.col("reach") * REACH).alias("most")))
    own = own.join(most, F.col("ratio") == F.col("r")).withColumn("reach", F.least("reach", "most"))
    of = lambda n, v: F.max(F.when(F.col("ratio") == n, v))
    length = [of("word_length", F.col("mid") - F.col("reach")).alias("min_word_length"), of("word_length", F.col("mid") + F.col("reach")).alias("max_word_length")]
    return cut(own.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*length, *[of(n, F.col("reach")).alias(f"max_{n}") for n in list(RATIOS)[1:]]))


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """The measured rows with base_failed, the first ratio out of bounds (or null), and kept.

    bounds has one row per language and source; it is counted before it is broadcast.
    """
    joined = measured.join(small_side(bounds, bounds.count()), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    short = F.when(ratio("word_length") < F.col("min_word_length"), F.lit("word_length"))
    reason = F.coalesce(short, *[F.when(ratio(n) > F.col(f"max_{n}"), F.lit(n)) for n in RATIOS])
    return joined.withColumn("base_failed", base_failed()).withColumn("reason", reason).withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, kept and the reason of a rejection (null in those that only fail a base rule)."""
    measured = cut(measure(docs))
    return judge(measured, thresholds(measured)).select("doc_id", *NAMES[:5], "base_failed", "kept", "reason")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Documents are stored beside their counts, so that each text is measured once and none is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)])
    measured = cut(measure(docs.select(row.alias("__row"), "doc_id", "lang", "source", "text"), "__row"))
    kept = judge(measured, thresholds(measured)).where("kept")
    return kept.select(*[F.col(f"__row.__{i}").alias(c) for i, c in enumerate(docs.columns)])
