"""Mixing sources to target weights by Pareto order sampling (native DataFrame code only).

1. Targets. Sources in code point order weigh 3, 1, 2, repeating, and share ``SHARE`` times all words. A
   target stops at ``MOST`` times its source's words; the excess is reshared by weight. The fixed point
   is min(MOST * words, weight * level), found with running sums over the sources.
2. Expected copies. Within a source a document is expected min(MOST, c * w) times, where w grows with
   the square root of its size, and c is solved from a histogram over size buckets so that the expected words
   equal the target.
3. Certain copies. The whole part of that number is taken for certain.
4. Pareto order sampling of the rest. With inclusion probability p (the fraction) and a random u from
   a hash of doc_id, text, and the number of the row among those equal in source and both, the documents of a source are ranked by (u / (1 - u)) / (p / (1 - p)), and taken in that
   order until the words that remain of the target are filled, to within half a document.

The cut in step 4 is found per source by two levels of histograms over the leading bits of the rank, each
4096 bins wide; only the documents of one of 2^24 bins are sorted. So no source meets in one task, however
large, and the plan is one row per source. Applying it is a narrow map over the documents.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source, ordered last; a
null doc_id is hashed as -1; rows that share a doc_id, or repeat in full, have draws of their own; very long texts are counted whole; an empty
table gives an empty result; other columns, whatever their names, are ignored (``mix_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small_side, text_of
from .quality import bucket

SHARE = 1.5
MOST = 2.0
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
RANK_BITS = 48


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, draw (what the random number is made from) and the columns of keep.

    Only rows that repeat in doc_id, source and text are moved, to be numbered.
    """
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size")
    rows = docs.select("doc_id", "source", size, F.concat_ws("|", F.lit(SEED), F.coalesce("doc_id", F.lit(-1)).cast("string"), F.md5(text_of())).alias("draw"), *keep)
    repeated = cut(rows.groupBy("draw", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("draw").alias("d"), F.col("source").alias("s")))
    n = repeated.count()
    if not n:
        return rows
    match = (F.col("draw") == F.col("d")) & F.col("source").eqNullSafe(F.col("s"))
    nth = F.row_number().over(Window.partitionBy("draw", "source").orderBy("size"))
    some = rows.join(small_side(repeated, n), match, "left_semi").withColumn("draw", F.when(nth == 1, F.col("draw")).otherwise(F.concat_ws("|", "draw", nth.cast("string"))))
    return rows.join(small_side(repeated, n), match, "left_anti").unionByName(some)


def weight(size: Column) -> Column:
    """Whole number near 16 times the root of the size, equal within a size bucket."""
    return F.round(F.lit(16.0) * F.sqrt(bucket(size).cast("double"))).cast("long")


def _rank(draw: Column, p: Column) -> Column:
    """The Pareto rank, squeezed from (0, inf) to RANK_BITS bits in the same order."""
    u = (F.conv(F.substring(F.md5(draw), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << RANK_BITS)
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.floor(odds / (1 + odds) * float(1 << RANK_BITS)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    s = s.withColumn("w", pick.cast("double"))
    s = s.withColumn("full_at", F.lit(MOST) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.lit(SHARE) * F.sum("source_size").over(whole))
    s = s.withColumn("full", F.lit(MOST) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_w"))
    # the first source, in order of filling up, that the level doesn't fill sets the level of all
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(whole)["level"])
    most = F.lit(MOST) * F.col("source_size")
    return s.select("source", "source_size", F.coalesce(F.least(most, F.col("w") * F.col("level")), most).alias("target"))


def _scales(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """aims with scale: the c for which min(MOST, c * weight) copies of each document make the target."""
    h = sized.where("size > 0").groupBy("source", weight(F.col("size")).alias("w")).agg(F.sum("size").alias("words"))
    h = h.join(aims.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("source").orderBy(F.col("w").desc())
    h = h.withColumn("full", F.lit(MOST) * F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    h = h.withColumn("open", F.sum(F.col("w") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    h = h.withColumn("scale", (F.col("target") - F.col("full")) / F.col("open"))
    fits = F.col("scale") * F.col("w") <= MOST
    c = h.groupBy("source").agg(F.max(F.when(fits, F.struct("w", "scale")))["scale"].alias("scale")).withColumnRenamed("source", "s")
    return aims.join(c, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _placed(sized: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """sized with its source's plan, certain copies, inclusion probability p and rank k (null where p is 0)."""
    side = plan.withColumnRenamed("source", "s")
    rows = sized.join(small_side(side, sources), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    expected = F.when(F.col("size") > 0, F.least(F.lit(MOST), F.coalesce(F.col("scale") * weight(F.col("size")), F.lit(MOST)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("e", expected).withColumn("certain", F.floor("e")).withColumn("p", F.col("e") - F.col("certain"))
    return rows.withColumn("k", F.when(F.col("p") > 0, _rank(F.col("draw"), F.col("p"))))


def _boundary(rows: DataFrame, shift: int) -> DataFrame:
    """source, bin, below, rest: the bin of leading bits in which the rest of the target is filled."""
    bins = rows.groupBy("source", "rest", "below", F.shiftright("k", shift).alias("bin")).agg(F.sum("size").alias("words"))
    run = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    return bins.withColumn("upto", run).where("upto > rest and upto - words <= rest").select("source", "rest", "bin", (F.col("upto") - F.col("words")).alias("below"))


def _inside(rows: DataFrame, bins: DataFrame, shift: int, sources: int) -> DataFrame:
    side = bins.select(F.col("source").alias("s"), "rest", "bin", "below")
    match = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("k", shift) == F.col("bin"))
    return rows.join(small_side(side, sources), match).select("doc_id", "source", "size", "k", "rest", "below", "bin")


def plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """One row per source: source, source_size, target, scale, last_k, last_id; and their number.

    A document with a rank is sampled if (k, doc_id) isn't after (last_k, last_id).
    """
    base = cut(_scales(sized, targets(sized)))
    n = base.count()
    rows = _placed(sized, base, n)
    sure = rows.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure")).withColumnRenamed("source", "s")
    rests = cut(base.join(sure, F.col("source").eqNullSafe(F.col("s"))).select("source", (F.col("target") - F.col("sure")).alias("rest")))
    keyed = rows.where("k is not null").select("doc_id", "source", "size", "k")
    with_rest = keyed.join(small_side(rests.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s"))).withColumn("below", F.lit(0).cast("long"))
    first = cut(_boundary(with_rest, RANK_BITS - 12))
    second = cut(_boundary(_inside(keyed, first, RANK_BITS - 12, n), RANK_BITS - 24))
    last = _inside(keyed, second, RANK_BITS - 24, n)
    row_id = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")
    order = Window.partitionBy("source").orderBy("k", row_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = last.withColumn("taken", before + F.col("size") / 2 <= F.col("rest"))
    ends = last.groupBy("source").agg(F.max("bin").alias("bin"), F.max(F.when(F.col("taken"), F.struct("k", row_id.alias("id")))).alias("at"))
    ends = ends.select(F.col("source").alias("s"), F.coalesce("at.k", F.shiftleft("bin", RANK_BITS - 24) - 1).alias("last_k"), F.coalesce("at.id", F.lit(2**63 - 1)).alias("last_id"))
    # no bin overflows: every ranked document is taken
    done = base.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "scale", F.coalesce("last_k", F.lit(1 << RANK_BITS)).alias("last_k"), F.coalesce("last_id", F.lit(2**63 - 1)).alias("last_id"))
    return cut(done), n


def _copies() -> Column:
    row_id = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")
    sampled = (F.col("k") < F.col("last_k")) | ((F.col("k") == F.col("last_k")) & (row_id <= F.col("last_id")))
    return (F.col("certain") + F.when(F.coalesce(sampled, F.lit(False)), F.lit(1)).otherwise(F.lit(0))).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source."""
    sized = cut(_sized(docs))
    made, n = plan(sized)
    rows = _placed(sized, made, n).withColumn("copies", _copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Documents without words carry nothing to weigh and are left out.
    """
    made, n = plan(cut(_sized(docs)))
    row = F.struct(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)])
    sized = _sized(docs.select(row.alias("row"), "doc_id", "source", "text"), "row")
    rows = _placed(sized, made, n).withColumn("copies", _copies()).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"row.__{i}").alias(c) for i, c in enumerate(docs.columns)])
