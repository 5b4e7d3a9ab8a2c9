"""Line deduplication over overlapping windows of three lines.

Lines are the parts of a text between newlines. Each run of three consecutive lines is hashed (128 bits, over the
lines with their newlines). A window that occurs again later, in the order of doc_id and position over the whole corpus,
is a later occurrence; the lines that later occurrences cover, merged, are removed. A removed line
lies in a window whose first occurrence comes earlier, so some copy of every line stays.

First occurrences come from a group-by with partial aggregation, so a window that a third of the documents hold
costs one row per task. Occurrences of repeated windows then join their first one; adaptive execution splits a
hot window's side of that join. Per document, positions are gathered: a document's lines, never a window's documents.

Defined cases: a null text is empty and is kept as it is; a text of fewer than three lines has no windows; rows that share
a doc_id are told apart by a hash of their text, and of rows that repeat in doc_id and text one comes first and the others lose all their lines;
null doc_ids come last; very long texts are cut into lines whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
Windows are equal if their 128-bit hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, small_side, text_of

WINDOW = 3
#: Copies of one row that one block makes.
COPIES = 100_000


def _window_hashes(lines: Column) -> Column:
    """array<struct<i, a, b>>: the position and the 128-bit hash of every window."""

    def one(i: Column) -> Column:
        window = [F.get(lines, i + j) for j in range(WINDOW)]
        return F.struct(i.cast("int").alias("i"), F.xxhash64(*window).alias("a"), F.xxhash64(F.lit("second"), *reversed(window)).alias("b"))

    return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), one)).otherwise(F.array().cast("array<struct<i:int,a:bigint,b:bigint>>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, h, starts: per row with any, the sorted positions of its windows that occurred before."""
    windows = _keyed(docs).select("doc_id", "h", F.explode(let(F.split("text", "\n", -1), _window_hashes)).alias("w")).select("doc_id", "h", "w.i", "w.a", "w.b")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "i")
    first = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(first, ["a", "b"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("i")).alias("starts"))


def _with_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, h, text, n_lines) with copy: true in all but one of the rows that are equal in doc_id and text.

    Only rows that have such an equal are moved: each task sends one of them and their number, and copies are made again from the number, without
    texts that lose all lines, in blocks dealt out over tasks.
    """
    repeated = cut(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n"))
    n = repeated.count()
    first = rows.withColumn("copy", F.lit(False))
    if not n:
        return first
    match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    side = small_side(repeated, n)
    one = rows.join(side, match).groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.min("n_lines").alias("n_lines"), F.min("n").alias("n"))
    one = cut(one.withColumn("copy", F.lit(False)))
    # every window of a copy occurred before
    bare = F.when(F.col("n_lines") < WINDOW, F.col("text"))
    blocks = one.select("doc_id", "h", bare.alias("text"), "n_lines", (F.col("n") - 1).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / COPIES))).alias("block"))
    size = F.least(F.lit(COPIES).cast("long"), F.col("left") - F.col("block") * COPIES)
    copies = blocks.withColumn("size", size).repartition("doc_id", "h", "block").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))))
    copies = copies.select("doc_id", "h", "text", "n_lines", F.lit(True).alias("copy"))
    return first.join(side, match, "left_anti").unionByName(one.drop("n")).unionByName(copies)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text: what is left of every text."""
    found = cut(later_windows(docs))
    size = found.agg(F.sum(F.size("starts") + 1)).first()[0] or 0
    side = small_side(found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "starts"), size)
    lines = F.split("text", "\n", -1)
    rows = _with_copies(_keyed(docs).withColumn("n_lines", F.size(lines).cast("long"))).join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    n_lines = F.col("n_lines")
    emptied = F.col("copy") & (n_lines >= WINDOW)
    touched = F.col("starts").isNotNull()
    kept = let(lines, lambda x: let(_marks(F.col("starts"), F.size(x)), lambda gone: F.filter(x, lambda _, i: ~F.get(gone, i))))
    rows = rows.withColumn("left", F.when(emptied, F.array().cast("array<string>")).when(touched, kept))
    changed = F.col("left").isNotNull()
    return rows.select("doc_id", n_lines.alias("n_lines"), F.when(changed, n_lines - F.size("left")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(changed, F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"))


def _marks(starts: Column, n: Column) -> Column:
    """array<boolean> of n: is the position inside a window that starts at one of the sorted starts.

    One pass: the state is the array so far; between windows come runs of false, inside them runs of true.
    """
    gaps = F.zip_with(F.concat(F.array(F.lit(-WINDOW)), starts), F.concat(starts, F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = F.transform(
        gaps,
        lambda g: F.concat(
            F.array_repeat(F.lit(True), F.when(g["a"] < 0, F.lit(0)).otherwise(F.least(F.lit(WINDOW), g["b"] - g["a"]))),
            F.array_repeat(F.lit(False), F.greatest(F.lit(0), g["b"] - g["a"] - WINDOW)),
        ),
    )
    return F.flatten(parts)


def line_digests(docs: DataFrame) -> DataFrame:
    """line_dedup with the sha256 of what is left in place of the text."""
    return line_dedup(docs).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")
