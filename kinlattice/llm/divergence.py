"""How far the sources of a language differ in their words: an exact divergence of every two sources, and the terms that set a source apart.

Every (language, source) group gives each kept term of its language a whole share p, smoothed, so that a term it lacks has a share too, one share
for all of them. The distance of two groups sums (p - q)^2 / (p + q), rounded down per term, over all kept terms.

Heavy terms, which a quarter of a language's groups or more have, go through dense tiles: a block of terms by a block of groups in NumPy, where each
pair of groups sums whole rows. For rare terms most groups have the share of a term they lack, so their sum is

    terms * f(lack g, lack h)                             for every pair of groups,
    + (f(p, lack h) - f(lack g, lack h)) for each term    that g has, counted by p: how many terms have it doesn't matter to the sum,
    + f(p, r) - f(p, lack h) - f(lack g, r) + f(lack g, lack h) for each term that g and h both have.

All sums are of whole numbers, so the parts add up exactly, in any order.

Counts are aggregated in the task that reads the text. A term's postings (fewer than a quarter of the groups, for a rare one) are joined with each other; the rows are
summed before the shuffle. A tile holds at most TERMS terms by 2 * GROUPS groups. The pairs of a language's groups are the result, so they are made in any case.

Defined cases: null text, lang and source are ''; a row is a document, also if it repeats; a group without terms has shares that lack all; a language without kept terms has the
value 0 for every pair and no terms; ties go by the item's UTF-8 bytes; texts are read whole, in memory linear in the text; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shape import with_position
from .common import cut, map_arrow

#: Documents of a language that must hold a kept term, terms reported per group, and what a share is a part of.
LEAST_DOCUMENTS, REPORTED, WHOLE = 10, 10, 1_000_000_000
#: A term is heavy if so many times its groups are all groups of its language or more.
HEAVY = 4
#: Terms and groups of a tile: 4 MB of shares for each of its two sides.
TERMS, GROUPS = 1024, 512
#: Rows of counts that a task sums up before it hands them on: some 50 MB.
ENTRIES = 1_000_000
#: Rows of groups that may be broadcast, of some 100 bytes each.
FEW_GROUPS = 100_000
COUNTS = ["lang", "source", "term", "n", "n_docs"]

#: Letters in lower case, every byte of a code point beyond ASCII as it is, and blanks for the rest.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(b: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, n_docs of a batch of lang, source, text (as binary)."""
    text = b.column(2) if b.column(2).offset == 0 else pa.concat_arrays([b.column(2)])
    _, offsets, raw = text.buffers()
    clean = pa.Array.from_buffers(pa.string(), len(text), [None, offsets, pa.py_buffer((raw.to_pybytes() if raw else b"").translate(_TABLE))])
    lists = pc.ascii_split_whitespace(clean)
    terms, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(terms), 0)
    found, doc = terms.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)]
    k = max(1, len(found.dictionary))
    lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    per_doc, n = np.unique(doc * k + found.indices.to_numpy(), return_counts=True)
    keys, at = np.unique(group[per_doc // k] * k + per_doc % k, return_inverse=True)
    g = keys // k
    parts = [lang.dictionary.take(pa.array(g // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(g % max(1, len(source.dictionary)))), found.dictionary.take(pa.array(keys % k))]
    return pa.table([*parts, pa.array(np.bincount(at, n, len(keys)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(keys)))], names=COUNTS)


def _summed(t: pa.Table) -> pa.Table:
    return t.group_by(COUNTS[:3], use_threads=False).aggregate([("n", "sum"), ("n_docs", "sum")]).select([*COUNTS[:3], "n_sum", "n_docs_sum"]).rename_columns(COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs: occurrences of every term and documents that have it, per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(_counted(b))
            if sum(map(len, held)) >= ENTRIES:
                held = [_summed(pa.concat_tables(held))]
                if 2 * len(held[0]) >= ENTRIES:
                    yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from _summed(pa.concat_tables(held)).to_batches(max_chunksize=50_000)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COUNTS[:2]], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = map_arrow(rows, run, "lang string, source string, term string, n long, n_docs long")
    # what a task hands on is summed, so it goes straight to the shuffle
    return parts.repartition(*COUNTS[:3]).groupBy(*COUNTS[:3]).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    above = F.lit(WHOLE).cast("decimal(10,0)") * ((F.lit(count) if isinstance(count, int) else count) + 2).cast("decimal(20,0)")
    below = F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _beside(groups: DataFrame, n: int) -> DataFrame:
    """Rows of groups, or fewer, broadcast if their counted number n is small: a language may hold most rows, and nothing should be dealt out by it."""
    return F.broadcast(groups) if n <= FEW_GROUPS else groups


def _tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Postings of kept terms (lang, source, at, term, n_groups, n_sources, lack, p, q), groups (lang, source, at, n_sources, terms, rare, lack) and their number."""
    counts = cut(term_counts(docs))
    per_term = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("n_groups"))
    kept = cut(per_term.where(F.col("n_docs") >= LEAST_DOCUMENTS).drop("n_docs"))
    known = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COUNTS[:2]]).distinct()
    numbered = cut(with_position(known, "lang", "source", position="pos"))
    n = numbered.count()
    langs = numbered.groupBy("lang").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n_sources"))
    rare = F.sum((HEAVY * F.col("n_groups") < F.col("n_sources")).cast("long")).alias("rare")
    by_lang = kept.join(_beside(langs, n), "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"), rare)
    by_lang = langs.join(by_lang, "lang", "left").na.fill(0, ["terms", "lang_total", "rare"])
    held = cut(counts.drop("n_docs").join(kept, ["lang", "term"]))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered.join(_beside(by_lang, n), "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = cut(groups.select("lang", "source", (F.col("pos") - F.col("first")).alias("at"), "n_sources", "terms", "rare", "total", "lang_total", share(0, F.col("total"), F.col("terms")).alias("lack")))
    met = held.join(_beside(groups.select("lang", "source", "at", "n_sources", "terms", "total", "lang_total", "lack"), n), ["lang", "source"])
    postings = met.select("lang", "source", "at", "term", "n_groups", "n_sources", "lack", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    return cut(postings), groups, n


def _tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """lang, lo, hi, value of the pairs of a tile's groups. Rows without a term are the groups, what they have of a term they lack, and the k terms of the block."""
    lang, _, i, j = key
    heads, cells = rows[rows["term"].isna()].sort_values("at"), rows[rows["term"].notna()]
    at, lack = heads["at"].to_numpy(), heads["p"].to_numpy()
    codes, terms = pd.factorize(cells["term"])
    p = np.repeat(lack[:, None], len(terms), axis=1)
    p[np.searchsorted(at, cells["at"].to_numpy()), codes] = cells["p"].to_numpy()
    absent = int(heads["k"].max()) - len(terms)  # terms of the block that no group of the tile has
    first, second = np.flatnonzero(at // GROUPS == i), np.flatnonzero(at // GROUPS == j)
    lo, hi, value = [], [], []
    for a in first:
        others = second[second > a]
        for part in np.array_split(others, max(1, len(others) // 64)):  # 64 rows of a tile at a time stay in cache
            d, d0 = p[part] - p[a], lack[part] - lack[a]
            value.append((d * d // (p[part] + p[a])).sum(axis=1) + absent * (d0 * d0 // (lack[part] + lack[a])))
            lo.append(np.full(len(part), at[a]))
            hi.append(at[part])
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": lang, "lo": joined(lo), "hi": joined(hi), "value": joined(value)})


def _dense(heavy: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """lang, lo, hi, value: sums over heavy terms, per tile."""
    terms = heavy.select("lang", "term").distinct()
    blocks = terms.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TERMS).alias("blocks"))
    n_tiles, block = F.ceil(F.col("n_sources") / GROUPS), F.pmod(F.xxhash64("term"), "blocks").alias("block")
    sizes = terms.join(_beside(blocks, n), "lang").groupBy("lang", block).agg(F.count(F.lit(1)).alias("k"))
    cells = heavy.join(_beside(blocks, n), "lang").select("lang", "at", "term", "p", "n_sources", block, F.lit(None).cast("long").alias("k"))
    heads = sizes.join(_beside(groups, n), "lang").select("lang", "at", F.lit(None).cast("string").alias("term"), F.col("lack").alias("p"), "n_sources", "block", "k")
    own = F.floor(F.col("at") / GROUPS)
    rows = cells.unionByName(heads).select("lang", "block", "at", "term", "p", "k", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)).alias("other"))
    rows = rows.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "at", "term", "p", "k")
    return rows.groupBy("lang", "block", "i", "j").applyInPandas(_tile_sums, "lang string, lo long, hi long, value long")


def _sparse(rare: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """lang, lo, hi, value: what all pairs have by terms that both lack, and corrections for postings."""
    g = groups.select("lang", F.col("at").alias("lo"), F.col("lack").alias("lo_lack"), "rare")
    h = groups.select("lang", F.col("at").alias("hi"), F.col("lack").alias("hi_lack"))
    none = g.join(_beside(h, n), "lang").where("lo < hi").select("lang", "lo", "hi", (F.col("rare") * distance(F.col("lo_lack"), F.col("hi_lack"))).alias("value"))
    counted = rare.groupBy("lang", "at", "p", "lack").agg(F.count(F.lit(1)).alias("k"))
    other = groups.select("lang", F.col("at").alias("to"), F.col("lack").alias("to_lack"))
    others = groups.select("lang", "at").join(_beside(other, n), "lang").where("at <> to")
    one = counted.join(others, ["lang", "at"])
    one = one.select("lang", F.least("at", "to").alias("lo"), F.greatest("at", "to").alias("hi"), (F.col("k") * (distance(F.col("p"), F.col("to_lack")) - distance(F.col("lack"), F.col("to_lack")))).alias("value"))
    x = rare.select("lang", "term", F.col("at").alias("lo"), F.col("p").alias("x"), F.col("lack").alias("x0"))
    y = rare.select("lang", "term", F.col("at").alias("hi"), F.col("p").alias("y"), F.col("lack").alias("y0"))
    f = lambda a, b: distance(F.col(a), F.col(b))
    both = x.join(y, ["lang", "term"]).where("lo < hi").select("lang", "lo", "hi", (f("x", "y") - f("x", "y0") - f("x0", "y") + f("x0", "y0")).alias("value"))
    return none.unionByName(one).unionByName(both)


def pair_distances(postings: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """lang, lo, hi, value for every two groups of a language, by their numbers."""
    heavy = HEAVY * F.col("n_groups") >= F.col("n_sources")
    parts = _sparse(postings.where(~heavy), groups, n).unionByName(_dense(postings.where(heavy), groups, n))
    return parts.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of a group's language by distance, and the terms that set the group apart most."""
    postings, groups, n = _tables(docs)
    pairs = pair_distances(postings, groups, n).select("lang", "value", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("at"), F.col("lo").alias("to")))).alias("e")).select("lang", "value", "e.*")
    named = pairs.join(_beside(groups.select("lang", "at", "source"), n), ["lang", "at"]).join(_beside(groups.select("lang", F.col("at").alias("to"), F.col("source").alias("item")), n), ["lang", "to"])
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(_ranked(named.select("lang", "source", "item", "value")), "pair").unionByName(columns(_ranked(terms).where(F.col("rank") <= REPORTED), "term"))
