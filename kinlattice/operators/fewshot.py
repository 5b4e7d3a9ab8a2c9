"""Few-shot examples: rows of the root's type that are older than it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, hash_number, hash_text
from ..plans.shape import with_position
from ..plans.specs import FewShotSpec

RELATION = "fewshot"


def time_ranked(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """row_id, ts, time_rank (dense position in time), n_before (rows strictly older)."""
    ranked = with_position(rows.select(F.col(key).cast("long").alias("row_id"), F.col(ts).alias("ts")), "ts", "row_id", position="time_rank")
    first = ranked.groupBy("ts").agg(F.min("time_rank").alias("n_before"))
    return ranked.join(first, "ts")


def draw(ranked: DataFrame, roots: DataFrame, spec: FewShotSpec) -> DataFrame:
    """root_id, draw, example_id: k * rerank_factor seeded draws with replacement from the rows strictly older.

    roots: row_id. A drawn rank is looked up by an equality join, never by a range join.
    """
    k = spec.k * spec.rerank_factor
    r = roots.select("row_id").join(ranked, "row_id").where("n_before > 0")
    draws = r.select(F.col("row_id").alias("root_id"), "n_before", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw")) if k else r.select(F.col("row_id").alias("root_id"), "n_before", F.lit(0).alias("draw")).limit(0)
    draws = draws.select("root_id", "draw", (hash_number(spec.seed, "root_id", "draw") % F.col("n_before")).alias("time_rank"))
    return draws.join(ranked.select("time_rank", F.col("row_id").alias("example_id")), "time_rank").select("root_id", "draw", "example_id")


def flat_vector(masked: list[int] | None = None) -> Column:
    """The vectors of feats (an array of a vector per column) end to end, those of masked columns as zeros."""
    if not masked:
        return F.flatten("feats")
    hidden = F.array(*[F.lit(i) for i in masked]).cast("array<int>")
    kept = F.transform("feats", lambda v, i: F.when(F.array_contains(hidden, i), F.transform(v, lambda x: x * 0.0)).otherwise(v))
    return F.flatten(kept)


def flat_features(rows: DataFrame, masked: list[int] | None = None) -> DataFrame:
    """row_id, emb of rows (row_id, feats), as flat_vector makes it."""
    return rows.select("row_id", flat_vector(masked).alias("emb"))


def _best(scored: DataFrame, spec: FewShotSpec) -> DataFrame:
    best = Window.partitionBy("root_id").orderBy(F.col("score").desc(), "example_id", "draw")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= spec.k)


def rerank(draws: DataFrame, vectors: DataFrame, spec: FewShotSpec, root_vectors: DataFrame | None = None) -> DataFrame:
    """The k draws of each root most similar to it by dot product; vectors: row_id, emb. Ties go by example_id and draw.

    root_vectors: other vectors for the roots, as of flat_features with the task's masked columns, so that a label doesn't choose its own examples.
    """
    a = (vectors if root_vectors is None else root_vectors).select(F.col("row_id").alias("root_id"), F.col("emb").alias("a"))
    b = vectors.select(F.col("row_id").alias("example_id"), F.col("emb").alias("b"))
    scored = draws.join(a, "root_id").join(b, "example_id").select("root_id", "draw", "example_id", dot(F.col("a"), F.col("b")).alias("score"))
    return _best(scored, spec)


def rerank_rows(draws: DataFrame, rows: DataFrame, encode: Callable[[DataFrame], DataFrame], spec: FewShotSpec, encode_root: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As rerank, with vectors that are made beside the draws: what moves are a row's own few columns, not a vector for each draw.

    rows: row_id and the columns that encode needs; encode: a frame with these columns and others to the same with emb, row by row, without a shuffle. It may leave rows
    out, and their draws with them. encode_root: another for the roots.
    """
    raw = [c for c in rows.columns if c != "row_id"]

    def vectors(pairs: DataFrame, end: str, make: Callable[[DataFrame], DataFrame], name: str, kept: list[str]) -> DataFrame:
        met = pairs.withColumns({c: F.col(f"__{end}")[c] for c in raw}).drop(f"__{end}")
        return make(met).select(*kept, F.col("emb").alias(name))

    side = lambda end: rows.select(F.col("row_id").alias(f"{end}_id"), F.struct(*raw).alias(f"__{end}"))
    pairs = draws.join(side("example"), "example_id").join(side("root"), "root_id")
    keys = ["root_id", "draw", "example_id"]
    half = vectors(pairs, "root", encode_root or encode, "__a", [*keys, "__example"])
    both = vectors(half, "example", encode, "__b", [*keys, "__a"])
    return _best(both.select(*keys, dot(F.col("__a"), F.col("__b")).alias("score")), spec)


def _example(root_type: str) -> Column:
    return hash_text("example", F.lit(root_type), "root_id", "draw")


def example_seeds(examples: DataFrame, roots: DataFrame, root_type: str) -> DataFrame:
    """The examples as instances to sample from: each draw is one, of the root's type, at hop 0 and with the root's cutoff.

    examples: root_id, draw, example_id; roots: the instances that ``sampling.seeds`` made.
    """
    when = roots.select("root_id", "cutoff")
    return examples.join(when, "root_id").select("root_id", _example(root_type).alias("inst_id"), F.lit(None).cast("string").alias("parent_inst"), F.lit(0).alias("hop"), F.lit(root_type).alias("node_type"), F.col("example_id").alias("row_id"), F.lit(None).cast("string").alias("edge_type"), "cutoff")


def link_edges(examples: DataFrame, root_type: str) -> DataFrame:
    """root_id, src_inst, dst_inst, edge_type: each root, as ``sampling.seeds`` names it, to its examples, as ``example_seeds`` does."""
    return examples.select("root_id", hash_text("root", F.lit(root_type), "root_id").alias("src_inst"), _example(root_type).alias("dst_inst"), F.lit(RELATION).alias("edge_type"))


def merge_graphs(main: DataFrame, few: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of the main graph, of the examples' graphs, and between roots and examples."""
    return main.unionByName(few).unionByName(links)
