"""Two-level relation aggregation on vectors, and attention pooling over columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def long_vectors(df: DataFrame, keys: list[str], emb: str = "emb") -> DataFrame:
    return df.select(*keys, F.posexplode(emb).alias("pos", "x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1)))


def _runs(*codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    new = np.ones(len(codes[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    return np.flatnonzero(new)


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def relation_sums(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """center, rel, sums (array), n: neighbour vectors summed per center and relation within each batch of edges; several rows a group, no shuffle beside the join's.

    edges: center, rel, nbr; vectors: row_id, emb, all of that width.
    """
    x = edges.where("center is not null and rel is not null").join(vectors.select(F.col("row_id").alias("nbr"), scalar.doubles(F.col("emb")).alias("emb")), "nbr").select("center", "rel", "emb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.lexsort((rel := _codes(b.column(1)), center := _codes(b.column(0))))
                starts = _runs(center[order], rel[order])
                at = pa.array(order[starts])
                sums = np.add.reduceat(_matrix(b.column(2), width)[order], starts, axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _lists(sums), pa.array(np.diff(starts, append=len(order)))], ["center", "rel", "sums", "n"])

    return x.mapInArrow(run, f"center {x.schema['center'].dataType.simpleString()}, rel string, sums array<double>, n long")


def _merged(sorted_sums: DataFrame, width: int, finish, schema: str) -> DataFrame:
    """finish(centers, rels, sums, n) over whole centers of rows that are sorted by center and rel. Rows of a group are added up as they come; only a center's sums are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            center, rel, n = (t.column(i).combine_chunks() for i in (0, 1, 3))
            starts = _runs(_codes(center), _codes(rel))
            at, vectors = pa.array(starts), t.column(2).combine_chunks()
            t = pa.table([center.take(at), rel.take(at), _lists(np.add.reduceat(_matrix(vectors, width), starts, axis=0)), pa.array(np.add.reduceat(n.to_numpy(), starts))], names=["center", "rel", "sums", "n"])
            last = int(_runs(_codes(t.column(0).combine_chunks()))[-1])
            if last:
                yield finish(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield finish(held)

    return sorted_sums.mapInArrow(run, schema)


def relation_mean(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """center, rel, v (array): the mean of neighbour vectors per center and relation.

    One vector of sums a group and batch is shuffled, and merged as it comes: width adds to the size of a row, not to the number of aggregates.
    """
    sums = relation_sums(edges, vectors, width)

    def finish(t: pa.Table) -> pa.RecordBatch:
        means = _matrix(t.column(2).combine_chunks(), width) / t.column(3).to_numpy()[:, None]
        return pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks(), _lists(means)], ["center", "rel", "v"])

    return _merged(sums.repartition("center", "rel").sortWithinPartitions("center", "rel"), width, finish, f"center {sums.schema['center'].dataType.simpleString()}, rel string, v array<double>")


def relation_mean_max(edges: DataFrame, vectors: DataFrame, relations: DataFrame, centers: DataFrame, width: int) -> DataFrame:
    """center, v: the largest over relations of mean * relation vector; zeros for a center without neighbours.

    relations: rel, w; one row per relation, listed on the driver. After the join of edges and vectors there is one shuffle, by center: of sums per batch, and of
    the centers themselves. A relation without a vector doesn't count.
    """
    weights = {r["rel"]: np.asarray(r["w"], np.float64) for r in relations.select("rel", scalar.doubles(F.col("w")).alias("w")).collect()}
    sums = relation_sums(edges.where(F.col("rel").isin(list(weights))) if weights else edges.where(F.lit(False)), vectors, width)
    own = centers.select(F.col("center").cast(sums.schema["center"].dataType)).distinct().select("center", F.lit(None).cast("string").alias("rel"), F.array_repeat(F.lit(0.0), width).alias("sums"), F.lit(0).cast("long").alias("n"))

    def finish(t: pa.Table) -> pa.RecordBatch:
        center, n = t.column(0).combine_chunks(), t.column(3).to_numpy()
        scale = np.stack([weights[r] if r is not None else np.zeros(width) for r in t.column(1).to_pylist()])
        scaled = np.where(n[:, None] > 0, _matrix(t.column(2).combine_chunks(), width) / np.maximum(n, 1)[:, None] * scale, -np.inf)
        starts = _runs(_codes(center))
        best = np.maximum.reduceat(scaled, starts, axis=0)
        wanted = np.flatnonzero(np.minimum.reduceat(n, starts) == 0)  # a center of the list has a row of no edges
        best = np.where(np.isneginf(best), 0.0, best)[wanted]
        return pa.RecordBatch.from_arrays([center.take(pa.array(starts[wanted])), _lists(best)], ["center", "v"])

    rows = sums.unionByName(own).repartition("center").sortWithinPartitions("center", "rel")
    return _merged(rows, width, finish, f"center {sums.schema['center'].dataType.simpleString()}, v array<double>")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("nbr").alias("center"), "rel", F.col("center").alias("nbr"))


def attention_pool(columns: Column, scores: Column, masked: Column | None = None) -> Column:
    """The softmax-weighted mean of an array of vectors; masked columns are left out, and all masked gives zeros.

    columns: array<array<double>>; scores: array<double>; masked: array<boolean>.
    """
    width = F.size(F.get(columns, 0))
    items = F.arrays_zip(columns.alias("v"), scores.alias("s"), (masked if masked is not None else F.transform(scores, lambda _: F.lit(False))).alias("m"))
    live = F.filter(items, lambda i: ~i["m"])

    def pooled(rows: Column) -> Column:
        top = F.array_max(F.transform(rows, lambda i: i["s"]))

        def weighted(t: Column) -> Column:
            weights = F.transform(rows, lambda i: F.exp(i["s"] - t))
            return scalar.let(weights, lambda w: F.transform(F.sequence(F.lit(0), width - 1), lambda p: scalar.dot(w, F.transform(rows, lambda i: F.get(i["v"], p))) / scalar.total(w)))

        return F.when(F.size(rows) == 0, F.array_repeat(F.lit(0.0), width)).otherwise(scalar.let(top, weighted))

    return scalar.let(live, pooled)


def column_mean(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, x: the mean over rows of each position."""
    return long_vectors(vectors, keys).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
