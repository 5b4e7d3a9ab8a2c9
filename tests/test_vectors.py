"""Vector functions, aggregation and the model against NumPy."""

import numpy as np
import pytest
from kinlattice.functions import scalar
from kinlattice.operators import aggregate, encoders, model, typed
from kinlattice.plans.shape import cut
from kinlattice.plans.specs import ModelSpec
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_functions(spark):
    v = np.array([1.0, -2.0, 4.0])
    assert one(spark, scalar.dot(arr(*v), arr(*v))) == pytest.approx(21)
    assert one(spark, scalar.l2_normalize(arr(*v))) == pytest.approx((v / np.sqrt(21)).tolist())
    assert one(spark, scalar.l2_normalize(arr(0, 0))) == [0, 0]
    assert one(spark, scalar.layer_norm(arr(*v))) == pytest.approx(((v - v.mean()) / np.sqrt(v.var() + 1e-5)).tolist())
    assert one(spark, scalar.cosine_bank(F.lit(7), 4)) == pytest.approx(np.cos(7 * np.logspace(-2, 1, 4)).tolist())
    assert one(spark, scalar.silu(F.lit(2.0))) == pytest.approx(2 / (1 + np.exp(-2)))
    assert one(spark, scalar.one_hot(F.lit(1), 3)) == [False, True, False]
    assert scalar.true_or_false("Yes") and not scalar.true_or_false("0")
    with pytest.raises(ValueError, match="not a boolean"):
        scalar.true_or_false("perhaps")


def test_attention_pool(spark):
    cols, s = F.array(arr(1, 3), arr(5, 7)), arr(0, np.log(3))
    assert one(spark, aggregate.attention_pool(cols, s)) == pytest.approx([4, 6])
    mask = lambda *m: F.array(*[F.lit(x) for x in m])
    assert one(spark, aggregate.attention_pool(cols, s, mask(True, False))) == [5, 7]
    assert one(spark, aggregate.attention_pool(cols, s, mask(True, True))) == [0, 0]


def test_relation_mean_then_max(spark):
    edges = spark.createDataFrame([(0, "placed", 1), (0, "placed", 2), (0, "other", 3)], "center long, rel string, nbr long")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [10.0])], "row_id long, emb array<double>")
    relations = spark.createDataFrame([("placed", [2.0]), ("other", [0.5])], "rel string, w array<double>")
    centers = spark.createDataFrame([(0,), (9,)], "center long")
    assert sorted(tuple(r) for r in aggregate.relation_mean_max(edges, vectors, relations, centers, 1).collect()) == [(0, [5.0]), (9, [0.0])]


def test_dictionary(spark):
    a = spark.createDataFrame([([1, 2],), ([0, 5],), ([1, 2],)], "value array<int>")
    b = spark.createDataFrame([([9, i],) for i in range(4)], "value array<int>")
    codes = encoders.dictionary({"a": a, "b": b})
    rows = sorted((r["column"], list(r["value"]), r["code"]) for r in codes.collect())
    assert [c for *_, c in rows] == [0, 1, 2, 3, 4, 5]
    got = encoders.encode(a, codes, "a")
    assert sorted(r["code"] for r in got.collect()) == [0, 1, 1]
    assert sorted(r["value"] for r in encoders.decode(got.select("code"), codes).collect()) == [[0, 5], [1, 2], [1, 2]]


def test_float_encoder(spark):
    w = encoders.float_weights(9)
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, -2.0)], "k long, v double")
    got = {r["k"]: r["emb"] for r in encoders.float_encoder(df, "k", "v", w).collect()}
    assert np.allclose([got[1], got[2], got[3]], encoders.encode_floats(np.array([0.5, 0.5, -2.0]), w))
    with pytest.raises(TypeError):
        encoders.encode_column(df, "v", 4)
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5)], "k long, v double")
    got = {r["k"]: r["emb"] for r in encoders.float_encoder(odd, "k", "v", w).collect()}
    assert got[1] is None and got[2] is None and np.allclose(got[3], encoders.encode_floats(np.array([0.5]), w))


def test_columns_of_all_types(spark):
    """Whole numbers, booleans, floats, decimals, texts with and without a dictionary and vectors; nulls, NaN and unknown texts are masked, no row is lost."""
    w = encoders.float_weights(4)
    rows = [(1, 7, True, 0.5, 2.5, "red", "a b", [3.0, 4.0, 0.0, 0.0]), (2, None, False, float("nan"), None, "blue", None, None), (3, 7, None, None, 1.0, None, "a b", [0.0, 0.0, 0.0, 0.0]), (4, 0, True, -2.0, 2.5, "green", "c", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, n int, b boolean, x double, y double, colour string, name string, v array<double>").withColumn("y", F.col("y").cast("decimal(9,2)"))
    colours = spark.createDataFrame([("red", [1.0, 0.0, 0.0, 0.0]), ("blue", [0.0, 2.0, 0.0, 0.0])], "value string, emb array<double>")
    names = ["n", "b", "x", "y", "colour", "name", "v"]
    found = {r["row_id"]: r for r in typed.column_vectors(df, names, 4, w, {"colour": colours}, encoders.name_vector).collect()}
    bank, real, name = (lambda n: np.cos(n * np.logspace(-2, 1, 4))), (lambda x: encoders.encode_floats(np.array([x]), w)[0]), (lambda s: encoders.name_vector(s, 4))
    zeros = np.zeros(4)
    want = {
        1: [bank(7), bank(1), real(0.5), real(2.5), [1, 0, 0, 0], name("a b"), [0.6, 0.8, 0, 0]],
        2: [zeros, bank(0), zeros, zeros, [0, 2, 0, 0], zeros, zeros],
        3: [bank(7), zeros, zeros, real(1.0), zeros, name("a b"), zeros],
        4: [bank(0), bank(1), real(-2.0), real(2.5), zeros, name("c"), [1, 0, 0, 0]],
    }
    assert all(np.allclose(found[k]["feats"], want[k]) for k in want) and len(found) == 4
    assert {k: [i for i, m in enumerate(found[k]["mask"]) if m] for k in want} == {1: [], 2: [0, 2, 3, 5, 6], 3: [1, 2, 4], 4: [4]}
    with pytest.raises(Exception, match="of width"):
        typed.column_vectors(df, ["v"], 5).collect()


def test_typed_nodes_and_names(spark):
    nodes = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 5, 1)], "node_type string, row_id long, hop int")
    tables = {"a": typed.FeatureTable(spark.createDataFrame([(1, 3, 4), (2, 5, 6)], "id long, x int, y int"), "id", ("x", "y")), "b": typed.FeatureTable(spark.createDataFrame([(5, 9)], "id long, row_id int"), "id", ("row_id",))}
    found = {(r["node_type"], r["row_id"]): r for r in typed.typed_nodes(nodes, tables, 3, hidden={"a": ("y",)}).collect()}
    bank = lambda n: np.cos(n * np.logspace(-2, 1, 3))
    assert found["a", 1]["mask"] == [False, True] and found["a", 2]["mask"] == [False, False]
    assert np.allclose(found["a", 2]["feats"], [bank(5), bank(6)]) and np.allclose(found["b", 5]["feats"], [bank(9)])
    with pytest.raises(ValueError, match="no feature table"):
        typed.typed_nodes(nodes, {"a": tables["a"]}, 3)
    with pytest.raises(Exception, match="has no row"):
        typed.typed_nodes(nodes.unionByName(nodes.limit(1).withColumn("row_id", F.lit(8).cast("long"))), tables, 3).collect()
    names = spark.createDataFrame([("a", [1.0])], "name string, emb array<double>")
    assert {r["row_id"]: r["emb"] for r in typed.with_vectors(nodes, names, "node_type", required=False).collect()} == {1: [1.0], 2: [1.0], 5: None}
    with pytest.raises(Exception, match="no vector for b"):
        typed.with_vectors(nodes, names, "node_type").collect()


def test_name_vectors(spark):
    got = {r["name"]: r["emb"] for r in encoders.name_vectors(spark.createDataFrame([("a:b:c",), ("x y",), ("x y",)], "name string"), 8).collect()}
    assert set(got) == {"a:b:c", "x y"} and np.linalg.norm(got["x y"]) == pytest.approx(1)


def plain_attention(x, names, mask, queries, w, i, heads):
    """Multi-head attention with one loop for each row, query, head and column."""
    n, c, d = x.shape
    size = d // heads
    out = np.zeros((n, queries.shape[1], d))
    for r in range(n):
        for q in range(queries.shape[1]):
            asked = queries[r, q] @ w[f"{i}.query"]
            for h in range(heads):
                at = slice(h * size, h * size + size)
                weights = {k: np.exp(sum(asked[at] * (names[k] @ w[f"{i}.key"])[at]) / np.sqrt(size)) for k in range(c) if not mask[r, k]}
                for k, v in weights.items():
                    out[r, q, at] += v / sum(weights.values()) * (x[r, k] @ w[f"{i}.value"])[at]
    return out @ w[f"{i}.out"]


def plain_pool(x, names, mask, task, w, i, heads):
    if i == 0:
        return np.mean(plain_attention(x, names, mask, np.tile(names, (len(x), 1, 1)), w, i, heads) @ w["0.lin"], axis=1)
    t = (task - task.mean(1, keepdims=True)) / np.sqrt(task.var(1, keepdims=True) + 1e-5)
    return plain_attention(x, names, mask, t[:, None], w, i, heads)[:, 0] * (t @ w[f"{i}.lin"])


def dense_forward(feats, mask, names, edges, rels, rel_vec, spec, w):
    """The same model on dense arrays, for nodes of one type (arrays) or of several (lists of arrays, nodes numbered type after type)."""
    feats, mask, names = ([v] if isinstance(v, np.ndarray) else v for v in (feats, mask, names))
    n, t, x = sum(map(len, feats)), np.concatenate([np.tile(c.mean(0), (len(f), 1)) for f, c in zip(feats, names, strict=True)]), 0
    ends = np.cumsum([0, *map(len, feats)])
    for i in range(spec.layers):
        x = x + np.concatenate([plain_pool(f, c, m, t[ends[j] : ends[j + 1]], w, i, spec.heads) for j, (f, c, m) in enumerate(zip(feats, names, mask, strict=True))])
        ln = model.layer_norm(x)
        m = model.silu(ln @ w[f"{i}.mlp"])
        y = x + model.silu(ln @ w[f"{i}.mlp2a"]) @ w[f"{i}.mlp2b"]
        for which, gate, src, dst in (("rel", "gate", 0, 2), ("rev", "rev_gate", 2, 0)):
            out = np.full((n, spec.width), -np.inf)
            for c in range(n):
                for r in rels:
                    near = [e[dst] for e in edges if e[src] == c and e[1] == r]
                    if near:
                        out[c] = np.maximum(out[c], m[near].mean(0) * (rel_vec[r] @ w[f"{i}.{which}"] + w[f"{i}.{which}_bias"]))
            out[np.isinf(out)] = 0
            g = model.silu(ln @ w[f"{i}.{gate}"] + w[f"{i}.{gate}_bias"]) @ w[f"{i}.{gate}_out"] if spec.use_gate else 1
            y = y + g * out
        x = y
        if i < spec.layers - 1:
            t = t + model.layer_norm(x) @ w[f"{i}.task"]
    return model.layer_norm(x)


def test_model_forward(spark):
    spec = ModelSpec(width=8, layers=2, heads=2)
    w, rng = model.random_weights(spec), np.random.default_rng(1)
    for k in w:
        if k.endswith("gate_out"):
            w[k] = rng.standard_normal(w[k].shape)
    feats, mask, names = rng.standard_normal((5, 3, 8)), rng.random((5, 3)) < 0.4, rng.standard_normal((3, 8))
    mask[0] = True  # a row whose columns are all masked
    edges = [(0, "a", 1), (0, "a", 2), (0, "b", 3), (4, "b", 0), (4, "b", 0)]
    rel = {"a": rng.standard_normal(8), "b": rng.standard_normal(8)}
    nodes = spark.createDataFrame([(i, feats[i].tolist(), [bool(m) for m in mask[i]]) for i in range(5)], "row_id long, feats array<array<double>>, mask array<boolean>")
    e = spark.createDataFrame(edges, "center long, rel string, nbr long")
    r = spark.createDataFrame([(k, v.tolist()) for k, v in rel.items()], "rel string, emb array<double>")
    got = {x["row_id"]: x["emb"] for x in model.forward(nodes, names.tolist(), e, r, spec, w).collect()}
    assert np.allclose([got[i] for i in range(5)], dense_forward(feats, mask, names, edges, ["a", "b"], rel, spec, w), atol=1e-8)


def test_model_forward_over_several_types(spark):
    """Three node types with other columns each, one of them without edges, messages between types."""
    spec = ModelSpec(width=8, layers=3, heads=2)
    w, rng = model.random_weights(spec, 3), np.random.default_rng(2)
    for k in w:
        if k.endswith("gate_out"):
            w[k] = rng.standard_normal(w[k].shape)
    counts, columns, kinds = [4, 3, 2], [3, 1, 5], ["b", "a", "lone"]
    feats = [rng.standard_normal((n, c, 8)) for n, c in zip(counts, columns, strict=True)]
    mask = [rng.random((n, c)) < 0.3 for n, c in zip(counts, columns, strict=True)]
    mask[1][0] = True
    names = [rng.standard_normal((c, 8)) for c in columns]
    edges = [(0, "r", 4), (0, "r", 5), (0, "s", 1), (4, "s", 0), (5, "r", 6), (3, "s", 3)]
    rel = {"r": rng.standard_normal(8), "s": rng.standard_normal(8)}
    rows = [(j + sum(counts[:i]), k, feats[i][j].tolist(), [bool(m) for m in mask[i][j]]) for i, k in enumerate(kinds) for j in range(counts[i])]
    nodes = spark.createDataFrame(rows, "row_id long, node_type string, feats array<array<double>>, mask array<boolean>").repartition(2, "row_id")
    e = spark.createDataFrame(edges, "center long, rel string, nbr long")
    r = spark.createDataFrame([(k, v.tolist()) for k, v in rel.items()], "rel string, emb array<double>")
    given = {k: c.tolist() for k, c in zip(kinds, names, strict=True)}
    got = {x["row_id"]: x["emb"] for x in model.forward(nodes, given, e, r, spec, w).collect()}
    assert np.allclose([got[i] for i in range(9)], dense_forward(feats, mask, names, edges, ["r", "s"], rel, spec, w), atol=1e-8)
    layers = model.forward(nodes, given, e, r, spec, w, each_layer=True)
    assert layers.count() == 27 and np.allclose({x["row_id"]: x["emb"] for x in layers.where("layer = 2").collect()}[4], got[4])
    own = {x["row_id"]: x["emb"] for x in model.forward(nodes, given, e, r, spec, w, task={"b": names[0].mean(0).tolist()}).collect()}
    assert np.allclose([own[i] for i in range(9)], [got[i] for i in range(9)])
    with pytest.raises(Exception, match="no column names"):
        model.forward(nodes, {"a": given["a"]}, e, r, spec, w).collect()


def test_sums_of_wide_vectors(spark):
    """Means and maxima of 512 numbers over batches of a few rows equal NumPy's, with one shuffle after the join."""
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((40, 512))
    edges = [(int(rng.integers(6)), ["r", "s", "t"][rng.integers(3)], int(rng.integers(40))) for _ in range(400)] + [(None, "r", 1), (2, None, 1)]
    e = spark.createDataFrame(edges, "center long, rel string, nbr long").repartition(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "row_id long, emb array<double>")
    rel = {"r": rng.standard_normal(512), "s": rng.standard_normal(512)}  # t has no vector
    r = spark.createDataFrame([(k, x.tolist()) for k, x in rel.items()], "rel string, w array<double>")
    centers = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 9, 9)], "center long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = aggregate.relation_mean_max(e, v, r, centers, 512)
        got = {x["center"]: np.array(x["v"]) for x in out.collect()}
        means = {(x["center"], x["rel"]): x["v"] for x in aggregate.relation_mean(e, v, 512).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    mean = lambda c, k: np.mean([vectors[n] for a, b, n in edges if (a, b) == (c, k)], axis=0)
    assert set(got) == {0, 1, 2, 3, 4, 9} and not got[9].any()
    for c in range(5):
        assert np.allclose(got[c], np.max([mean(c, k) * rel[k] for k in rel], axis=0))
    assert set(means) == {(a, b) for a, b, _ in edges if a is not None and b is not None} and all(np.allclose(means[k], mean(*k)) for k in means)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(center") - plan.count("hashpartitioning(center", plan.find("Initial Plan") if "Initial Plan" in plan else len(plan)) <= 2  # by center, and the distinct centers


def test_layers_store_no_column_vectors(spark, monkeypatch):
    """What is cut between layers is a node's own vector and task vector, not the vectors of its columns."""
    spec = ModelSpec(width=4, layers=3, heads=2)
    stored = []
    monkeypatch.setattr(model, "cut", lambda df: stored.append(df.columns) or cut(df))
    nodes = spark.createDataFrame([(i, [[float(i)] * 4, [1.0, 2.0, 3.0, float(i)]], [False, i == 2]) for i in range(4)], "row_id long, feats array<array<double>>, mask array<boolean>")
    edges = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (3, "a", 0)], "center long, rel string, nbr long")
    relations = spark.createDataFrame([("a", [1.0, 0.5, 0.0, 1.0])], "rel string, emb array<double>")
    found = model.forward(nodes, [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]], edges, relations, spec, model.random_weights(spec)).collect()
    assert len(found) == 4 and stored and all(set(c) <= {"row_id", "node_type", "x", "t"} for c in stored)
