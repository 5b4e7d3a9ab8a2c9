"""Readers and writers, round trip."""

import json

import numpy as np
import pytest
from kinlattice.operators import ingest
from kinlattice.sources import catalog, datasets, sinks
from pyspark.sql import functions as F


def test_arrays_and_weights(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.array([1.5, 2.5]))
    np.save(tmp_path / "e.npy", np.array([[0, 1, 1], [5, 6, 7]]))
    np.savez(tmp_path / "w.npz", a=np.eye(2))
    assert sorted((r["pos"], r["value"]) for r in catalog.read_array(spark, str(tmp_path / "v.npy")).collect()) == [(0, [1.5]), (1, [2.5])]
    assert sorted(tuple(r) for r in catalog.read_edges(spark, str(tmp_path / "e.npy")).collect()) == [(0, 5), (1, 6), (1, 7)]
    assert catalog.read_weights(spark, str(tmp_path / "w.npz"))["a"].tolist() == [[1, 0], [0, 1]]


def config(**more):
    times = [{"type": "a", "name": "__timestamp__"}, {"type": "b", "name": "__timestamp__"}]
    return {"graph": {"nodes": [{"type": "a", "num": 3}, {"type": "b", "num": 2}], "feature_data": times}, "feature_data": [{"type": "a", "name": "x"}]} | more


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(config()))
    rows = catalog.node_catalogue(spark, catalog.read_catalogue(spark, str(tmp_path / "c.json"))).collect()
    assert sorted(tuple(r) for r in rows) == [("a", 3, 1, True), ("b", 2, 0, True)]
    with pytest.raises(ValueError, match="feature twice"):
        catalog.node_catalogue(spark, config(feature_data=[{"type": "a", "name": "x"}] * 2))
    with pytest.raises(ValueError, match="no time for b"):
        catalog.node_catalogue(spark, {"graph": {"nodes": config()["graph"]["nodes"], "feature_data": [{"type": "a", "name": "__timestamp__"}]}})
    (tmp_path / "g.json").write_text(json.dumps({"g": ["t", "u"], "h": ["v"]}))
    assert catalog.read_task_groups(spark, str(tmp_path / "g.json")).count() == 3


def test_tables_and_columns(spark, sf_dir):
    t = catalog.read_tables(spark, sf_dir, ("nation", "region"))
    assert t["nation"].count() == 25
    assert t["nation"].select(catalog.find_column(t["nation"], "timestamp", required=False).alias("x")).first()["x"] is None
    with pytest.raises(ValueError, match="no column"):
        catalog.find_column(t["nation"], "labels")


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("head of a:r:b", 1, 2), ("tail of a:r:b", 2, 1)], "edge_type string, src long, dst long")
    p = str(tmp_path)
    assert sinks.save_edges(edges, p) and not sinks.save_edges(edges.where("src < 0"), p)
    assert spark.read.parquet(f"{p}/edge").where("edge_type = 'head of a:r:b'").select("src", "dst").first() == (1, 2)
    tasks = spark.createDataFrame([("t", "train", 1), ("t", "test", 2)], "task string, split string, row_id long")
    sinks.save_tasks(tasks, p)
    assert spark.read.parquet(f"{p}/task").where("split = 'test'").first()["row_id"] == 2
    v = spark.createDataFrame([("n", [1.0])], "name string, emb array<double>")
    sinks.save_vectors(v, p, "edge")
    assert catalog.read_vectors(spark, f"{p}/edge").first() == ("n", [1.0])
    sinks.save_features(v, p, "a")
    assert not sinks.save_text_dictionary(v.limit(0), p, "a") and sinks.save_text_dictionary(v, p, "a")
    sinks.save_metadata(v, p, "meta")
    assert spark.read.json(f"{p}/meta").count() == 1
    for _ in range(2):
        sinks.append_metrics(v, f"{p}/log")
    assert spark.read.parquet(f"{p}/log").count() == 2


def test_edge_round_trip_keeps_times(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = ingest.edges_of(orders, "tail of orders:placed_by:customer", "o_custkey", "o_orderkey", "o_orderdate")
    sinks.save_edges(e, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/edge").select("edge_type", "src", "dst", F.col("ts"))
    assert back.exceptAll(e).count() == 0 and back.count() == e.count()


def test_arrays_keep_their_kind(spark, tmp_path):
    p = str(tmp_path)
    np.save(f"{p}/big.npy", np.array([2**60 + 1, -5]))
    np.save(f"{p}/text.npy", np.array(["a", "bc"]))
    np.save(f"{p}/none.npy", np.zeros(0))
    np.save(f"{p}/edges.npy", np.array([[2**60 + 1, 1, 1], [5, 6, 6]]))
    assert [tuple(r) for r in catalog.read_array(spark, f"{p}/big.npy", "long").orderBy("pos").collect()] == [(0, 2**60 + 1), (1, -5)]
    assert [r["value"] for r in catalog.read_array(spark, f"{p}/text.npy", "string").orderBy("pos").collect()] == ["a", "bc"]
    assert catalog.read_array(spark, f"{p}/none.npy").count() == 0
    assert sorted(tuple(r) for r in catalog.read_edges(spark, f"{p}/edges.npy").collect()) == [(1, 6), (1, 6), (2**60 + 1, 5)]


def test_catalogue_edges_and_tasks(spark, tmp_path):
    p = str(tmp_path)
    for name, a in {"ab": [[0, 1], [5, 6]], "aa": [[0], [1]], "pairs": [[3, 1], [4, 0]], "pairs_v": [[5, 1], [6, 0], [7, 2]], "hits": [0, 1, 1], "times": [10, 20], "times_v": [1, 2, 3], "seeds": [0, 2], "y": [0.5, 1.5]}.items():
        np.save(f"{p}/{name}.npy", np.array(a))
    edges = [{"type": t, "path": f"{f}.npy"} for t, f in (("a:r:b", "ab"), ("a:likes:a", "aa"), ("b:reverse_r:a", "ab"), ("a:x-self_loop:a", "aa"))]
    data = lambda **x: [{"data": [{"name": n, "path": f"{f}.npy"} for n, f in x.items()]}]
    held = data(node_pairs="pairs_v", labels="hits", timestamp="times_v")
    fields = {"target_type": "a", "evaluation_metric": "hr@1", "task_type": "retrieval", "num_classes": 3}
    pairs = {"extra_fields": fields | {"name": "kind", "seed_type": "g:a_kind"}, "train_set": data(node_pairs="pairs", timestamp="times"), "validation_set": held, "test_set": held}
    numbers = data(seed_nodes="seeds", labels="y")
    number = {"extra_fields": fields | {"name": "d-size", "seed_type": "a", "task_type": "regression", "evaluation_metric": "rmse"}, "train_set": numbers, "validation_set": numbers, "test_set": numbers}
    other = {"extra_fields": number["extra_fields"] | {"name": "d-x", "seed_type": "b"}} | {k: numbers for k in ("train_set", "validation_set", "test_set")}
    c = {"graph": {"edges": edges}, "tasks": [pairs, number, other]}
    found = sorted(tuple(r) for r in catalog.catalogue_edges(spark, c, p).collect())
    assert found == [("head of a:likes:a", 0, 1), ("head of a:r:b", 0, 5), ("head of a:r:b", 1, 6), ("tail of a:r:b", 5, 0), ("tail of a:r:b", 6, 1)]
    specs = catalog.task_specs(c, {"a": ["a___text_kind", "a___size"]})
    assert [(s.name, s.seed_type, s.allowed_features, s.classes) for s in specs] == [("kind", "a_kind", ("a___size",), 3), ("d-size", "a", ("a___text_kind",), 1)]
    rows = catalog.catalogue_tasks(spark, c, p, [s.name for s in specs])
    assert sorted(tuple(r)[2:] for r in rows.where("task = 'kind' and split = 'train'").collect()) == [(0, 3, 1.0, 10), (1, 4, 0.0, 20)]
    assert sorted(tuple(r)[2:] for r in rows.where("task = 'kind' and split = 'test'").collect()) == [(0, 6, 0.0, 2), (1, 7, 2.0, 3)]
    assert sorted(tuple(r)[2:] for r in rows.where("task = 'd-size' and split = 'valid'").collect()) == [(0, 0, 0.5, None), (1, 2, 1.5, None)]


def test_prepared_data_is_read_back(spark, tmp_path):
    p = str(tmp_path)
    sinks.save_features(spark.createDataFrame([(0, 1.5)], "row_id long, x double"), p, "a")
    sinks.save_features(spark.createDataFrame([(0, 2.5)], "row_id long, x double"), p, "b")
    sinks.save_text_dictionary(spark.createDataFrame([(0, [1.0])], "code long, emb array<double>"), p, "a")
    assert catalog.load_graph(spark, p, ["a"])["a"]["edges"] is None
    sinks.save_edges(spark.createDataFrame([("head of a:r:b", 0, 0), ("tail of a:r:b", 0, 0)], "edge_type string, src long, dst long"), p)
    sinks.save_tasks(spark.createDataFrame([("t", "train", 1), ("u", "test", 2)], "task string, split string, row_id long"), p)
    g = catalog.load_graph(spark, p, ["a", "b"])
    assert g["a"]["features"].first()["x"] == 1.5 and g["a"]["text"].count() == 1 and g["b"]["text"] is None
    assert [r["edge_type"] for r in g["b"]["edges"].collect()] == ["tail of a:r:b"]
    assert catalog.load_tasks(spark, p).where("task = 'u'").first()["row_id"] == 2


def test_best_weights_are_kept(spark, tmp_path):
    p = str(tmp_path / "w.npz")
    save = lambda x, value=None: sinks.save_weights(spark, p, {"a": np.full(2, x)}, value)
    assert save(1.0, -0.5) and not save(2.0, -0.5) and not save(3.0, -0.7)
    assert catalog.read_weights(spark, p)["a"].tolist() == [1.0, 1.0]
    assert save(4.0, -0.1) and save(5.0)
    assert catalog.read_weights(spark, p)["a"].tolist() == [5.0, 5.0]
    assert not (tmp_path / "w.npz.writing").exists()


def prepared(spark, p, types, edges, tasks, vectors, adjacent):
    for t, (n, text) in types.items():
        sinks.save_features(spark.createDataFrame([(i, i % 2) for i in range(n)], "row_id long, text_word long"), p, t)
        sinks.save_text_dictionary(spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(text)], "code long, emb array<double>"), p, t)
    sinks.save_edges(spark.createDataFrame(edges, "edge_type string, src long, dst long"), p)
    sinks.save_tasks(spark.createDataFrame(tasks, "task string, split string, row_id long"), p)
    sinks.save_metadata(spark.createDataFrame([(t, n) for t, (n, _) in types.items()], "node_type string, num long"), p, "metanode")
    sinks.save_metadata(spark.createDataFrame(adjacent, "node_type string, edges array<string>"), p, "metaadj")
    for part in datasets.VECTORS[:2]:
        sinks.save_vectors(spark.createDataFrame(vectors, "name string, emb array<double>"), p, part)


def stored(spark, p):
    """All that a dataset holds, as sorted text."""
    out = {}
    for t, own in datasets.load_dataset(spark, p).items():
        out[t] = [sorted(map(str, df.collect())) if df is not None else None for df in (own.features, own.decoded, own.text, own.edges, own.meta)]
    for part in (*datasets.PARTITIONED, *datasets.VECTORS[:2]):
        df = spark.read.parquet(f"{p}/{part}")
        out[part] = sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    return out


@pytest.fixture
def two(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    prepared(spark, a, {"x": (3, [1, 2]), "y": (2, [5])}, [("head of x:r:y", 0, 1), ("tail of x:r:y", 1, 0)], [("t", "train", 1), ("u", "test", 2)], [("n", [1.0]), ("m", [2.0])], [("x", ["head of x:r:y"])])
    prepared(spark, b, {"x": (4, [7, 8]), "z": (1, [])}, [("head of x:r:y", 9, 9), ("head of x:s:z", 0, 0)], [("u", "valid", 3)], [("n", [1.0 + 1e-7]), ("o", [3.0])], [("x", ["head of x:s:z"]), ("z", [])])
    return a, b, str(tmp_path / "out")


def test_datasets_are_merged_whole(spark, two):
    a, b, out = two
    report = datasets.merge_datasets(spark, a, b, out)
    assert {(r["part"], r["key"], r["what"]) for r in report.collect()} == {("metanode", "x", "num"), ("metaadj", "x", "edges"), ("node", "x", "replaced")}
    got = datasets.load_dataset(spark, out)
    assert sorted(got) == ["x", "y", "z"] and got["x"].features.count() == 4 and got["y"].features.count() == 2
    assert sorted(r["text_word"] for r in got["x"].decoded.collect()) == [[7.0], [7.0], [8.0], [8.0]] and got["z"].text is None
    assert got["x"].meta.first()["num"] == 4 and got["x"].meta.first()["edges"] == ["head of x:s:z"] and got["y"].meta.first()["edges"] is None
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/edge").select("edge_type", "src").collect()) == [("head of x:r:y", 9), ("head of x:s:z", 0), ("tail of x:r:y", 1)]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/task").select("task", "split", "row_id").collect()) == [("t", "train", 1), ("u", "valid", 3)]
    assert {r["name"] for r in spark.read.parquet(f"{out}/edge_name").collect()} == {"m", "n", "o"}
    with pytest.raises(ValueError, match="exists"):
        datasets.merge_datasets(spark, a, b, out)


def test_a_crashed_merge_is_run_again(spark, two, monkeypatch):
    """A run that dies between parts, or between the renames, leaves the old dataset or none; the next one gives what one run gives."""
    a, b, out = two
    datasets.merge_datasets(spark, a, b, out)
    whole = stored(spark, out)
    datasets.merge_datasets(spark, a, b, out + "2")
    assert stored(spark, out + "2") == whole
    real = datasets._staged

    def dies(spark, a, b, stage):
        spark.read.parquet(f"{a}/node/x/feat").write.parquet(f"{stage}/node/x/feat")
        raise RuntimeError("gone")

    monkeypatch.setattr(datasets, "_staged", dies)
    with pytest.raises(RuntimeError):
        datasets.merge_datasets(spark, a, b, out + "3")
    assert datasets.children(spark, out + "3") == []
    monkeypatch.setattr(datasets, "_staged", real)
    datasets.merge_datasets(spark, a, b, out + "3")
    assert stored(spark, out + "3") == whole
    store, at = datasets._store(spark, out)  # the old one is aside, the new one isn't there yet
    before = stored(spark, b)
    datasets.merge_datasets(spark, out, a, out + "4")
    store.rename(at, datasets._store(spark, out + ".replaced")[1])
    datasets.merge_datasets(spark, b, b, out, replace=True)
    assert stored(spark, out) == before and datasets.children(spark, out + ".replaced") == []
    datasets.merge_datasets(spark, a, out, out, replace=True)
    assert stored(spark, out) == whole


def test_vectors_that_disagree_stop_a_merge(spark, two):
    a, b, out = two
    sinks.save_vectors(spark.createDataFrame([("n", [1.5]), ("m", [2.0, 3.0])], "name string, emb array<double>"), b, "feature_name")
    with pytest.raises(ValueError, match="vectors disagree: feature_name m, feature_name n"):
        datasets.merge_datasets(spark, a, b, out)
    assert datasets.children(spark, out) == [] and datasets.children(spark, out + ".merging") == []
