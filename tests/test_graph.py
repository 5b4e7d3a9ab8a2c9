"""The semantics of the graph operators on a hand-built graph."""

import random
from datetime import datetime, timedelta

import pytest
from kinlattice.operators import adjacency, fewshot, homogeneous, ingest, merge, metrics, sampling, tasks
from kinlattice.plans.shape import with_position
from kinlattice.plans.specs import BatchSpec, FewShotSpec, SampleSpec, TaskSpec
from pyspark.sql import functions as F

T0 = datetime(2020, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(seconds=n)


@pytest.fixture(scope="module")
def graph(spark):
    orders = spark.createDataFrame([(i, c, at(t)) for i, c, t in [(0, 0, 10), (1, 0, 20), (2, 0, 30), (3, 1, 20)]], "id long, cust long, ts timestamp_ntz")
    lines = spark.createDataFrame([(i, o, at(t)) for i, o, t in [(0, 0, 12), (1, 0, 25), (2, 1, 5), (3, 3, 20)]], "id long, ord long, ts timestamp_ntz")
    c2o = ingest.edges_of(orders, "tail of o:by:c", "cust", "id", "ts")
    o2l = ingest.edges_of(lines, "tail of l:of:o", "ord", "id", "ts")
    o2c = ingest.edges_of(orders, "head of o:by:c", "id", "cust")
    return {"orders": orders, "c2o": c2o, "o2l": o2l, "o2c": o2c}


def roots(spark, *pairs):
    df = spark.createDataFrame([(c, at(t)) for c, t in pairs], "id long, cut timestamp_ntz")
    return sampling.seeds(df, "c", "id", "cut")


def ids(df, hop):
    return sorted(r["row_id"] for r in df.where(F.col("hop") == hop).collect())


@pytest.mark.parametrize(("customer", "cutoff", "expected"), [(0, 20, [0]), (1, 20, []), (2, 20, []), (0, None, [0, 1, 2])])
def test_one_hop(spark, graph, customer, cutoff, expected):
    s = sampling.sample(roots(spark, (customer, cutoff)), "c", {("c", "by", "o"): graph["c2o"]}, SampleSpec(hops=1, fanout=5))
    assert ids(s, 1) == expected and ids(s, 0) == [customer]


def test_two_hops_keep_the_roots_cutoff(spark, graph):
    edges = {("c", "by", "o"): graph["c2o"], ("o", "of", "l"): graph["o2l"]}
    s = sampling.sample(roots(spark, (0, 20)), "c", edges, SampleSpec(hops=2, fanout=5))
    assert ids(s, 1) == [0] and ids(s, 2) == [0]


@pytest.mark.parametrize("fanout", [2, 5, None])
def test_fanout(spark, graph, fanout):
    draw = lambda: ids(sampling.sample(roots(spark, (0, None)), "c", {("c", "by", "o"): graph["c2o"]}, SampleSpec(hops=1, fanout=fanout)), 1)
    one = draw()
    assert len(set(one)) == len(one) == min(3, fanout or 3) and one == draw()


def test_a_row_reached_again_is_another_instance(spark, graph):
    edges = {("c", "by", "o"): graph["c2o"], ("o", "by", "c"): graph["o2c"]}
    s = sampling.sample(roots(spark, (0, None)), "c", edges, SampleSpec(hops=2, fanout=None)).collect()
    back = [r for r in s if r["hop"] == 2]
    assert [r["row_id"] for r in back] == [0, 0, 0] and len({r["inst_id"] for r in s}) == len(s)
    parents = {r["inst_id"] for r in s}
    assert all(r["parent_inst"] in parents for r in s if r["hop"])


def test_walls_and_no_hops(spark, graph):
    edges = {("c", "by", "o"): graph["c2o"]}
    assert sampling.sample(roots(spark, (0, None)), "c", edges, SampleSpec(hops=1), frozenset({"c"})).count() == 1
    assert sampling.sample(roots(spark, (0, None)), "c", edges, SampleSpec(hops=0)).count() == 1
    assert sampling.sample(roots(spark, (0, None)), "c", edges, SampleSpec(hops=3)).count() == 4


def test_sampling_bounds_on_fixtures(spark, sf_dir):
    from kinlattice.plans import queries

    two = queries.neighbor_sample_2hop(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), "o_orderdate")
    late = two.where("node_type = 'orders'").join(orders, "row_id").where("o_orderdate >= cutoff").count()
    assert late == 0
    assert two.where("hop > 0").groupBy("parent_inst", "edge_type").count().agg(F.max("count")).first()[0] <= 5
    was = spark.conf.get("spark.sql.shuffle.partitions")
    rows = sorted(map(str, two.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert sorted(map(str, queries.neighbor_sample_2hop(spark, sf_dir).collect())) == rows
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.fixture(scope="module")
def hub(spark):
    """A source with 2,000 neighbours at 700 times, some without one and some parallel, one with 3, and 60 roots with cutoffs on, between and beyond these times."""
    rng = random.Random(1)
    rows = [("tail of o:by:c", 0, rng.randrange(500), at(None if i % 40 == 0 else rng.randrange(700) * 2)) for i in range(2000)] + [("tail of o:by:c", 1, i, at(i)) for i in range(3)]
    pairs = [(0, t) for t in (-1, 0, 1, 2, 13, 200, 401, 1397, 1398, 5000, None)] * 5 + [(1, t) for t in (0, 2, 9, None)] + [(7, 3)]
    edges = spark.createDataFrame(rows, "edge_type string, src long, dst long, ts timestamp_ntz")
    frontier = spark.createDataFrame([(k, f"i{k}", c, at(t)) for k, (c, t) in enumerate(pairs)], "root_id long, inst_id string, row_id long, cutoff timestamp_ntz")
    older = lambda c, t: [(r[2], r[3]) for r in rows if r[1] == c and (t is None or r[3] is None or r[3] < at(t))]
    return edges, frontier, pairs, older


def test_eligible_neighbours_are_a_counted_prefix(hub):
    edges, frontier, pairs, older = hub
    index = adjacency.adjacency_index(edges)
    assert index.marks.count() == 7
    found = {r["root_id"]: r["n_older"] for r in adjacency.eligible(index, frontier).collect()}
    assert found == {k: len(older(c, t)) for k, (c, t) in enumerate(pairs) if older(c, t)}
    places = sorted((r["src"], r["pos"]) for r in index.edges.collect())
    assert places == [(0, i) for i in range(2000)] + [(1, i) for i in range(3)]


@pytest.mark.parametrize("fanout", [1, 4, 30])
def test_draws_from_a_hub(spark, hub, fanout):
    edges, frontier, pairs, older = hub
    index = adjacency.adjacency_index(edges)
    drawn = sampling.expand(frontier.withColumn("edge_type", F.lit(None).cast("string")), index, "o", SampleSpec(fanout=fanout), 1).collect()
    for k, (c, t) in enumerate(pairs):
        mine = [r for r in drawn if r["root_id"] == k]
        assert len(mine) == min(fanout, len(older(c, t))) == len({r["inst_id"] for r in mine})
        left = [d for d, _ in older(c, t)]
        for r in mine:
            left.remove(r["row_id"])  # never more often than there are edges
    assert len({tuple(sorted(r["row_id"] for r in drawn if r["root_id"] == k)) for k, p in enumerate(pairs) if p == (0, 5000)}) == 5


def test_draws_are_even(spark):
    """Of 10 positions 3 are drawn 20,000 times: each about as often, and each of the 120 sets."""
    n = F.lit(10).cast("long")
    sets = spark.range(20_000).select(F.array_sort(sampling.drawn_positions(n, 3, 42, "id")).alias("s")).groupBy("s").count().collect()
    assert len(sets) == 120 and all(len(set(r["s"])) == 3 for r in sets)
    assert all(100 < r["count"] < 240 for r in sets)


def _joins(df):
    """Rows that the joins of a finished plan made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_a_hub_costs_each_parent_fanout_rows(spark, hub):
    edges, frontier, _, _ = hub
    n = frontier.count()
    made = _joins(sampling.expand(frontier.withColumn("edge_type", F.lit(None).cast("string")), adjacency.adjacency_index(edges), "o", SampleSpec(fanout=3), 1))
    assert made and max(made) <= 3 * n


def test_stored_edges_stay_where_they_are(spark, hub, tmp_path):
    """Draws are joined with bucketed edges, and cutoffs with bucketed leaves, without a shuffle on that side."""
    edges, frontier, _, _ = hub
    index = adjacency.adjacency_index(edges)
    adjacency.save_index(index, "hub", buckets=8, path=str(tmp_path))
    stored = adjacency.load_index(spark, "hub")
    frontier = frontier.withColumn("edge_type", F.lit(None).cast("string"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sampling.expand(frontier, stored, "o", SampleSpec(fanout=5), 1)
        todo, scans = [(out._jdf.queryExecution().executedPlan().inputPlan(), ())], []
        while todo:
            p, above = todo.pop()
            if "Bucketed: true" in p.simpleString(100):
                scans.append(above)
            todo += [(p.children().apply(i), () if "Join" in p.nodeName() else (*above, p.nodeName())) for i in range(p.children().size())]
        assert len(scans) == 2 and not any("Exchange" in name for above in scans for name in above)
        assert sorted(map(str, out.collect())) == sorted(map(str, sampling.expand(frontier, index, "o", SampleSpec(fanout=5), 1).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for part in ("edges", "leaves", "marks"):
            spark.sql(f"DROP TABLE hub_{part}")


def test_plans_of_sampling(spark, sf_dir):
    from kinlattice.plans import queries

    plan = queries.neighbor_sample_1hop(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


@pytest.mark.parametrize("hot_end", [3, 100_000])
def test_one_graph_of_numbers(spark, hot_end):
    """Types end to end, the root's first; ends with many edges are split and numbered the same; an unknown end is an error."""
    nodes = spark.createDataFrame([(t, f"{t}{i}", i % 2, 0, i) for t, n in (("b", 4), ("a", 3), ("c", 2)) for i in range(n)], "node_type string, inst_id string, root_id long, hop int, row_id long")
    pairs = [("b0", f"a{i % 3}", "y") for i in range(9)] + [(f"b{i}", "c1", "x") for i in range(4)] + [("c0", "c0", "z")]
    edges = spark.createDataFrame(pairs, "src_inst string, dst_inst string, edge_type string")
    numbered = homogeneous.numbered_nodes(nodes, "b")
    at_ = {r["inst_id"]: r["node"] for r in numbered.collect()}
    assert sorted(at_, key=at_.get) == ["b0", "b1", "b2", "b3", "a0", "a1", "a2", "c0", "c1"] and sorted(at_.values()) == list(range(9))
    assert {(r["node_type"], r["type_code"]) for r in numbered.collect()} == {("b", 0), ("a", 1), ("c", 2)}
    found = homogeneous.numbered_edges(edges, numbered, hot_end)
    assert sorted(tuple(r) for r in found.collect()) == sorted((at_[a], at_[b], "xyz".index(t), t) for a, b, t in pairs)
    with pytest.raises(Exception, match="no such instance"):
        homogeneous.numbered_edges(edges, numbered.where("inst_id <> 'a1'"), hot_end).collect()


def test_adjacency(spark, graph):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    a = {r["src"]: (r["degree"], r["neighbours"]) for r in ingest.adjacency(nodes, graph["c2o"], "id").collect()}
    assert a == {0: (3, [0, 1, 2]), 1: (1, [3]), 2: (0, [])}
    p = sorted(tuple(r) for r in ingest.pointers(ingest.out_degree(nodes, graph["c2o"], "id")).collect())
    assert p == [(0, 3, 0), (1, 1, 3), (2, 0, 4)]


def test_static_sentinel(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 5)], "node_type string, ts long")
    assert sorted((r["node_type"], r["ts"]) for r in ingest.static_times(df).collect()) == [("a", ingest.STATIC), ("a", ingest.STATIC), ("b", 0), ("b", 5)]


def test_catalogue_errors(spark):
    wrong = spark.createDataFrame([("t", "a", "t___a", "int", True), ("t", "b", "t___b", "int", False)], "node_type string, column string, name string, dtype string, is_target boolean")
    with pytest.raises(Exception, match="exactly one feature"):
        ingest.target_types(wrong).collect()
    twice = spark.createDataFrame([("a:b:c",), ("a:b:c",)], "edge_type string")
    with pytest.raises(Exception, match="edge type twice"):
        ingest.unique_edge_types(ingest.parse_edges(twice)).collect()
    with pytest.raises(Exception, match="not head:name:tail"):
        ingest.parse_edges(spark.createDataFrame([("a:b",)], "edge_type string")).collect()
    with pytest.raises(ValueError, match="task type"):
        TaskSpec("t", "other", "a", "b", "rmse")


def test_few_shot_draws_the_past_only(spark):
    rows = spark.createDataFrame([(i, at(i // 2)) for i in range(10)], "id long, ts timestamp_ntz")
    drawn = fewshot.draw(fewshot.time_ranked(rows, "id", "ts"), rows.select(F.col("id").alias("row_id")), FewShotSpec(k=4)).collect()
    assert all(r["example_id"] // 2 < r["root_id"] // 2 for r in drawn) and len(drawn) == 8 * 4
    assert fewshot.draw(fewshot.time_ranked(rows, "id", "ts"), rows.select(F.col("id").alias("row_id")), FewShotSpec(k=0)).count() == 0


def test_batches(spark):
    rows = spark.createDataFrame([("t", i) for i in range(10)] + [("u", i) for i in range(3)], "task string, row_id long")
    b = tasks.batches(rows, BatchSpec(size=4)).groupBy("task", "batch_id").count().collect()
    assert sorted(tuple(r) for r in b) == [("t", 0, 4), ("t", 1, 4), ("t", 2, 2), ("u", 0, 3)]
    assert tasks.batches(rows, BatchSpec(size=4, ratio=0.5)).count() == 6
    assert tasks.batches(rows, BatchSpec(size=4, number=3, shuffle=True)).count() == 6
    with pytest.raises(Exception, match="fewer than 20 rows"):
        tasks.downsample_absolute(rows, 20).collect()
    with pytest.raises(Exception, match="no ratio for u"):
        tasks.sample_with_replacement(rows, {"t": 1.0}).collect()


def test_metrics(spark):
    r = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "output double, label double")
    assert metrics.compute(r, "rmse").first()[0] == pytest.approx(-(2.5**0.5))
    assert metrics.compute(r, "mae").first()[0] == pytest.approx(-1.5)
    s = spark.createDataFrame([(1, x, y) for x, y in zip([1.0, 2.0, 2.0, 3.0], [0, 0, 1, 1], strict=True)], "k int, score double, positive int")
    assert metrics.auroc(s, ["k"]).first()["auroc"] == pytest.approx(0.875)
    assert metrics.auroc(s.where("positive = 1"), ["k"]).count() == 0
    e = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 3.0)], "task int, epoch int, value double")
    assert tuple(metrics.best_epoch(e, ["task"]).first()) == (1, 2, 3.0)
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.compute(r, "f1")


def test_merge(spark, tmp_path):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    b = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in merge.merge(a, b, ["k"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert [tuple(r) for r in merge.conflicts(a, b, ["k"], ["v"]).collect()] == [("b", "v", "2", "3")]
    va = spark.createDataFrame([("x", [1.0, 2.0])], "name string, emb array<double>")
    vb = spark.createDataFrame([("x", [1.0, 2.5])], "name string, emb array<double>")
    with pytest.raises(Exception, match="vectors disagree"):
        merge.checked_union(va, vb).collect()
    assert merge.checked_union(va, va).count() == 1
    path = str(tmp_path / "t")
    merge.overwrite_partitions(a, path, ["k"])
    merge.overwrite_partitions(b, path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_parallel_edges_are_instances(spark):
    """Row 10 is reached over two edges and owes fanout rows to each of its instances."""
    edge = "head of a:to:a"
    table = spark.createDataFrame([(edge, 1, 10, None), (edge, 1, 10, None), (edge, 1, 11, None), *[(edge, 10, 100 + i, None) for i in range(6)]], "edge_type string, src long, dst long, ts timestamp_ntz")
    roots = sampling.seeds(spark.createDataFrame([(1,)], "id long"), "a", "id")
    rows = sampling.sample(roots, "a", {("a", "a:to:a", "a"): table}, SampleSpec(hops=2, fanout=3)).collect()
    one = [r for r in rows if r["hop"] == 1]
    assert len(one) == len({r["inst_id"] for r in one}) == 3
    two = [r for r in rows if r["hop"] == 2]
    assert len(two) == len({r["inst_id"] for r in two}) == 6


def test_fewshot_edges_end_in_nodes(spark, sf_dir):
    from kinlattice.plans import queries

    main, few, draws = queries.event_graphs(spark, sf_dir)
    nodes = {r["inst_id"] for r in main.unionByName(few).select("inst_id").collect()}
    edges = fewshot.merge_graphs(sampling.sub_edges(main), sampling.sub_edges(few), fewshot.link_edges(draws, "events")).collect()
    assert edges and all(r["src_inst"] in nodes and r["dst_inst"] in nodes for r in edges)
    assert any(r["edge_type"] == fewshot.RELATION for r in edges)


def test_padding(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (None,), (2.0,)], "label double")
    assert sorted(r["label"] for r in metrics.drop_padding(rows, classes=True).collect()) == [0.0, 2.0]
    assert sorted(r["label"] for r in metrics.drop_padding(rows).collect()) == [-1.0, 0.0, 2.0]


def test_auroc_of_probabilities_near_zero(spark):
    """Class 2's positives have p near 1e-10 and its negatives 1e-12: ranked perfectly, though no rounded probability tells them apart."""
    rows = [(i, c, s) for i in range(20) for c, s in enumerate([0.0, -1.0 - i % 2, -23.0 if i < 5 else -28.0])]
    scores = spark.createDataFrame(rows, "row_id long, class_id long, score double")
    labels = spark.createDataFrame([(i, 2 if i < 5 else i % 2) for i in range(20)], "row_id long, label long")
    ranked = metrics.log_softmax(scores).join(labels, "row_id").select("class_id", F.col("log_p").alias("score"), (F.col("class_id") == F.col("label")).cast("int").alias("positive"))
    assert {r["class_id"]: r["auroc"] for r in metrics.auroc(ranked, ["class_id"]).collect()}[2] == 1.0
    two = scores.where("class_id = 2 or class_id = 0").join(labels.where("label <> 1"), "row_id").select("row_id", "class_id", "score")
    assert metrics.multiclass_auroc(two, labels).first()["auroc"] == 1.0


def test_probabilities_rank_as_they_are(spark):
    """Scores in 0 to 1 aren't soft-maxed again: that would exchange these two rows."""
    scores = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.0), (0, 2, 0.5), (1, 0, 0.55), (1, 1, 0.45), (1, 2, 0.0), (2, 0, 0.4), (2, 1, 0.6), (2, 2, 0.0)], "row_id long, class_id long, score double")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "row_id long, label long")
    hand = {0: 0.5, 1: 0.5, 2: 0.25}
    assert metrics.multiclass_auroc(scores, labels).first()["auroc"] == pytest.approx(sum(hand.values()) / 3)
    assert metrics.multiclass_auroc(scores.limit(0), labels).first()["auroc"] is None


def test_folds_over_blocks_of_classes(spark, monkeypatch):
    """Blocks of three classes fold to what all scores give; a label without a class has no score, and is an error in the loss."""
    import numpy as np

    rng = np.random.default_rng(0)
    e, c = rng.standard_normal((30, 4)) * 20, rng.standard_normal((11, 4)) * 20
    c[7] = c[2]  # equal scores: the smaller class wins
    monkeypatch.setattr(metrics, "CLASS_BLOCK", 3)
    seeds = spark.createDataFrame([(i, x.tolist(), i % 11) for i, x in enumerate(e)], "row_id long, emb array<double>, label long")
    classes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "class_id long, emb array<double>")
    s = e @ c.T
    folds = {r["row_id"]: r for r in metrics.class_folds(seeds, classes).collect()}
    top = s.max(1)
    assert [folds[i]["class_id"] for i in range(30)] == s.argmax(1).tolist()
    assert np.allclose([folds[i]["log_total"] for i in range(30)], top + np.log(np.exp(s - top[:, None]).sum(1)))
    assert np.allclose([folds[i]["own"] for i in range(30)], [s[i, i % 11] for i in range(30)])
    assert metrics.compute_folded(seeds, classes, "hr@1").first()[0] == pytest.approx(np.mean(s.argmax(1) == np.arange(30) % 11))
    plan = metrics.compute_folded(seeds, classes, "hr@1")._jdf.queryExecution().executedPlan().toString()
    assert "explode(classes" not in plan
    with pytest.raises(Exception, match="no score"):
        metrics.compute_folded(seeds, classes.where("class_id > 0"), "retrieval_logloss").collect()
    scored = metrics.class_scores(seeds, classes.where("class_id > 0"))
    with pytest.raises(Exception, match="no score"):
        metrics.log_loss(scored, seeds.select("row_id", "label")).collect()


def test_dangling_edges(spark):
    edges = spark.createDataFrame([("e", 1, 2), ("e", 1, 9)], "edge_type string, src long, dst long")
    tails = spark.createDataFrame([(2, at(3))], "id long, ts timestamp_ntz")
    assert {(r["dst"], r["ts"]) for r in ingest.denormalize_times(edges, tails, "id", "ts", dangling="keep").collect()} == {(2, at(3)), (9, None)}
    with pytest.raises(Exception, match="leads to no row: 9"):
        ingest.denormalize_times(edges, tails, "id", "ts").collect()


@pytest.mark.parametrize("last", [1, 3, 50_000])
def test_downsampling_without_a_sort(spark, monkeypatch, last):
    """The rows with the smallest hashes, found by counting leading digits however few rows a last bucket may hold; no range exchange in the plan."""
    import hashlib

    monkeypatch.setattr(tasks, "LAST_BUCKET", last)
    rows = [("a", i) for i in range(3000)] + [("b", i) for i in range(7)] + [("c", 0)]
    df = spark.createDataFrame(rows, "task string, row_id long")
    least = lambda t, k: {(t, i) for i in sorted((i for u, i in rows if u == t), key=lambda i: (hashlib.md5(f"42|{t}|{i}".encode()).hexdigest(), i))[:k]}
    found = tasks.downsample_ratio(df, 0.3)
    assert {tuple(r) for r in found.collect()} == least("a", 900) | least("b", 2) and found.count() == 902
    assert {tuple(r) for r in tasks.downsample_absolute(df.where("task <> 'c'"), 7).collect()} == least("a", 7) | least("b", 7)
    assert {tuple(r) for r in tasks.downsample_ratio(df, 1.0).collect()} == set(rows)
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert tasks.downsample_ratio(df.limit(0), 0.5).count() == 0


def test_rerank_hides_masked_columns(spark):
    """Without its second column root 1 is most like example 2, with it like example 3."""
    rows = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 9.0]]), (2, [[2.0, 0.0], [0.0, 0.0]]), (3, [[1.0, 0.0], [0.0, 9.0]])], "row_id long, feats array<array<double>>")
    draws = spark.createDataFrame([(1, 0, 2), (1, 1, 3)], "root_id long, draw int, example_id long")
    best = lambda *roots: [r["example_id"] for r in fewshot.rerank(draws, fewshot.flat_features(rows), FewShotSpec(k=1, rerank_factor=2), *roots).collect()]
    assert best() == [3] and best(fewshot.flat_features(rows, [1])) == [2]
    near = spark.createDataFrame([(1, [1.0]), (2, [0.5000001]), (3, [0.5])], "row_id long, emb array<double>")
    assert fewshot.rerank(draws.withColumn("example_id", F.lit(5) - F.col("example_id")), near, FewShotSpec(k=1)).first()["example_id"] == 2


def test_positions_need_no_second_shuffle(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "a long, b int").repartition(5)
    found = with_position(rows, "b", "a")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # a window over a range's rows would move them again
    want = {r: i for i, r in enumerate(sorted((b, a) for a, b in map(tuple, rows.collect())))}
    assert all(want[r["b"], r["a"]] == r["pos"] for r in found.collect()) and found.count() == 1000


def test_edges_are_made_twice_only(spark):
    """However often numbered_edges needs them: once for the relations, once with codes."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "src_inst string, dst_inst string, edge_type string"
    nodes = spark.createDataFrame([(f"i{i}", i) for i in range(50)], "inst_id string, node long")
    edges = spark.createDataFrame([(f"i{i % 5}", f"i{i}", f"t{i % 2}") for i in range(50)], kinds).mapInArrow(counted, kinds)
    found = homogeneous.numbered_edges(edges, nodes, hot_end=4).collect()
    assert sorted((r["src"], r["dst"], r["relation"]) for r in found) == sorted((i % 5, i, i % 2) for i in range(50))
    assert seen.value == 100


def test_rerank_with_late_vectors(spark):
    """Vectors made beside the draws choose the same examples, ties and rows without a vector included; no vector is shuffled."""
    spec = FewShotSpec(k=2, rerank_factor=3)
    rows = spark.createDataFrame([(i, i % 4 if i != 7 else None) for i in range(20)], "row_id long, code int")
    draws = spark.createDataFrame([(i, d, (i * 3 + d * d) % 20) for i in range(20) for d in range(6)], "root_id long, draw int, example_id long")
    emb = lambda scale: lambda df: df.where("code is not null").withColumn("emb", F.array(F.col("code") * 1.0, F.lit(2.0), F.col("code") * F.lit(float(scale))))
    vectors = lambda scale: emb(scale)(rows).select("row_id", "emb")
    late = fewshot.rerank_rows(draws, rows, emb(-1), spec, emb(0))
    columns = ["root_id", "draw", "example_id", "score", "rank"]
    assert sorted(map(tuple, late.select(columns).collect())) == sorted(map(tuple, fewshot.rerank(draws, vectors(-1), spec, vectors(0)).select(columns).collect()))
    plan = late._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("__a" in line or "emb" in line for line in joins)
