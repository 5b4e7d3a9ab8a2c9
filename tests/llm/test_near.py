"""Near-duplicate classes against all pairs."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from kinlattice.llm import graph, near

SCHEMA = "doc_id long, text string, key string, root string"


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def distance(a, b):
    """Edits between two lists, row by row over the whole table."""
    a, b = np.asarray(a, dtype=object), np.asarray(b, dtype=object)
    steps = np.arange(len(b) + 1)
    row = steps
    for i, x in enumerate(a, 1):
        now = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (b != x)))
        row = np.minimum.accumulate(now - steps) + steps
    return int(row[-1])


def similar(a, b, bag_a, bag_b):
    longer = max(len(a), len(b))
    if 5 * min(len(a), len(b)) < 4 * longer or 5 * (bag_a & bag_b).total() < 4 * longer:
        return False  # each word more is an edit
    return 5 * distance(a, b) <= longer


def brute(texts):
    """Classes by edit distance over words of all pairs; equal texts are in a class."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    bags = [Counter(w) for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            x, y = sorted((find(i), find(j)))
            if x != y and ((texts[i] or "") == (texts[j] or "") or (words[i] and words[j] and similar(words[i], words[j], bags[i], bags[j]))):
                root[y] = x
    return {i: find(i) for i in range(len(texts))}


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: r for r in near.near_classes(df).collect()}, df


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            w.insert(at, f"new{rng.randrange(99)}")
        elif len(w) > 6:
            del w[at]
    return w


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "", " \n", "one two", "one  Two", "a b c d e", "a b c d e", "a b q d f", "word " * 300, "word " * 290]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([40, 80, 300]))]
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, rng.randint(0, 1 + len(words) // 40))) for _ in range(rng.randint(0, 4))]
        texts += [" ".join(edited(rng, words, len(words) // 2)), f"{passage} {' '.join(rng.choice(vocabulary) for _ in range(150))}"]
        if g == 0:
            texts += [" ".join(edited(rng, words, 1)) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    texts = corpus(seed)
    rows, df = run(spark, texts)
    expected = brute(texts)
    assert {i: r["class_id"] for i, r in rows.items()} == expected
    sizes = defaultdict(int)
    for c in expected.values():
        sizes[c] += 1
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows.values())
    assert {i for i, r in rows.items() if r["kept"]} == set(expected.values())
    left = near.drop_near_copies(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == set(expected.values())


def family(rng, pages=800, groups=3, copies=151, template=250, own=114):
    """Pages of a site that share 250 words and aren't alike, and groups of near copies of further pages."""
    site = [f"t{i}" for i in range(template)]
    page = lambda tag: site + [f"{tag}.{i}" for i in range(own)]
    texts = [page(f"p{i}") for i in range(pages)]
    for g in range(groups):
        first = page(f"g{g}")
        for _ in range(copies):
            w = list(first)
            for _ in range(3):
                w[rng.randrange(template, len(w))] = f"x{rng.randrange(10**9)}"
            texts.append(w)
    rng.shuffle(texts)
    return [" ".join(w) for w in texts]


def test_copies_on_a_template(spark):
    texts = family(random.Random(3), pages=300, copies=100)
    rows, _ = run(spark, texts)
    assert {i: r["class_id"] for i, r in rows.items()} == brute(texts)


def test_pairs_on_a_template(spark):
    texts = family(random.Random(4), pages=0, groups=250, copies=2)
    rows, _ = run(spark, texts)
    assert {i: r["class_id"] for i, r in rows.items()} == brute(texts)


def test_leaders_outside_a_bucket(spark, monkeypatch):
    """y and z are alike and meet only in a bucket of three, each in a component led by a text that is too far from the other."""
    y = [f"w{i}" for i in range(300)]
    swap = lambda w, tag, first: [f"{tag}{i}" if i % 60 == first else x for i, x in enumerate(w)]
    z = swap(y, "z", 10)
    alone = iter(range(1000, 9999))
    # y, z, y0, z0, x, then fillers that make y0, z0 and x popular
    held = [[1, 2], [1, 3], [4, 2], [5, 3], [1, 6]] + [[4, next(alone)] for _ in range(7)] + [[5, next(alone)] for _ in range(7)] + [[next(alone), 6] for _ in range(8)]
    own = [[f"{g}.{i}" for i in range(300)] for g in range(len(held) - 4)]
    texts = [" ".join(w) for w in (y, z, swap(y, "y0", 30), swap(z, "z0", 50), *own)]
    real = near.sketches

    def planted(docs):
        sketch = docs.sparkSession.createDataFrame(list(enumerate(held)), "doc_id long, sketch array<long>")
        return real(docs).drop("sketch").join(sketch, "doc_id")

    monkeypatch.setattr(near, "sketches", planted)
    rows, _ = run(spark, texts)
    assert [rows[i]["class_id"] for i in range(5)] == [0, 0, 0, 0, 4]


def test_possible_pairs_lose_none(spark):
    """Pairs just at the threshold: the bound keeps each, and leaves out unrelated ones."""
    a = np.arange(1, 366, dtype=np.uint64) * near._P
    rows = [("a", 365, near.cells([a])[0].tolist())]
    for i in range(3000):
        b = np.append(a[:292], (np.arange(73, dtype=np.uint64) + np.uint64(1000 + 73 * i)) * near._Q)
        rows.append((f"b{i}", 365, near.cells([b])[0].tolist()))
    rows.append(("z", 365, near.cells([np.append(a[:100], np.arange(9_000_000, 9_000_265, dtype=np.uint64) * near._Q)])[0].tolist()))
    counts = spark.createDataFrame(rows, "key string, size long, cells array<smallint>")
    pairs = counts.where("key <> 'a'").selectExpr("'a' as a", "key as b")
    left = {r["b"] for r in near._possible(pairs, counts, len(rows)).collect()}
    assert left == {f"b{i}" for i in range(3000)}


def test_a_word_that_fills_a_text_leaves_cells(spark):
    """A text that repeats a word 400 times has cells, and the bound from them holds for it and excludes what is too far."""
    tail = ["is"] * 400
    own = [[f"{g}.{i}" for i in range(150)] for g in range(3)]
    texts = [" ".join(w) for w in (own[0] + tail, own[0][:40] + own[1][40:] + tail, own[2] + tail[:300], tail, own[0] + tail[:300])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = near.sketches(df).selectExpr("cast(doc_id as string) as key", "n_words as size", "cells").cache()
    assert counts.where("cells is null").count() == 0
    assert all(sum(r["cells"]) == r["size"] for r in counts.collect())
    pairs = counts.selectExpr("key as a").crossJoin(counts.selectExpr("key as b")).where("a < b")
    # 0 and 1 share 440 of 550 words, 0 and 4 450; all others too few of the longer's
    assert {(r["a"], r["b"]) for r in near._possible(pairs, counts, 5).collect()} == {("0", "1"), ("0", "4")}


def test_pairs_of_one_component_are_spared(spark, monkeypatch):
    """Near copies with a word that fills them: with the likeliest pairs first, classes are those of all pairs and fewer pairs are tested."""
    rng = random.Random(6)
    base = [[f"{g}.{i}" for i in range(60)] for g in range(4)]
    texts = [" ".join([*edited(rng, base[i % 4], rng.randint(6, 14)), *["is"] * 40]) for i in range(120)]
    tested, real = [], near._verified
    monkeypatch.setattr(near, "LEADERS", ((4, 1), (None, 1)))
    monkeypatch.setattr(near, "WIDEST", 1)
    monkeypatch.setattr(near, "_verified", lambda pairs, docs: tested.append(pairs.count()) or real(pairs, docs))
    made = []
    for few in (10**9, 0):
        monkeypatch.setattr(near, "FEW", few)
        tested.clear()
        rows, _ = run(spark, texts)
        assert {i: r["class_id"] for i, r in rows.items()} == brute(texts)
        made.append(sum(tested))
    assert made[1] <= made[0]


def test_prefix_filter_loses_none(spark):
    """All pairs at 0.8 or more of several roots come out of the filter, whatever they agree in."""
    rng = random.Random(9)
    words = [[rng.choice([f"c{i}" for i in range(9)] + [f"w{i}" for i in range(300)]) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    words += [edited(rng, w, rng.randint(0, len(w) // 4)) for w in words for _ in range(2)]
    words = [list(w) for w in {tuple(w) for w in words}]
    texts = [" ".join(w) for w in words]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = docs.selectExpr("md5(text) as key", "cast(doc_id as string) as root")
    key = {hashlib.md5(t.encode()).hexdigest(): i for i, t in enumerate(texts)}
    found = {tuple(sorted((key[r["a"]], key[r["b"]]))) for r in near._sharing(nodes, len(texts), docs).collect()}
    bags = [Counter(w) for w in words]
    expected = {(j, i) for i in range(len(words)) for j in range(i) if similar(words[i], words[j], bags[i], bags[j])}
    assert expected and expected <= found and len(found) < len(words) ** 2 / 4


def test_a_pair_meets_once(spark):
    """Texts that list dozens of words in common come out once a pair and not once a word, and none of them is lost."""
    rng = random.Random(15)
    site = [f"t{i}" for i in range(150)]
    words = [[*site[: 150 - rng.randint(0, 8)], *[f"{i}.{j}" for j in range(20)]] for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    nodes = docs.selectExpr("md5(text) as key", "cast(doc_id as string) as root")
    key = {hashlib.md5(" ".join(w).encode()).hexdigest(): i for i, w in enumerate(words)}
    rows = [tuple(sorted((key[r["a"]], key[r["b"]]))) for r in near._met(nodes, len(words), docs).collect()]
    expected = {(j, i) for i in range(60) for j in range(i) if 5 * len(set(words[i]) & set(words[j])) >= 4 * max(len(words[i]), len(words[j]))}
    assert len(expected) > 1000 and expected <= set(rows) and len(rows) <= 1.1 * len(set(rows))


def test_few_pairs_move_few_cells(spark, monkeypatch):
    """With few pairs only the counts of their ends are joined, and the pairs left are the same."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    texts = [np.append(a[:k], rng.integers(0, 2**63, 100 - k).astype(np.uint64)) for k in (100, 95, 90, 85, 10, 5)]
    rows = [(f"{i}", 100, c.tolist()) for i, c in enumerate(near.cells(texts))]
    counts = spark.createDataFrame(rows, "key string, size long, cells array<smallint>")
    pairs = counts.where("key in ('0', '1', '4')").selectExpr("key as a").crossJoin(counts.where("key < '5'").selectExpr("key as b")).where("a < b")
    told = lambda *n: {(r["a"], r["b"]) for r in near._possible(pairs, counts, *n).collect()}
    before = told(6)
    monkeypatch.setattr(near, "COMPACT_ROWS", 20)
    assert told(6, pairs.count()) == before and ("0", "1") in before and ("0", "4") not in before


@pytest.mark.parametrize("step", [1, 3, 512])
def test_edits_against_the_whole_table(monkeypatch, step):
    monkeypatch.setattr(near, "STEP", step)
    rng = random.Random(step)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(30))]
        b = [int(x) for x in edited(rng, [str(x) for x in a], rng.randrange(9)) if x.isdigit()] if a else [rng.randrange(6) for _ in range(rng.randrange(5))]
        d = distance(a, b)
        for most in (0, 1, 3, 40):
            assert near.edits(np.asarray(a, np.uint64), np.asarray(b, np.uint64), most) == (d if d <= most else None)


def test_very_long_texts():
    """A pair of 100,000 words with a twelfth of them replaced: memory stays linear."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 50_000, dtype=np.uint64)[rng.integers(0, 50_000, 100_000)]
    b = a.copy()
    b[rng.choice(len(a), 8_000, replace=False)] = np.uint64(1 << 60)
    tracemalloc.start()
    s = near.similarity(a, b)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert 0.92 <= s <= 0.921
    assert (near.order_minhash([a]) == near.order_minhash([b])).any()


def test_recall_of_edited_copies(spark):
    """Copies with up to 0.19 of the words edited, against what they were made from: at least 0.9 are in its class."""
    rng = random.Random(12)
    texts, origin = [], {}
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
        first = len(texts)
        texts.append(" ".join(words))
        for _ in range(2):
            origin[len(texts)] = first
            texts.append(" ".join(edited(rng, words, rng.randint(len(words) // 50, 19 * len(words) // 100))))
    rows, _ = run(spark, texts)
    assert np.mean([rows[i]["class_id"] == rows[j]["class_id"] for i, j in origin.items()]) >= 0.9
    assert len({r["class_id"] for r in rows.values()}) >= 150


@pytest.mark.parametrize("words", [100, 300, 1000])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.19])
def test_sketches_of_edited_texts(words, share):
    """Of texts with that share of words replaced at random places, each pair at 0.8 or more, at least 0.9 agree in a sketch."""
    rng = np.random.default_rng(words)
    a = [rng.integers(0, 2**63, words).astype(np.uint64) for _ in range(300)]
    b = [x.copy() for x in a]
    for x in b:
        x[rng.choice(words, int(words * share), replace=False)] = rng.integers(0, 2**63, int(words * share)).astype(np.uint64)
    assert all(near.similarity(x, y) >= 0.8 for x, y in zip(a, b, strict=True))
    sketches = zip(near.order_minhash(a).tolist(), near.order_minhash(b).tolist(), strict=True)
    assert np.mean([bool(set(x) & set(y)) for x, y in sketches]) >= 0.9


def test_sketches_of_short_texts():
    """A text of five words or fewer has one k-mer and one sketch, of six words its two k-mers and their pair once."""
    h = near.word_hashes("a b c d e f g")
    one, two, three = (set(near.order_minhash([h[:n]])[0].tolist()) for n in (5, 6, 7))
    assert len(one) == 1 and len(two) == 1 and len(three) == 3


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    assert {r["doc_id"]: r["class_id"] for r in near.near_classes(docs).collect()} == brute(texts)


def test_odd_rows(spark):
    assert near.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "x y", "k", "r"), (4, "x y", None, None), (4, "x y", None, None), (None, None, None, None), (8, "z", "k", "r")], SCHEMA)
    rows = near.near_classes(df).collect()
    assert len(rows) == 5 and sum(r["kept"] for r in rows) == 3
    assert near.drop_near_copies(df).count() == 3


def test_alignment_is_sensitive_to_order():
    a = np.arange(200, dtype=np.uint64)
    assert near.similarity(a, a) == 1
    assert near.similarity(a, np.concatenate([a[100:], a[:100]])) < near.THRESHOLD
    b = a.copy()
    b[[50, 150]] = 999
    assert near.similarity(a, b) == pytest.approx(0.99)


def test_sketch_depends_on_order():
    a = np.random.default_rng(4).integers(0, 2**63, 100, dtype=np.uint64)
    blocks = np.concatenate([a[50:], a[:50]])
    sketch = near.order_minhash([a, blocks, a[:4], a])
    assert (sketch[0] == sketch[3]).all() and (sketch[0] == near.order_minhash([a])[0]).all()
    # nearly the same runs in another order
    assert (sketch[0] == sketch[1]).mean() < 0.7


def test_components(spark):
    rng = random.Random(5)
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(60) if i % 10] + [(f"x{rng.randrange(40):02}", f"x{rng.randrange(40):02}") for _ in range(30)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == classes(pairs, nodes)
    frame = lambda x: spark.createDataFrame(x, "a string, b string")
    roots = graph.components(frame(pairs[:40]))
    for part in (pairs[40:60], pairs[60:]):
        roots = graph.absorb(roots, roots.count(), frame(part))
    assert {r["node"]: r["root"] for r in roots.collect()} == got
