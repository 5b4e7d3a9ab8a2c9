"""The pipeline against a brute-force version of its stages."""

import importlib.util
import random
import re
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from kinlattice.llm import exact, mixing, packing, quality
from kinlattice.llm.common import map_arrow
from test_near import similar


def brute(spark, sf_dir):
    """Stage by stage: verdicts by doc_id, then copies, classes, copies taken and pieces, in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.quality_rules(docs).collect() if r["kept"]}
    largest = {}
    for i in sorted(kept):
        largest[rows[i]["text"] or ""] = i
    kept = sorted(largest.values())
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (rows[i]["text"] or "").lower()) for i in kept}
    bags = {i: Counter(w) for i, w in words.items()}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(kept):
        for j in kept[:n]:
            if find(i) != find(j) and similar(words[i], words[j], bags[i], bags[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [i for i in kept if find(i) == i]
    left = docs.where(docs.doc_id.isin(kept))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left).collect()}
    enc = packing.encoder(packing.default_tokenizer())
    ids = {i: [*enc.tokenizer.encode(rows[i]["text"], add_special_tokens=False).ids, 1] for i in copies}
    return kept, copies, ids


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    kept, copies, ids = brute(spark, sf_dir)
    assert kept
    pieces = {}
    for r in out:
        pieces.setdefault((r["doc_id"], r["instance"]), []).append((r["start"], r["ids"]))
    made = [(i, np.frombuffer(b"".join(bytes(x) for _, x in sorted(p)), "<u4").tolist()) for (i, _), p in pieces.items()]
    assert Counter(i for i, _ in made) == {i: c for i, c in copies.items() if c}
    assert all(x == ids[i] for i, x in made)


def test_odd_rows(spark, tmp_path):
    """Null texts, ids and sources, rows repeated in full, a long text and columns with the names that stages use: one document of each text is packed, whole."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)) + "."
    same, long, loose = prose(90), prose(9000), prose(80)
    rows = [(i, prose(70 + i), "en", f"s{i % 3}") for i in range(20)]
    rows += [(100, same, "en", "s0"), (101, same, "en", "s1"), (101, same, "en", "s1"), (102, long, None, None), (None, loose, "en", "s2"), (103, None, "en", "s0"), (None, None, None, None), (104, "", "en", "s1"), (105, "short", "en", "s1")]
    odd = "copies rank pos size draw h t1 keep_id root copy n_words"
    table = spark.createDataFrame([(*r, len(r[1] or ""), *range(11)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in odd.split()))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    packed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed.setdefault((r["doc_id"], r["instance"]), []).append((r["start"], bytes(r["ids"])))
    assert {i for i, _ in packed} <= {*range(20), 101, 102, None}
    assert {101, 102, None} & {i for i, _ in packed} and len({i for i, _ in packed}) > 10
    enc = packing.encoder(packing.default_tokenizer())
    text = {**{r[0]: r[1] for r in rows}, None: loose}
    for (i, _), pieces in packed.items():
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces)), "<u4").tolist() == [*enc.tokenizer.encode(text[i], add_special_tokens=False).ids, 1]


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes and out.count() != docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id")
    rows = quality.quality_rules(docs).join(labels, "doc_id").toPandas()
    fine = rows[(rows.quality == 1) & ~rows.base_failed]
    assert good.count() and fine.kept.mean() > 0.98
    assert rows[rows.quality == 0].kept.mean() < 0.1
    left = exact.drop_copies(docs)
    assert left.count() == docs.select("text").distinct().count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_tasks_give_memory_back(spark):
    """What a task's Arrow data took is the system's again when the task ends, as its worker stays."""

    def own():
        return sum(map(int, re.findall(r"\nPrivate_(?:Clean|Dirty):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))

    def filled(batches):
        for b in batches:
            held = [pc.add(pa.array(np.full(1_000 + 97 * i % 9_000, i)), 1) for i in range(6_000)]
            yield b.slice(0, len(held[:1]))

    frame = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)
    run = map_arrow(frame, filled, "id long")
    before = own()
    assert sum(b.num_rows for b in run([pa.record_batch([[1, 2]], names=["id"])])) == 1
    assert own() - before < 30_000, (before, own())


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d", n)) == list(range(1, 14))
