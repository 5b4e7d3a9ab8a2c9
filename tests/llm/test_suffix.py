"""The suffix operator against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import pytest
from kinlattice.llm import suffix

SCHEMA = "doc_id long, text string, rank string"


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: tuple(r)[1:] for r in suffix.repeat_digests(df).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def made(seed, n=40, alphabet="ab é\n", words=None):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice([50, 199, 200, 201, 260, 700]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(base) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(0, 5))]
        t = "".join(parts)
        a = rng.randint(0, 50)
        texts.append(t[a:] if rng.random() < 0.5 else t)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    check(spark, [*made(seed, alphabet="abcdefgh é\n" if seed % 2 else "ab"), None, "", "a" * 199, "a" * 200, "b" * 201, "ab" * 400, "ab" * 300 + "c", "é" * 150])


def test_split_ranks_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SPLIT", 2)
    check(spark, made(3, alphabet="abcd"))


def test_shuffled_ways(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", -1)
    check(spark, made(4, alphabet="abcdefghijk", n=20))


def test_segments(monkeypatch):
    import numpy as np

    data = np.frombuffer("".join(made(5)).encode(), np.uint8)
    whole = [x for a in suffix.anchors(data) for r, p, f, t in zip(*a, strict=True) for x in [(r, p, s) for s in range(f, t + 1)]]
    monkeypatch.setattr(suffix, "SEGMENT", 512)
    monkeypatch.setattr(suffix, "_PLACE", np.uint64(1023))
    parts = [x for a in suffix.anchors(data) for r, p, f, t in zip(*a, strict=True) for x in [(r, p, s) for s in range(f, t + 1)]]
    assert len(whole) == len(parts) == len(data) - 199
    assert [s for *_, s in parts] == list(range(len(parts)))


def test_documents_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = sorted(suffix.repeat_digests(df).collect())
    docs = df.select("doc_id", "text").collect()
    assert [tuple(r)[1:] for r in rows] == brute([d["text"] for d in docs])


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix.repeat_digests(empty).count() == 0
    df = spark.createDataFrame([(1, "q" * 150 + "xyz" * 60, None)] * 2 + [(None, "short", "z"), (None, None, None)], SCHEMA)
    rows = suffix.repeat_digests(df).collect()
    assert len(rows) == 4 and sorted(r["n_removed"] for r in rows) == [0, 0, 330, 330]
