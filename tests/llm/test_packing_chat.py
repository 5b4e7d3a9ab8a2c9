"""Packing against the tokenizer itself and against item-wise best fit; chat formatting round trips."""

import bisect
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinlattice.llm import chat, packing

DOCS = "doc_id long, text string, ids string, piece string"
CONVERSATIONS = "conv_id long, turn long, role string, text string, turns string"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 40), max_size=60))
def test_plan_is_best_fit_decreasing(counts):
    seen, sequences = defaultdict(set), defaultdict(list)
    for length, lo, hi, per, first, at in packing.best_fit(counts):
        for rank in range(lo, hi):
            assert rank not in seen[length]
            seen[length].add(rank)
            sequences[first + (rank - lo) // per].append((at + (rank - lo) % per * length, length))
    assert {n: len(r) for n, r in seen.items()} == counts
    for slots in sequences.values():
        upto = 0
        for at, length in sorted(slots):
            assert at == upto
            upto += length
        assert upto <= 4096
    rooms, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) if i < len(rooms) else 4096
            opened += room == 4096
            if room > length:
                bisect.insort(rooms, room - length)
    assert len(sequences) == opened


def test_plan_is_small_however_many_pieces():
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 4097)}
    plan = packing.best_fit(counts)
    assert len(plan) < 20_000


def ids_of(text):
    tokenizer = packing.encoder(packing.default_tokenizer()).tokenizer
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, texts):
    """texts: (doc_id, text) of every row; rows that share a doc_id have equal texts here."""
    expected = defaultdict(int)
    for doc, text in texts:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected[(doc, piece, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))] += 1
    got, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        slots[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for s in slots.values():
        upto = 0
        for at, length in sorted(s):
            assert at == upto
            upto += length
        assert upto <= 4096
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert len(slots) <= least * 1.02 + 1


def test_packing_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(packing.pack_digests(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 9000), (None, "a b"), (4, "x"), (4, "x"), (5, "a\x1fb c　d"), (6, "<|endoftext|> 's don't"), (7, "é ́a"), (8, "q" * 5000)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in texts], DOCS)
    check_packing(packing.pack_digests(df).collect(), texts)
    assert packing.pack_digests(df.limit(0)).count() == 0
    whole = packing.pack(df).where("doc_id = 3").orderBy("piece").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in whole] == [ids_of("word " * 9000)[i : i + 4096] for i in (0, 4096, 8192)]


LATIN = st.text(st.characters(min_codepoint=9, max_codepoint=0x260) | st.sampled_from("' ss<|>ΣςİI\u0301\u200d"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(LATIN | st.sampled_from(["<|endoftext|>", "don't we'll", "x" * 60, "ß²½ 's 'S", "a\xa0b\u3000c"]), min_size=1, max_size=6))
def test_encoder_against_the_tokenizer(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = packing.encoder(public_tokenizers.path(name))
        assert enc.wordwise == (name == "word_bpe_49k.json")
        ids, bounds = enc.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_caches_age(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    enc = packing.Encoder(packing.default_tokenizer())
    for _ in range(3):
        for i in range(0, 40, 4):
            texts = [f"{w}{i % 7} word {w}" for w in ("some", "more", "words")]
            ids, bounds = enc.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ids_of(t)[:-1] for t in texts]
            assert len(enc.chunks.young) <= 3 + 7


def test_caches_stay_small():
    """After 240,000 distinct words a worker keeps 40 MB of ids at most."""
    enc = packing.Encoder(packing.default_tokenizer())
    tracemalloc.start()
    for i in range(0, 240_000, 8_000):
        enc.encode(pa.array([" ".join("".join(chr(97 + j // 26**k % 26) for k in range(5)) for j in range(i, i + 8_000))]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40e6, held


def test_words_are_merged_once():
    """Of 150,000 words that come three times, a thousand of them with accents, a worker merges each once, and holds 20 MB for them."""
    enc = packing.Encoder(packing.default_tokenizer())
    merge, asked = enc.merge, Counter()
    enc.merge = lambda p: asked.update([p]) or merge(p)
    words = ["".join(chr(97 + j // 26**k % 26) for k in range(5)) + "é" * (j % 150 == 0) for j in range(150_000)]
    texts = [" ".join(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    found = [enc.encode(pa.array([t, ""])) for _ in range(3) for t in texts]
    assert len(asked) == sum(asked.values()) == len(set(words))
    for t, (ids, bounds) in zip(texts, found[-len(texts) :], strict=True):
        assert ids.tolist() == ids_of(t)[:-1] and bounds.tolist() == [0, len(ids), len(ids)]
    assert sum(x.nbytes for kept in (enc.chunks, enc.parts) for x in (kept.young, kept.ids, kept.sizes, kept.asked)) < 20e6


@pytest.mark.parametrize("block", [1, 50, 2 << 20])
def test_blocks_of_texts(spark, monkeypatch, block):
    """Rows keep their ids however texts are dealt to blocks, and repeated rows are told apart."""
    monkeypatch.setattr(packing, "BLOCK_CHARS", block)
    texts = [(i % 5, " ".join(f"w{i}x{j}" for j in range(i))) for i in range(40)] + [(7, "same")] * 3
    texts = [(i, " ".join(f"w{i}" for _ in range(n % 13))) for n, (i, _) in enumerate(texts)]
    found = [r for b in ([packing.blocks(t) for _, t in texts]) for r in [list(b)]]
    assert ["".join(b) for b in found] == [t for _, t in texts]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in texts], DOCS).coalesce(2)
    rows = packing.pack(df).collect()
    assert len({(r["instance"], r["piece"]) for r in rows}) == len(rows) == len(texts)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == Counter((i, tuple(ids_of(t))) for i, t in texts)


TEXT = st.lists(st.sampled_from(["a", " ", "\n", "<", "|", "\\", ">", "é", "\U0001f600", "im_end", "<|im_end|>", "<\\|", "<|endoftext|>", "1", "‍", "\x1f"]), max_size=20).map("".join) | st.text(max_size=15)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>"]), TEXT), max_size=6))
def test_chat_round_trip(turns):
    turns = [(r, t.encode("utf-8", "ignore").decode()) for r, t in turns]
    text, spans = chat.render(turns)
    ids, starts, ends = chat.encode(text, chat.default_tokenizer())
    assert chat.load(chat.default_tokenizer()).decode(ids.tolist(), skip_special_tokens=False) == text
    assert chat.read_turns(text) == turns
    assert chat.read_loss(text, chat.mask(spans, starts, ends), starts, ends) == "".join(t for r, t in turns if r == "assistant")
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS) for _, t in turns)


def test_mask_against_a_loop():
    rng = random.Random(3)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 60), rng.randint(1, 20)))
        starts, ends = np.array([0, *cuts[:-1]]), np.array(cuts)
        edges = sorted(rng.sample(range(0, 60), 2 * rng.randint(0, 5)))
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        slow = [any(s < z and e > a for a, z in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat.mask(spans, starts, ends).tolist() == slow


def chat_brute(rows):
    groups = defaultdict(list)
    for c, turn, role, text, _ in rows:
        groups[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_chat_rows(spark, block, monkeypatch):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "<|im_end|> \\<|", None), (1, 1, "assistant", "again", "x"), (2, None, None, None, None), (2, 0, "assistant", "", "x"), (None, 3, "assistant", "z" * 9000, "x"), (5, 0, "user", "same", "x"), (5, 0, "user", "same", "x")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    monkeypatch.setattr(chat, "BATCH_CHARS", block)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == chat_brute(rows)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
