"""Spelling variants, the divergence audit and the secret scan against brute force; odd rows of each."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from kinlattice.llm import divergence, leaks, variants

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, at long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2) for i, t, lang, s in rows], SCHEMA)


# Spelling variants


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    out = {}
    for w in n:
        found = [x for x in n if x != w and near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, len(found)]
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {(w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items()}


def counted(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def check_variants(spark, rows):
    found = {tuple(r) for r in variants.variant_groups(table(spark, rows)).collect()}
    assert found == grouped(counted(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = "abcÀàßé" if seed == 1 else "abcdefghijklmnopqrstuvwxyzé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(12)]

    def edited(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])

    words = []
    for w in base:
        words += [w] * rng.choice([3, 30, 400])
        for _ in range(12):
            words += [edited(w)] * rng.randint(1, 4)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20]).upper() if i % 5 == 0 else "-".join(words[i * 20 : i * 20 + 20]), "en", "s") for i in range(len(words) // 20)]
    check_variants(spark, rows)


def test_variants_odd_rows(spark):
    long = "abcdefghij " * 50_000
    rows = [(1, None, None, None), (None, "Wörterbuch wörterbuch WÖRTERBUCH wÖrterbuch", "de", "s"), (2, "", "en", "s"), (2, long, "en", "s"), (2, long, "en", "s"), (3, "abcdefghik abcdefghik abcdefgij abcdefgij", "en", "s")]
    check_variants(spark, rows)
    assert variants.variant_groups(table(spark, rows).limit(0)).count() == 0


def test_chains_of_forms(spark):
    """Each word leads to one ten times as frequent, nine steps long: roots are the end of the chain."""
    words = ["".join("b" if i < k else "a" for i in range(9)) for k in range(10)]
    rows = [(w, 10**k * 2) for k, w in enumerate(words)]
    found = {tuple(r) for r in variants.group_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found == grouped(dict(rows))
    assert {r[2] for r in found} == {words[-1]}


def test_one_half_in_common(spark):
    """A thousand words of one first half and one mask: pairs are made by the other half, and are right."""
    rng = random.Random(5)
    words = {"aaaaaaa" + "".join(rng.choice("bcdef") for _ in range(7)) for _ in range(1000)}
    n = {w: rng.randint(2, 100) for w in words}
    found = {tuple(r) for r in variants.group_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert found == grouped(n)


# Divergence


def audited(rows):
    texts = [(lang or "", source or "", Counter("".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in texts}:
        documents, groups = Counter(), defaultdict(Counter)
        for own, source, n in texts:
            if own == lang:
                documents.update(n.keys())
                groups[source].update(n)
        kept = [t for t, k in documents.items() if k >= 10]
        share = lambda n, kept=kept: {t: 1 + 10**9 * (n[t] + 2) // (sum(n[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(n) for s, n in groups.items()}
        whole = share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def documents(seed, n_sources, n):
    rng = random.Random(seed)
    common, rare = [f"w{chr(97 + i)}é" for i in range(20)], [f"r{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = []
    for i in range(n):
        source = rng.randrange(n_sources)
        words = [rng.choice(common).upper() if rng.random() < 0.1 else rng.choice(common) for _ in range(rng.randint(0, 30))] + [rare[(source * 7 + rng.randrange(3)) % len(rare)] for _ in range(rng.randint(0, 6))]
        rows.append((i, " 12,".join(words), rng.choice(["en", "en", "de"]), f"s{source}"))
    return rows


@pytest.mark.parametrize("n_sources", [1, 7, 40])
def test_divergence_against_all_pairs(spark, n_sources):
    rows = documents(n_sources, n_sources, 500)
    assert sorted(map(tuple, divergence.audit(table(spark, rows)).collect())) == audited(rows)


def test_divergence_in_small_tiles(monkeypatch):
    """Every pair is in one tile of three by three groups, also where a tile's groups lack a term."""
    monkeypatch.setattr(divergence, "GROUPS", 3)
    heads = pd.DataFrame({"at": range(7), "term": None, "p": [5, 9, 2, 7, 7, 3, 1], "k": 2})
    cells = pd.DataFrame({"at": [0, 1, 4, 6, 6], "term": ["x", "x", "y", "x", "y"], "p": [50, 10, 20, 33, 41]})
    p = {(a, t): 0 for a in range(7) for t in "xy"}
    for a, lack in enumerate(heads["p"]):
        p[a, "x"] = p[a, "y"] = lack
    for a, t, v in cells.itertuples(index=False):
        p[a, t] = v
    found = {}
    for i in range(3):
        for j in range(i, 3):
            tile = lambda at, i=i, j=j: at // 3 in (i, j)
            both = pd.concat([heads[heads["at"].map(tile)], cells[cells["at"].map(tile)]])
            for r in divergence._tile_sums(("en", 0, i, j), both).itertuples(index=False):
                assert (r.lo, r.hi) not in found
                found[r.lo, r.hi] = r.value
    assert found == {(a, b): sum((p[a, t] - p[b, t]) ** 2 // (p[a, t] + p[b, t]) for t in "xy") for a in range(7) for b in range(a + 1, 7)}


def test_divergence_odd_rows(spark):
    rows = [(1, None, None, None), (None, "uno Dos", "es", None), *[(7, "same Ünder same", "de", s) for s in "abcab" * 4], (8, "x" * 3_000_000, "de", "a"), (9, "42 !?", "de", "empty"), (9, "", "", "z")]
    found = sorted(map(tuple, divergence.audit(table(spark, rows)).collect()))
    assert found == audited(rows)
    assert ("", "", "pair", "z", 0, 1) in found
    assert divergence.audit(table(spark, rows).limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 3 * 10**13, 7 * 10**13, 10**9
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(v).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_term_counts_hand_over_in_parts():
    """A task's counts add up whether it hands them on once or with every batch."""
    rows = [("en", "a", b"Alpha beta, beta"), ("en", "", b""), ("", "a", "ÄB äb".encode()), ("en", "a", b"\n beta\t"), ("en", "b", b"42 \x0b!")]
    parts = [divergence._counted(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["lang", "source", "text"])) for some in (rows, rows[:2], rows[2:], rows[1:2])]
    whole, again = parts[0], divergence._summed(pa.concat_tables(parts[1:]))
    told = lambda t: sorted(map(tuple, (r.values() for r in t.to_pylist())))
    assert told(whole) == told(again) == [("", "a", "Äb", 1, 1), ("", "a", "äb", 1, 1), ("en", "a", "alpha", 1, 1), ("en", "a", "beta", 3, 2)]


# Secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def scanned(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for k, p in ((3, "gh[pousr]_([A-Za-z0-9]{36})"), (4, "npm_([A-Za-z0-9]{36})")):
        spans += [(m.start(), k, m.end()) for m in re.finditer(p, text) if leaks.checksum(m[1][:30].encode()) == m[1][30:]]
    return sorted(spans)


def told(spans):
    return ",".join(f"{leaks.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def token(rng, prefix, good=True):
    body = "".join(rng.choice(leaks.DIGITS) for _ in range(30))
    return prefix + body + (leaks.checksum(body.encode()) if good else "000000")


def leaky(rng):
    parts = ["password", "Passwd", "SECRET", "tokEN", "api_key", "APIKEY", "paſſword", "toKen", ": ", "=", "==", '"', "'", " ", "é", "日本", "AKIA", "akia", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "hunter2hunter2", "abc", "\n", "_", "g"]
    made = [rng.choice(parts) if rng.random() < 0.9 else token(rng, rng.choice(["ghp_", "gho_", "ghs_", "npm_", "GHP_"]), rng.random() < 0.7) for _ in range(rng.randint(0, 40))]
    return "".join(made)


def test_spans_against_whole_patterns():
    rng = random.Random(3)
    seen = Counter()
    for _ in range(3000):
        text = leaky(rng)
        spans = leaks.find_spans(text)
        assert spans == scanned(text), text
        seen.update(k for _, k, _ in spans)
    assert min(seen[k] for k in range(5)) > 50


def test_checksum_is_six_digits_of_base_62():
    assert leaks.checksum(b"") == "000000"
    n = 0
    for c in leaks.checksum(b"abc"):
        n = 62 * n + leaks.DIGITS.index(c)
    assert n == zlib.crc32(b"abc")


def test_scan_and_redact(spark):
    rng = random.Random(4)
    texts = [leaky(rng) for _ in range(60)] + [None, "", "token = " + "a" * 3_000_000, "ab" * 1_000_000]
    rows = [(i if i != 5 else None, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s")]
    found = sorted(map(tuple, leaks.scan_digests(table(spark, rows)).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        spans = scanned(t)
        base = told([s for s in spans if s[1] < 3])
        want.append((i, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(base.encode()).hexdigest(), told(spans)))
    assert found == sorted(want, key=repr)
    listed = {(r["doc_id"], told([(s["start"], leaks.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]])) for r in leaks.scan(table(spark, rows)).collect()}
    assert listed == {(r[0], r[-1]) for r in want}
    clean = leaks.redact(table(spark, rows))
    assert clean.columns == table(spark, rows).columns
    for r in clean.collect():
        assert r["text"] is None or not [s for s in scanned(r["text"].replace("[secret]", "\n"))] or "[secret]" in r["text"]
    assert leaks.scan_digests(table(spark, rows).limit(0)).count() == 0
    assert leaks.redact(table(spark, [(1, "xé token: hunter2hunter2 y", "en", "s")])).first()["text"] == "xé [secret] y"
