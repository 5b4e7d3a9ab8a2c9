"""Line dedup against brute force, WARC round trips, and the classifier on held-out rows."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from kinlattice.llm import lines, toxicity, warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, h string, starts long"


def lines_brute(rows):
    """Rows (doc_id, text); distinct in full."""
    places = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in places:
        ls = (rows[i][1] or "").split("\n")
        gone = set()
        for j in range(len(ls) - 2):
            w = tuple(ls[j : j + 3])
            if w in seen:
                gone |= {j, j + 1, j + 2}
            seen.add(w)
        out[i] = (rows[i][0], len(ls), len(gone), "\n".join(x for j, x in enumerate(ls) if j not in gone))
    return Counter(out.values())


def made(seed, n=50):
    rng = random.Random(seed)
    runs = [[rng.choice("abc ") * rng.randint(0, 2) for _ in range(rng.randint(1, 7))] for _ in range(8)]
    return [(i, "\n".join(x for _ in range(rng.randint(0, 5)) for x in (rng.choice(runs) if rng.random() < 0.7 else [str(rng.random())]))) for i in range(n)]


def test_lines(spark):
    rows = [*made(1), *[(100 + i, t) for i, (_, t) in enumerate(made(2))], (200, None), (201, ""), (202, "a\na\na\na\na"), (203, "x\n\n\n\n"), (None, "q\nr\ns"), (204, "q\nr\ns"), (205, "line\n" * 3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in lines.line_dedup(df).collect())
    assert got == lines_brute(rows)
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_lines_of_repeated_rows(spark):
    rows = [(1, "a\nb\nc")] * 2 + [(2, "a\nb\nc"), (3, "x\ny"), (3, "x\ny"), (None, "q\nr\ns\nt"), (None, "q\nr\ns\nt"), (4, "long\n" * 5000), (4, "long\n" * 5000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in lines.line_dedup(df).collect())
    assert got == lines_brute(rows)
    assert sorted((r["doc_id"], r["n_removed"]) for r in lines.line_dedup(df.where("doc_id < 3")).collect()) == [(1, 0), (1, 3), (2, 3)]


PAGES = "page_id long, url string, html string, headers string, block string"
HTML = "<html><head><title>A  title</title><style>p{}</style></head><body><p>One &amp; two</p><a href='/x'>link</a><script>no()</script><br>é\U0001f600</body></html>"


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", HTML, "x", "y"), (2, None, None, None, None), (3, "http://a/3", "", "x", "y"), (1, "http://a/1", HTML, "x", "y"), (4, "http://a/4", "plain < text", "x", "y"), (5, "http://a/5", "<p>long</p>" * 20000, "x", "y")]
    pages = spark.createDataFrame(rows, PAGES)
    responses = warc.responses(pages)
    source = {r["record_id"]: r for r in responses.collect()}
    found = warc.derive(responses).collect()
    assert len(found) == 2 * len(rows) and Counter(r["warc_type"] for r in found) == {"metadata": len(rows), "conversion": len(rows)}
    for r in found:
        h = {x["name"]: x["value"] for x in r["headers"]}
        origin = {x["name"]: x["value"] for x in source[r["refers_to"]]["headers"]}
        assert h["WARC-Refers-To"] == r["refers_to"] != r["record_id"] == h["WARC-Record-ID"]
        assert h["WARC-Source-Payload-Digest"] == origin["WARC-Payload-Digest"] and h["WARC-Target-URI"] == origin["WARC-Target-URI"]
        assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"]).digest()).decode() and int(h["Content-Length"]) == len(r["block"])
    one = {r["warc_type"]: r["block"].decode() for r in found if r["page_id"] == 1}
    assert one["conversion"] == "One & two\nlink\né\U0001f600"
    told = json.loads(one["metadata"])
    assert told["title"] == "A title" and told["links"] == ["/x"] and ["Content-Type", "text/html; charset=utf-8"] in told["headers"]
    assert [r["block"] for r in found if r["page_id"] == 2 and r["warc_type"] == "conversion"] == [b""]
    warc.write_warc(warc.derive(responses), str(tmp_path / "out"))
    read = [x for f in Path(tmp_path / "out").glob("part-*") for x in warc.read_warc(f.read_bytes())]
    assert Counter((dict(h)["WARC-Record-ID"], b) for h, b in read) == Counter((r["record_id"], bytes(r["block"])) for r in found)
    assert warc.derivative_digests(pages.limit(0)).count() == 0


def plain_text(html):
    """Text of simple markup by hand: tags that end lines, other tags, references."""
    html = re.sub(r"<(script|style|noscript|template|title)\b.*?</\1>", "", html, flags=re.S)
    html = re.sub(r"</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|pre|blockquote)\b[^>]*>", "\n", html)
    lines_of = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in html.split("\n"))
    return "\n".join(x for x in lines_of if x)


def test_conversions_by_hand(spark, sf_dir):
    """The text of every page of the fixture against a reading by patterns."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    found = {r["page_id"]: bytes(r["block"]).decode() for r in warc.derive(warc.responses(pages)).where("warc_type = 'conversion'").collect()}
    assert found.keys() == html.keys()
    assert np.mean([found[i].split() == plain_text(h).split() for i, h in html.items()]) > 0.95


def test_malformed_pages(spark, tmp_path):
    odd = ["<![foo[ x ]]>", "<p>a<![if !IE]>b<![endif]>", "<!", "<!doctype", "<a href='", "&#xD800; x", "<b" * 3000, "<![CDATA[ y", "a\x00b", "<![foo[ x ]]><p>after"]
    pages = spark.createDataFrame([(1, "http://a", t, "x", "y") for t in odd], PAGES)
    responses = warc.responses(pages).cache()
    ids = [r["record_id"] for r in responses.collect()]
    assert len(set(ids)) == len(odd)  # one id and url, other bodies
    found = warc.derive(responses).collect()
    assert len(found) == 2 * len(odd) and {r["refers_to"] for r in found} == set(ids)
    text = {r["refers_to"]: bytes(r["block"]).decode() for r in found if r["warc_type"] == "conversion"}
    assert "after" in text[ids[-1]] and "x" in text[ids[0]]
    files = tmp_path / "in"
    files.mkdir()
    blocks = [(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + c + b"\r\nX-Own: 1\r\n\r\n<p>caf\xe9") for c in (b'"iso-8859-1"', b"idna", b"undefined", b"nothing", b"hex", b"latin-1")]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(x), x) for i, x in enumerate(blocks)]
    (files / "a.warc").write_bytes(b"".join(records[:3]))
    (files / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records[3:]))
    loaded = warc.load_warc(spark, str(files))
    assert sorted(r["record_id"] for r in loaded.collect()) == [f"<urn:{i}>" for i in range(6)]
    made = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(loaded).collect()}
    assert [bytes(made[f"<urn:{i}>", "conversion"]["block"]).decode() for i in range(6)] == ["café", *["caf\ufffd"] * 4, "café"]
    assert ("WARC-Source-HTTP-Header", "X-Own: 1") in [(h["name"], h["value"]) for h in made["<urn:0>", "conversion"]["headers"]]


LABELS = "doc_id long, quality int, toxic int, score double"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    one, zero = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert len(one) and (one[:, None] > zero[None, :]).mean() > 0.95
    assert (held.predicted == held.toxic).mean() > 0.95


def test_identity_terms_stand_for_nothing(monkeypatch):
    """The labels are biased against one group; the penalty takes the bias out of neutral mentions."""
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        say = [rng.choice(filler) for _ in range(20)]
        say.append("muslims" if rng.random() < (0.7 if toxic else 0.05) else "christians" if rng.random() < 0.3 else "people")
        if toxic and rng.random() < 0.9:
            say.append(rng.choice(["idiots", "scum"]))
        rng.shuffle(say)
        texts.append(" ".join(say) + ".")
        labels.append(int(toxic))
    gap = lambda m: abs(m.logit("the muslims met today") - m.logit("the christians met today"))
    fair = toxicity.fit(texts, labels)
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    biased = toxicity.fit(texts, labels)
    assert gap(biased) > 1 and gap(fair) < 0.2 * gap(biased)
    assert fair.score("these idiots and scum again") > 0.5 > fair.score("the muslims met today")
    assert fair.score("the muslims met today") < biased.score("the muslims met today")


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (None, "scum", "x", 3), (3, "scum " * 30000, "x", 4), (3, "fine", "x", 5)], DOCS)
    some = spark.createDataFrame([(1, 1, 0, 0.0), (3, 1, 1, 0.0), (3, 0, None, 0.0), (None, 1, 1, 0.0)], LABELS)
    for labels in (some, some.limit(0), some.where("toxic = 1")):
        rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.Model({}, 0.0)).count() == 0
    model = toxicity.Model({"scum": 3.0}, -1.0)
    assert np.isclose(model.score("SCUM, scum!"), 1 / (1 + np.exp(-2))) and np.isclose(model.score(""), 1 / (1 + np.exp(1)))


def test_one_row_many_times(spark, monkeypatch):
    """One of equal rows keeps its text, in whichever blocks the others are made again."""
    monkeypatch.setattr(lines, "COPIES", 3)
    long, short = "a\nb\nc\nd", "a\nb"
    rows = [(1, long, "x", 1)] * 10 + [(1, short, "y", 2)] * 7 + [(None, long, None, 3)] * 2 + [(2, "q\nr\ns", "x", 4)] + [(3, None, "x", 5)] * 4
    found = Counter(tuple(r) for r in lines.line_dedup(spark.createDataFrame(rows, DOCS).repartition(5)).select("doc_id", "n_lines", "n_removed", "text").collect())
    assert found == {(1, 4, 0, long): 1, (1, 4, 4, ""): 9, (1, 2, 0, short): 7, (None, 4, 4, ""): 2, (2, 3, 0, "q\nr\ns"): 1, (3, 1, 0, ""): 4}


def biased_table(spark):
    """Labels against one group: 600 learned documents, and neutral mentions of it that no label covers."""
    rng = random.Random(5)
    texts, told, n = [], [], 0
    while len(told) < 600:
        n += 1
        toxic = len(told) % 4 == 0
        say = [f"w{rng.randrange(150)}" for _ in range(12)] + ["muslims" if rng.random() < (0.9 if toxic else 0.03) else f"w{rng.randrange(150)}"]
        texts.append((n, " ".join([*say, *(["scum"] if toxic and rng.random() < 0.6 else [])]) + ".", "x", n))
        told.append((n, 1, int(toxic), 0.0))
    neutral = [(10_000 + i, " ".join([*(f"w{rng.randrange(150)}" for _ in range(12)), "muslims"]) + ".", "x", 0) for i in range(100)]
    return spark.createDataFrame(texts + neutral, DOCS), spark.createDataFrame(told, LABELS)


def test_neutral_mentions_of_a_table(spark, monkeypatch):
    """Through train and score: without the penalty neutral mentions are called toxic, with it less than a third of them."""
    docs, labels = biased_table(spark)
    wrong = lambda m: toxicity.score(docs, m).where("doc_id >= 10000 AND predicted = 1").count()
    fair = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    biased = toxicity.train(docs, labels)
    assert wrong(biased) > 50 and wrong(fair) < wrong(biased) / 3
    caught = toxicity.score(docs.where("text like '%scum%'"), fair)
    assert caught.where("predicted = 1").count() > 0.9 * caught.count()


def test_all_sentences_count():
    known = lambda w: frozenset({w}) if w in toxicity.SWAPS else frozenset()
    terms = len(toxicity.SWAPS)
    pairs = toxicity.counterfactuals(["one two. three."] * terms * 10, known)
    assert sum(pairs.values()) == 20 * sum(len(g) ** 2 for g in toxicity.IDENTITY_TERMS)
    named = toxicity.counterfactuals(["Women and men."], known)
    assert sum(named.values()) == 6 and (frozenset({"women"}), frozenset({"girls"})) in named
    assert (frozenset({"women"}), frozenset()) in named  # the other term is there already


def test_order_of_rows_and_scores_by_hand(spark):
    """The same rows in another order, some ids with several texts, give the same weights; scores are sums over distinct features."""
    docs, labels = biased_table(spark)
    more = docs.unionByName(docs.where("doc_id % 7 = 0").withColumn("text", F.reverse("text")))
    a = toxicity.train(more.orderBy("doc_id", "text").coalesce(1), labels)
    b = toxicity.train(more.orderBy(F.desc("text")).repartition(7), labels.orderBy(F.desc("doc_id")))
    assert a.weights == b.weights and a.bias == b.bias
    for r in toxicity.score(docs, a).join(docs, "doc_id").collect():
        sum_of = a.bias + sum(a.weights.get(f, 0.0) for f in toxicity.features(r["text"].lower().split()))
        assert np.isclose(r["score"], 1 / (1 + np.exp(-sum_of)), atol=1e-9)


def ranked(scores, y):
    one, zero = scores[y == 1], scores[y == 0]
    return (one[:, None] > zero[None, :]).mean() + (one[:, None] == zero[None, :]).mean() / 2


def test_few_labels_rank_held_out_rows():
    """Learned from some 300 rows, in five folds: chance features don't outweigh those that tell labels apart."""
    d = "/root/testdata/sf0.01"
    rows = pq.read_table(f"{d}/labels.parquet").to_pandas().merge(pq.read_table(f"{d}/documents.parquet").to_pandas(), on="doc_id").sort_values("doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in rows.doc_id])
    texts, y, scores = rows.text.fillna("").to_numpy(), rows.toxic.to_numpy(), np.zeros(len(rows))
    for k in range(5):
        model = toxicity.fit(list(texts[fold != k]), list(y[fold != k]))
        scores[fold == k] = [model.score(t) for t in texts[fold == k]]
    assert ranked(scores, y) > 0.93 and (scores[y == 1] >= 0.5).mean() > 0.55


def test_rare_label_and_labels_without_documents(spark):
    """The sample isn't used up by labels of documents that aren't there, holds the rarer label, and reads texts beside empty rows of an id."""
    rng = random.Random(3)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(15)] + ["scum"] * (i % 50 == 0)), "x", 0) for i in range(1, 3001)]
    docs = spark.createDataFrame(rows + [(i, None, "x", 0) for i, *_ in rows], DOCS)
    told = [(i, 1, int(i % 50 == 0), 0.0) for i, *_ in rows] + [(i, 1, 0, 0.0) for i in range(10_000, 40_000)]
    scored = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(told, LABELS), sample=200)).where("held_out").toPandas()
    truth = {i: "scum" in t for i, t, *_ in rows}
    scored = scored.groupby("doc_id", as_index=False).score.max()
    y = np.array([truth[i] for i in scored.doc_id])
    assert y.sum() > 5 and ranked(scored.score.to_numpy(), y.astype(int)) > 0.99
    assert (scored.score.to_numpy() >= 0.5)[y].mean() > 0.9 and (scored.score.to_numpy() < 0.5)[~y].mean() > 0.99


def test_headers_without_dictionaries():
    """Headers go into and out of Arrow as pairs, rows without any and slices of a batch included; a row isn't made into dictionaries."""
    rows = [[("a", "1"), ("b", "é")], [], [("a", "")]]
    made = warc._header_lists(rows)
    assert made.to_pylist() == [[{"name": n, "value": v} for n, v in r] for r in rows] and made.type == warc._HEADERS
    assert warc._header_rows(made) == rows and warc._header_rows(made.slice(1)) == rows[1:] and warc._header_rows(made.slice(3)) == []
    page = warc.read_page("<p> a\u00a0\x1fb \t c</p>\r\n<p>\u2003</p>d")
    assert page.text() == "a b c\nd"
