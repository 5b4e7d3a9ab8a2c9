"""Toxicity: a logistic classifier whose scores may not depend on which group a sentence names.

Features are the distinct words of a text and their beginnings and ends; the model is learned on the driver from a bounded
sample of labelled documents (``SAMPLE`` documents with the smallest hash of doc_id, none of them held out, all of the rarer label if they are half of it or less), on the
features that the labels tell apart best, each with a ridge that follows from its evidence. For the counterfactual term, identity terms in all sentences of the sample are swapped for
each other term of their list, and where a sentence names no group, a term and its swap are put into it, terms taking turns;
the squared change of the score over all such pairs is added to the loss. So the terms of a list are pushed to one
common weight, and as they are put into clean and toxic sentences alike, they stop standing for either.

Scoring is a narrow map over the whole texts with a few thousand weights. Only text is an input of a score.

Defined cases: a null or empty text scores the bias alone; documents without a label are scored like others; a doc_id with several
labels counts as toxic if any row says so, and one with several texts is learned from the least of them that isn't empty; labels of documents that aren't there are ignored; with no labelled rows, or of one kind only, every score is the share of toxic labels
(0.5 if there are none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of, words

#: Labelled rows that training may use, and features that it keeps.
SAMPLE = 5_000
FEATURES = 2_500
#: Fewest training rows a feature must be in.
LEAST_ROWS = 2
PENALTY = 20.0
RIDGE = 0.1
#: How much larger the ridge of a feature without evidence may be.
MOST_DOUBT = 1e4
STEPS = 12
#: Chunks of text whose features a scoring worker keeps.
CACHED = 400_000
EDGE = ".,;:!?\"'()[]{}<>|*_~`-/\\"
#: Identity terms that may stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
SWAPS = {t: group for group in IDENTITY_TERMS for t in group}


def core(chunk: str) -> str:
    return chunk.strip(EDGE)


def parts(word: str) -> list[str]:
    """The word and, for longer ones, its beginnings and its end."""
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n), *([f"{word[-4:]}$"] if len(word) > 4 else [])]


def features(chunks: Iterable[str]) -> set[str]:
    """The distinct features of lower-case chunks."""
    return set(chain.from_iterable(parts(w) for w in {core(c) for c in chunks} if w))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


class Model:
    """Weights by feature, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, tuple[str, ...]] = {}

    def known(self, chunk: str) -> tuple[str, ...]:
        found = self.seen.get(chunk)
        if found is None:
            found = tuple(p for p in parts(core(chunk)) if p in self.weights)
            if len(self.seen) < CACHED:
                self.seen[chunk] = found
        return found

    def logit(self, text: str) -> float:
        present = set(chain.from_iterable(map(self.known, set(words(text.lower())))))
        return self.bias + sum(sorted(map(self.weights.__getitem__, present)))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)


def evidence(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Half the G statistic of features that are in a of n1 and in b of n0 rows: the log-likelihood that two shares win over one."""
    share = (a + b) / (n1 + n0)
    cell = lambda seen, expected: seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return cell(a, n1 * share) + cell(b, n0 * share) + cell(n1 - a, n1 * (1 - share)) + cell(n0 - b, n0 * (1 - share))


def select(names: list[str], rows: list[np.ndarray], y: np.ndarray) -> dict[str, float]:
    """The features with the most evidence, and all identity terms, each with its ridge; rows hold indexes of names.

    Among m features one is expected to tell as much as log m by chance. So a feature's ridge grows with the root of the odds against its evidence:
    in few rows, chance features outnumber those that tell the labels apart, and would outweigh them with one ridge for all.
    """
    count = lambda label: np.bincount(np.concatenate([np.zeros(0, np.int64), *[r for r, l in zip(rows, y, strict=True) if l == label]]), minlength=len(names))
    a, b = count(1), count(0)
    told = evidence(a, b, float(y.sum()), float((1 - y).sum()))
    often = np.flatnonzero(a + b >= LEAST_ROWS)
    ridge = RIDGE * np.minimum(np.sqrt(1 + np.exp(np.log(max(len(often), 1)) - told)), MOST_DOUBT)
    chosen = {names[i]: float(ridge[i]) for i in sorted(often.tolist(), key=lambda i: (-told[i], names[i]))[:FEATURES]}
    return chosen | {t: RIDGE * MOST_DOUBT for t in sorted(set(SWAPS) - set(chosen))}


def counterfactuals(texts: Iterable[str], known: Callable[[str], frozenset]) -> Counter:
    """How often a swap changes which features: (lost, won) to its number, over all sentences of the texts.

    known: the features of a word that matter, those that some identity term has. What the rest of a sentence has of them doesn't change.
    """
    own = {t: known(t) for t in SWAPS}
    terms = [(t, group) for group in IDENTITY_TERMS for t in group]
    found: Counter = Counter()
    plain = 0

    def swap(old: frozenset, new: frozenset, rest: frozenset) -> None:
        lost, won = old - new - rest, new - old - rest
        if lost or won:
            found[lost, won] += 1

    for text in texts:
        for sentence in text.lower().split("."):
            cores = [core(c) for c in words(sentence)]
            if not cores:
                continue
            named = [i for i, w in enumerate(cores) if w in SWAPS]
            for i in named:
                rest = frozenset().union(*(known(w) for j, w in enumerate(cores) if j != i))
                for t in SWAPS[cores[i]]:
                    if t != cores[i]:
                        swap(own[cores[i]], own[t], rest)
            if not named:
                t, group = terms[plain % len(terms)]
                plain += 1
                rest = frozenset().union(*filter(None, map(known, cores)))
                for other in group:
                    if other != t:
                        swap(own[t], own[other], rest)
                swap(own[t], frozenset(), rest)
    return found


def fit(texts: list[str], labels: list[int]) -> Model:
    """Newton's method on the log-likelihood, a ridge and the counterfactual penalty."""
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        edge = float(np.clip(share, 1e-6, 1 - 1e-6))
        return Model({}, float(np.log(edge / (1 - edge))))
    seen: dict[str, int] = {}
    rows = [np.fromiter((seen.setdefault(f, len(seen)) for f in features(words(t.lower()))), np.int64) for t in texts]
    ridge = select(list(seen), rows, y)
    names = list(ridge)
    index = {f: i for i, f in enumerate(names)}
    place = np.full(len(seen), -1)
    for f, i in index.items():
        if f in seen:
            place[seen[f]] = i
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    del rows, seen
    matter = {p for t in SWAPS for p in parts(t) if p in index}
    known = cache(lambda w: frozenset(p for p in parts(w) if p in matter) if w else frozenset())
    distinct = {(tuple(sorted(index[f] for f in lost)), tuple(sorted(index[f] for f in won))): n for (lost, won), n in counterfactuals(texts, known).items()}
    total = sum(distinct.values())
    fixed = np.diag(np.append(np.asarray(list(ridge.values())), 1e-6))
    for (plus, minus), n in distinct.items():
        at, sign = np.asarray(plus + minus), np.asarray([1.0] * len(plus) + [-1.0] * len(minus))
        fixed[np.ix_(at, at)] += PENALTY * len(y) * n / total * np.outer(sign, sign) / 10
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(share / (1 - share))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        v = np.maximum(p * (1 - p), 1e-6).astype(np.float32)
        hessian = (x.T @ (x * v[:, None])).astype(np.float64) + fixed
        step = np.linalg.solve(hessian, x.T.astype(np.float32) @ (p - y).astype(np.float32) + fixed @ w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that aren't held out, as many of the rarer label as half of them hold.

    Where the sample's shares of labels differ from all documents', the bias is moved by the difference of their logits.
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic").cast("double") > 0).cast("int")).alias("toxic"))
    known = told.where(~held_out(F.col("doc_id"))).join(docs.select("doc_id"), "doc_id", "left_semi")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = min((0, 1), key=lambda label: n.get(label, 0))
    take = {rare: min(n.get(rare, 0), sample // 2)}
    take[1 - rare] = min(n.get(1 - rare, 0), sample - take[rare])
    order = F.xxhash64("doc_id")
    some = [known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(k) for label, k in take.items()]
    chosen = F.broadcast(some[0].unionByName(some[1]))
    # the least text with any character, so that an id's empty rows don't hide what was labelled
    least = F.coalesce(F.min(F.when(F.col("text") != "", F.col("text"))), F.lit("")).alias("text")
    rows = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(least).toArrow()
    rows = rows.sort_by("doc_id")
    model = fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())
    if all(take.values()):
        model.bias += float(np.log(n[1] / n[0]) - np.log(take[1] / take[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column(2)], pa.float64())
            yield pa.record_batch([b.column(0), b.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
