"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence is toxic with probability sigmoid(bias + its words' weights), and a
document with the noisy-or 1 - prod(1 - p). Only document labels are given: weights follow the gradient of the
document likelihood, which hands each sentence its share of the blame, so the trained model also says which sentence
offends. Training takes a bounded sample of the labelled rows (MAX_TRAIN, by hash order of the id); scoring is one
pass over all texts with the learned weights, whose number is bounded by MAX_FEATURES, sent to each task. How many features
are learnt and how fast their weights decay is chosen on training documents that are held back.

Defined results: null and empty texts have no sentence, so the score is that of the bias alone; without usable labels
every weight is 0 and every score the prior's; repeated rows score alike; very long texts are scored whole, and learnt from
up to MAX_TEXT_CHARS; rows with a null id are not held out; features that tie keep the order of their hashes; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumigrid.llm import common

#: The bound of the training sample: so many labelled documents, and so many characters of text, at most.
MAX_TRAIN = 8_000
MAX_TRAIN_CHARS = 40_000_000
MAX_TEXT_CHARS = 1_000_000
MAX_FEATURES = 4_000
#: What tuned() chooses from, numbers of features and decays; the documents it looks at, at most; its folds and steps.
FEATURES, DECAYS = (100, 400, MAX_FEATURES), (1e-6, 1e-4)
TUNED, FOLDS, TUNING_STEPS = 1_000, 3, 80
THRESHOLD = 0.7
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()]


def features(word: str) -> list[str]:
    """The word, and its first four and five letters as prefixes, which carry over to unseen inflections."""
    return [word] + [word[:n] + "*" for n in (4, 5) if len(word) > n]


def fit(texts: list[str], labels: list[int], steps: int = 300, rate: float = 0.2, decay: float = 1e-6, least: int = 5, most: int = MAX_FEATURES) -> dict:
    """Weights by feature and the bias, from documents and their labels."""
    # sentences become sorted numbers of distinct words at once, so that no text stays in memory as strings
    number: dict[str, int] = {}
    said, sizes, doc_of, y = array("i"), array("i"), array("i"), np.array(labels, dtype=float)
    for d, t in enumerate(texts):
        for s in sentences(t):
            ids = {number.setdefault(w, len(number)) for w in WORD.findall(s.lower())}
            said.extend(ids)
            sizes.append(len(ids))
            doc_of.append(d)
    if not len(doc_of) or y.min() == y.max():
        return {"bias": -3.0, "weights": {}}
    flat, doc_a = np.frombuffer(said, dtype=np.int32), np.frombuffer(doc_of, dtype=np.int32)
    sentence = np.repeat(np.arange(len(doc_a), dtype=np.int32), np.frombuffer(sizes, dtype=np.int32))
    # each word's features, by hash, and how many documents, and toxic ones, have each feature
    counts = np.fromiter((len(features(w)) for w in number), dtype=np.int32, count=len(number))
    hashes = np.fromiter((xxhash.xxh64_intdigest(f) for w in number for f in features(w)), dtype=np.uint64, count=int(counts.sum()))
    names, every = np.unique(hashes, return_inverse=True)
    first, every = np.concatenate([[0], np.cumsum(counts)])[:-1], every.astype(np.int32)
    del hashes
    seen, held, doc_of_token = np.zeros(len(names)), np.zeros(len(names)), doc_a[sentence]
    for d in range(0, len(y), 500):  # a few documents at a time
        a, z = np.searchsorted(doc_of_token, (d, d + 500))
        pairs = np.unique(doc_of_token[a:z].astype(np.int64) * len(number) + flat[a:z])
        docs_, words_ = pairs // len(number), pairs % len(number)
        reach = np.unique(np.repeat(docs_, counts[words_]) * len(names) + every[_spread(first[words_], counts[words_])])
        seen += np.bincount(reach % len(names), minlength=len(names))
        held += np.bincount(reach % len(names), weights=y[reach // len(names)], minlength=len(names))
    del doc_of_token
    # features are kept by how far their presence moves the odds of the label, in standard errors or so
    prior = y.mean()
    shift = np.where(seen >= least, np.abs(held - prior * seen) / np.sqrt(prior * seen + 1), -1.0)
    best = np.argsort(-shift, kind="stable")[:most]
    best = best[shift[best] > 0]
    index = np.full(len(names), -1, dtype=np.int32)
    index[best] = np.arange(len(best))
    place = {int(names[b]): i for i, b in enumerate(best)}
    label = {place[h]: f for w in number for f in features(w) if (h := xxhash.xxh64_intdigest(f)) in place}
    names = [label[i] for i in range(len(best))]
    cols_a = index[every[_spread(first[flat], counts[flat])]]
    rows = np.repeat(sentence, counts[flat])
    rows, cols_a = rows[cols_a >= 0], cols_a[cols_a >= 0]
    w, b = np.zeros(len(names)), -6.0
    mw, vw, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols_a], minlength=len(doc_a)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        safe = np.bincount(doc_a, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        doc = np.clip(1 - np.exp(safe), 1e-9, 1 - 1e-12)
        # the loss by a sentence's log odds: p for a clean document, -p (1 - P) / P for a toxic one
        g = p * np.where(y[doc_a] > 0, -(1 - doc[doc_a]) / doc[doc_a], 1.0) / len(y)
        gw, gb = np.bincount(cols_a, weights=g[rows], minlength=len(names)) + decay * np.sign(w), g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return {"bias": float(b), "weights": {n: round(float(x), 5) for n, x in zip(names, w, strict=True) if abs(x) > 0.05}}


def tuned(texts: list[str], labels: list[int]) -> dict:
    """The number of features and the decay for fit() that decide best, by F1 at THRESHOLD and then by loss, on documents they
    have not learnt from: each fold of the first TUNED documents is judged by what the others teach. Few documents need few
    features."""
    some = range(min(TUNED, len(texts)))
    y = np.array([labels[i] for i in some])
    found: dict[tuple[int, float], tuple[float, float]] = {}
    for most in FEATURES:
        for decay in DECAYS:
            p = np.zeros(len(some))
            for fold in range(FOLDS):
                learn = [i for i in some if i % FOLDS != fold]
                scorer = Scorer(fit([texts[i] for i in learn], [labels[i] for i in learn], TUNING_STEPS, decay=decay, most=most))
                for i in some[fold::FOLDS]:
                    p[i] = min(max(scorer.document(texts[i])[0], 1e-3), 1 - 1e-3)
            hits = float(((p >= THRESHOLD) & (y > 0)).sum())
            f1 = 2 * hits / max(1.0, float((p >= THRESHOLD).sum() + y.sum()))
            found[most, decay] = (-f1, float(-np.log(np.where(y > 0, p, 1 - p)).sum()))
    most, decay = min(found, key=found.get)
    return {"most": most, "decay": decay}


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(first, counts) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that may be learnt from, the first MAX_TRAIN by hash of the id, and of these as
    many as have MAX_TRAIN_CHARS characters together; ids of more than MAX_TEXT_CHARS are passed over."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (common.crc_mod("doc_id", 3) != 1)).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("__id"), "__id").limit(MAX_TRAIN)
    base = common.corpus(docs)
    sizes = base.select("doc_id", F.length("text").alias("chars")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).groupBy("__id", "toxic").agg(F.sum("chars").alias("chars"))
    running = F.sum("chars").over(Window.orderBy(F.xxhash64("__id"), "__id"))  # over MAX_TRAIN rows at most
    chosen = sizes.where(F.col("chars") <= MAX_TEXT_CHARS).withColumn("running", running).where(F.col("running") <= MAX_TRAIN_CHARS).select("__id", "toxic")
    return base.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of training_rows(), fitted by one task, which the sample's bounds keep small; the driver gets weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((hash_, text, int(label)) for b in batches for hash_, text, label in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
        texts, said = [r[1] for r in rows], [r[2] for r in rows]
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(fit(texts, said, **tuned(texts, said)))]})

    sample = training_rows(docs, labels).select(F.xxhash64("doc_id").alias("h"), "text", "toxic")
    row = sample.repartition(1).mapInArrow(run, "model string").first()
    return json.loads(row["model"]) if row else fit([], [])


class Scorer:
    """Scores texts; keeps what it has worked out by word, up to a bound."""

    def __init__(self, model: dict, bound: int = 200_000):
        self.weights, self.bias, self.bound, self.by_word = model["weights"], model["bias"], bound, {}

    def word(self, w: str) -> float:
        if len(self.by_word) >= self.bound:
            self.by_word.clear()
        x = self.by_word[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return x

    def parts(self, text: str) -> tuple[list[str], np.ndarray]:
        """The sentences, and the probability of each."""
        said, get = sentences(text), self.by_word.get
        z = np.array([sum([x if (x := get(w)) is not None else self.word(w) for w in set(WORD.findall(s.lower()))]) for s in said], dtype=float)
        return said, 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))

    def document(self, text: str) -> tuple[float, int, float]:
        """The noisy-or, the place of the worst sentence (-1: none), and that sentence's probability."""
        _, p = self.parts(text)
        if not len(p):
            return float(1 / (1 + np.exp(-self.bias))), -1, 0.0
        worst = int(p.argmax())
        return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), worst, float(p[worst])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, worst int, worst_score), a row for each document."""
    said = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(json.loads(said))
        for b in common.sliced(batches):
            score_, worst, of = zip(*[scorer.document(t) for t in b.column(1).to_pylist()], strict=True)
            cols = [b.column(0), pa.array(score_, pa.float64()), pa.array(worst, pa.int32()), pa.array(of, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "worst", "worst_score"])

    return common.corpus(docs).mapInArrow(run, "doc_id long, score double, worst int, worst_score double")


def offending(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """(doc_id, place, sentence, score) of the sentences with at least this probability of being toxic."""
    said = json.dumps(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(json.loads(said))
        for b in batches:
            rows = [(d, i, s.strip(), p) for d, t in zip(b["doc_id"].astype("Int64"), b["text"], strict=True) for i, (s, p) in enumerate(zip(*scorer.parts(t), strict=True)) if p >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "sentence", "score"]).astype({"doc_id": "Int64"})

    return common.corpus(docs).mapInPandas(run, "doc_id long, place int, sentence string, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: held_out, score and the decision at THRESHOLD."""
    model = train(docs, labels)
    held = F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst", "worst_score")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. Scores are computed beside the rows, in the pass that filters."""
    said = json.dumps(train(docs, labels))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(json.loads(said))
        for texts in batches:
            yield pa.array([scorer.document(t)[0] for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()], pa.float64())
            pa.default_memory_pool().release_unused()

    return docs.where(scored(F.coalesce("text", F.lit(""))) < THRESHOLD)
