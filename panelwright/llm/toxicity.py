"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, are fitted on a bounded sample of
labelled rows.  Both back off to word probabilities smoothed by one shared count of
distinct left neighbours, so rare expressions cost both classes alike.  A
document's evidence is the difference of both log-likelihoods per word, over all
words and over those alone whose own difference passes a margin: a few toxic words in
a long text weigh little in the first and all in the second.  A part of the sample
that gave no counts sets how both become a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import Words, even_starts, kept_rows, let_go, mix, read, remainder, slices

#: Rows of each class, and bytes of their text, that the model is fitted on at most.
PER_CLASS, CLASS_BYTES = 3000, 12 << 20
#: What is taken from every count of a class and given to the shared counts, so that rarer expressions rest on those
#: alone, and the difference from which a word counts as marked.  The calibration rows choose among these.
DISCOUNTS, MARGINS = (1.5, 3.0), (1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0)


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of the pairs with their predecessors, the rows of both; a first word has no pair."""
    h, row = words.hashes(), words.row_of()
    second = np.ones(len(h), dtype=bool)
    second[words.rows[:-1][words.counts() > 0]] = False
    at = np.flatnonzero(second)
    return h, mix(h[at - 1] * np.uint64(0xD6E8FEB86659FD93) + h[at]), at, row


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.full(len(wanted), missing), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], missing), hit


@dataclass
class Model:
    """Differences of log-probabilities, toxic less ordinary, by hash of word, context and pair."""

    words: np.ndarray
    word_diff: np.ndarray
    context_diff: np.ndarray
    pairs: np.ndarray
    pair_diff: np.ndarray
    unknown: float
    margin: float
    weights: np.ndarray

    def differences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean difference per word of each row, 0 without words; difference of each word alone; the words' rows."""
        h, pairs, at, row = _pairs(words)
        alone, _ = _look(self.words, self.word_diff, h, self.unknown)
        before, _ = _look(self.words, self.context_diff, h[at - 1], 0.0)
        joint, hit = _look(self.pairs, self.pair_diff, pairs, 0.0)
        given = alone.copy()
        given[at] = np.where(hit, joint, alone[at] + before)
        n = words.counts()
        return np.bincount(row, given, minlength=len(n)) / np.maximum(n, 1), alone, row

    def score(self, words: Words) -> np.ndarray:
        mean, alone, row = self.differences(words)
        features = _features(mean, _marked(alone, row, words.counts(), self.margin))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -50, 50)))


def _marked(alone: np.ndarray, row: np.ndarray, n: np.ndarray, margin: float) -> np.ndarray:
    return np.bincount(row, np.where(alone > margin, alone, 0.0), minlength=len(n)) / np.maximum(n, 1)


def _words(texts: list[str], most: int = 1 << 20) -> Iterator[Words]:
    """Words of many texts, in parts of bounded size."""
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), most=most):
        yield Words(part.column(0))


def _features(mean: np.ndarray, marked: np.ndarray) -> np.ndarray:
    return np.stack([np.clip(mean, -1, 1), np.log1p(1000 * marked), np.ones(len(mean))], axis=1)


def _kneser_ney(texts: list[list[str]], discount: float) -> dict:
    """Word, context and pair differences from the texts of (ordinary, toxic)."""
    counted, shared = [], []
    for part in texts:
        found = [(h, pairs, h[at - 1], h[at]) for h, pairs, at, _ in map(_pairs, _words(part))] or [(np.zeros(0, np.uint64),) * 4]
        h, pairs, a, b = map(np.concatenate, zip(*found, strict=True))
        keys, first, n = np.unique(pairs, return_index=True, return_counts=True)
        counted.append((np.unique(h), keys, n, a[first], b[first]))
        shared.append(keys)
    every, first = np.unique(np.concatenate(shared), return_index=True)
    left = np.concatenate([c[3] for c in counted])[first]
    right = np.concatenate([c[4] for c in counted])[first]
    words = np.unique(np.concatenate([c[0] for c in counted]))
    of = lambda x: np.searchsorted(words, x)
    size = len(words)
    backoff = (np.bincount(of(right), minlength=size) + 0.5) / (len(every) + 0.5 * (size + 1))
    unseen = 0.5 / (len(every) + 0.5 * (size + 1))
    logs = []
    for _, keys, n, a, b in counted:
        kinds = max(len(keys), 1)
        followed = np.bincount(of(b), minlength=size)
        free = np.minimum(followed, discount).sum() / kinds if len(keys) else 1.0
        p_word = np.maximum(followed - discount, 0) / kinds + free * backoff
        total = np.bincount(of(a), n, minlength=size)
        kept = np.where(total > 0, np.bincount(of(a), np.minimum(n, discount), minlength=size) / np.maximum(total, 1), 1.0)
        seen = np.zeros(len(every))
        seen[np.searchsorted(every, keys)] = n
        p_pair = np.maximum(seen - discount, 0) / np.maximum(total[of(left)], 1) + kept[of(left)] * p_word[of(right)]
        logs.append((np.log(p_word), np.log(kept), np.log(p_pair), np.log(free * unseen)))
    o, t = logs
    told = np.zeros(len(every), dtype=bool)  # the others say what their parts say
    for _, keys, n, _, _ in counted:
        told[np.searchsorted(every, keys[n > discount])] = True
    return {"words": words, "word_diff": t[0] - o[0], "context_diff": t[1] - o[1], "pairs": every[told], "pair_diff": (t[2] - o[2])[told], "unknown": float(t[3] - o[3])}


def _logistic(x: np.ndarray, y: np.ndarray, prior: float = 1e-4, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression with both classes of equal weight, and its loss."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (p - y)) + prior * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + prior * np.eye(x.shape[1])
        w -= np.linalg.solve(hessian, gradient)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -50, 50))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + prior * (w @ w) / 2)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Every fourth row calibrates, the others give the counts.  With one class only, every score is that class's."""
    y = np.asarray(toxic)
    rank = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    held = rank % 4 == 3
    parts = [[t for t, c, h in zip(texts, y, held, strict=True) if c == k and not h] for k in (0, 1)]
    if len(np.unique(y)) < 2:
        model = Model(**_kneser_ney(parts, DISCOUNTS[0]), margin=MARGINS[0], weights=np.zeros(3))
        model.weights[2] = 5.0 if len(y) and y[0] == 1 else -5.0
        return model
    chosen = np.flatnonzero(held) if len(np.unique(y[held])) == 2 else np.arange(len(y))
    parts_held, target = list(_words([texts[i] for i in chosen])), y[chosen].astype(float)
    best: tuple[float, Model] | None = None
    for discount in DISCOUNTS:
        model = Model(**_kneser_ney(parts, discount), margin=MARGINS[0], weights=np.zeros(3))
        seen = [(*model.differences(w), w.counts()) for w in parts_held]
        mean = np.concatenate([m for m, *_ in seen])
        for margin in MARGINS:
            marked = np.concatenate([_marked(alone, row, n, margin) for _, alone, row, n in seen])
            weights, loss = _logistic(_features(mean, marked), target)
            if best is None or loss < best[0]:
                best = loss, replace(model, margin=margin, weights=weights)
    return best[1]


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = CLASS_BYTES) -> DataFrame:
    """(toxic, place, text) of the rows with the smallest hashes of each class, at most so many and so long together; longer texts are cut.

    Rows without id, label or text are passed over; of an id labelled twice the larger label counts.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(remainder("doc_id", 5) != 0)
    ids = [
        (r["doc_id"], r["toxic"], at) for c in (0, 1)
        for at, r in enumerate(usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect())]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int, place int")
    found = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return even_starts(found, "toxic", most).select("toxic", "place", "text")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the sample, fitted in one task, which keeps the texts and the counts off the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        rows = sorted((int(c), int(p), t) for b in batches for c, p, t in zip(b["toxic"], b["place"], b["text"], strict=True))
        yield pd.DataFrame({"model": [pickle.dumps(fit([t for *_, t in rows], [c for c, *_ in rows]))]})

    fitted = sample(docs, labels).repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else fit([], [])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of whole texts; only the text is read.

    NULL and wordless texts get what the calibration says of no evidence.  Equal
    texts have equal scores.  Other columns of ``docs`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(Words(part.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows scored below ``most``, all their columns unchanged; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(text: pa.Array) -> np.ndarray:
        let_go()
        return shared.value.score(Words(text)) < most

    return kept_rows(docs, decide)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, learn(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
