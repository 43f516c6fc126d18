"""Toxicity as severity grades: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all ordered thresholds theta_1 < theta_2. Features are a text's
distinct words and their prefixes of 4 to 7 letters, as 64-bit hashes, so that inflected forms share weights. The labels
say toxic or not; graded findings are made from them: a toxic text is grade 1 or, with more than the median number of
marker features (many times likelier in toxic texts), grade 2.

The model is fitted on the driver from a bounded sample, the `sample` labelled rows of smallest hash (a parameter), and is
a table of at most `most_features` weights, so what is broadcast doesn't grow with the corpus. Scoring is one narrow pass.

Defined results: rows that repeat an id are each scored, and each count as labelled; a null id is scored and has no label; null or empty text has no feature and the grade of the thresholds alone; without labels, or with one
class only, nothing is rejected (severity 0); equal rows score equally; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, pick, stage, texts, trim, unstage, with_ids

PREFIXES = (4, 5, 6, 7)
LEAST_TEXTS = 2  # texts that a feature must be in
LEAST = 3.0  # standard errors by which a feature must be likelier in toxic texts
WORD = re.compile(r"\w+")


class Features:
    """Text -> sorted distinct feature hashes; the features of a word are kept."""

    def __init__(self, most: int = 200_000):
        self.hashes, self.kept, self.most = WordHashes(), {}, most

    def names(self, word: str) -> tuple[int, ...]:
        names = [b"w" + word.encode(), *(b"p" + word[:n].encode() for n in PREFIXES if len(word) >= n)]
        return tuple(self.hashes.hash(n) for n in names)

    def of(self, word: str) -> tuple[int, ...]:
        if word not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[word] = self.names(word)
        return self.kept[word]

    def text(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall(text.lower())) if text else ()
        return np.unique(np.array([h for w in words for h in self.of(w)], np.uint64))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thetas: np.ndarray  # empty: nothing to reject

    def above(self, margin: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thetas - margin, -60, 60)))


class Scorer:
    """Text -> P(grade >= 1), P(grade >= 2), ...; keeps the model's features of every word seen."""

    def __init__(self, model: Model):
        self.model, self.features = model, Features()
        self.weight = dict(zip(model.features.tolist(), model.weights.tolist()))
        self.kept: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not len(self.model.thetas):
            return np.zeros(1)
        if len(self.kept) > 200_000:
            self.kept.clear()
        found: set[int] = set()
        for w in set(WORD.findall(text.lower())) if text else ():
            hit = self.kept.get(w)
            if hit is None:
                self.kept[w] = hit = tuple(h for h in self.features.names(w) if h in self.weight)
            if hit:
                found.update(hit)
        return self.model.above(sum(map(self.weight.__getitem__, sorted(found))))


def telling(labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_features: int, least: float) -> np.ndarray:
    """Which features are likelier in toxic texts, their log odds being `least` standard errors from none: a text's many other
    words would, by their number alone, outweigh the few that matter."""
    toxic = labels[rows] == 1
    pos, neg = np.bincount(cols[toxic], minlength=n_features) + 0.5, np.bincount(cols[~toxic], minlength=n_features) + 0.5
    n_pos, n_neg = (labels == 1).sum() + 1, (labels == 0).sum() + 1
    return np.log(pos / n_pos) - np.log(neg / n_neg) >= least * np.sqrt(1 / pos + 1 / neg)


def graded(labels: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_features: int) -> np.ndarray:
    """Grades 0, 1, 2 of texts labelled 0 or 1, from the number of marker features in the toxic ones."""
    toxic = labels[rows] == 1
    pos, neg = np.bincount(cols[toxic], minlength=n_features), np.bincount(cols[~toxic], minlength=n_features)
    odds = np.log((pos + 0.5) / (labels.sum() + 1)) - np.log((neg + 0.5) / ((labels == 0).sum() + 1))
    marks = np.bincount(rows, odds[cols] > 3, minlength=len(labels))
    return np.where(labels == 1, 1 + (marks > np.median(marks[labels == 1])), 0)


def fit_grades(texts: list[np.ndarray], labels: np.ndarray, most_features: int = 200_000, least_errors: float = LEAST, penalty: float = 1e-4, steps: int = 300) -> Model:
    """Fit on texts' feature hashes and 0/1 labels."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if not len(texts) or len(set(labels.tolist())) < 2:
        return empty
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
    found, cols, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    keep = (times >= LEAST_TEXTS) & telling(labels, owner, cols, len(found), least_errors)
    held = keep[cols]
    features, times, rows, cols = found[keep], times[keep], owner[held], (np.cumsum(keep) - 1)[cols[held]]
    if len(features) > most_features:  # the most frequent ones
        keep = np.zeros(len(features), bool)
        keep[np.argsort(-times, kind="stable")[:most_features]] = True
        held = keep[cols]
        features, rows, cols = features[keep], rows[held], (np.cumsum(keep) - 1)[cols[held]]
    if not len(features):
        return empty
    grades = graded(labels, rows, cols, len(features))
    k = int(grades.max())
    share = np.array([(grades >= i).mean() for i in range(1, k + 1)])
    start = np.log((1 - share) / share)
    w, p = np.zeros(len(features)), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, p)]
    n, i = len(labels), np.arange(len(labels))
    for step in range(1, steps + 1):
        thetas = np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))
        margin = np.bincount(rows, w[cols], minlength=n)
        edges = np.column_stack([np.zeros(n), 1 / (1 + np.exp(-np.clip(thetas - margin[:, None], -60, 60))), np.ones(n)])
        prob = np.maximum(edges[i, grades + 1] - edges[i, grades], 1e-12)
        slope = edges * (1 - edges)
        of_margin = (slope[i, grades + 1] - slope[i, grades]) / prob / n  # of the loss
        of_theta = np.zeros((n, k + 2))
        of_theta[i, grades + 1] -= slope[i, grades + 1] / prob / n
        of_theta[i, grades] += slope[i, grades] / prob / n
        g = of_theta[:, 1:-1].sum(0)
        tail = np.cumsum(g[::-1])[::-1]
        grad_w = np.bincount(cols, of_margin[rows], minlength=len(w)) + penalty * w
        grad_p = np.concatenate([tail[:1], tail[1:] * np.exp(p[1:])])
        for x, gradient, (m, v) in zip((w, p), (grad_w, grad_p), state):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(features, w, np.cumsum(np.concatenate([p[:1], np.exp(p[1:])])))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5_000, most_features: int = 200_000) -> Model:
    """Fit on the `sample` rows of smallest hash among those of the `sample` labels of smallest hash, and the `most_features` features
    in most texts of those that speak for toxicity. Features are counted by the executors; the driver gets those that are kept."""
    spark = docs.sparkSession
    labelled = pick(labels, doc_id="long", toxic="int").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "toxic": b["toxic"], "x": [features.text(t).view(np.int64) for t in b["text"]]})
        trim()

    held, at = stage(rows.mapInPandas(run, "key long, toxic int, x array<long>").orderBy("key", "toxic").limit(sample).repartition("key"), "labelled")
    n = held.agg(F.sum("toxic").alias("pos"), F.count("*").alias("all")).first()
    pos, neg = F.sum("toxic") + 0.5, F.sum(1 - F.col("toxic")) + 0.5
    each = held.select("toxic", F.explode("x").alias("f")).groupBy("f").agg(pos.alias("pos"), neg.alias("neg"))
    odds = F.log(F.col("pos") / ((n.pos or 0) + 1)) - F.log(F.col("neg") / (n.all - (n.pos or 0) + 1))
    each = each.where((F.col("pos") + F.col("neg") >= LEAST_TEXTS + 1) & (odds >= 0.999 * LEAST * F.sqrt(1 / F.col("pos") + 1 / F.col("neg"))))
    kept = np.sort(np.array([r.f for r in each.orderBy(F.desc(F.col("pos") + F.col("neg")), "f").limit(most_features).select("f").collect()], np.int64))

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(x=[np.asarray(x)[np.isin(x, kept)].tobytes() for x in b["x"]])
        trim()

    got = held.mapInPandas(only, "key long, toxic int, x binary").orderBy("key", "toxic").collect()
    unstage(spark, at)
    return fit_grades([np.sort(np.frombuffer(r.x, np.uint64)) for r in got], np.array([r.toxic for r in got], np.int64), most_features)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, grade (the likeliest), severity (expected grade), p_toxic (grade 1 or more), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = []
            for text in b["text"]:
                above = scorer(text)
                each = -np.diff(np.concatenate([[1.0], above, [0.0]]))
                out.append((int(each.argmax()), float(above.sum()), float(above[0]), bool(above[0] >= 0.5)))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["grade", "severity", "p_toxic", "rejected"])], axis=1)
        trim()

    return with_ids(texts(docs).mapInPandas(run, "doc_id string, grade int, severity double, p_toxic double, rejected boolean"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected; the text is scored in place, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for t in texts:
            yield pd.Series([bool(scorer(x)[0] >= 0.5) for x in t], dtype="boolean")
        trim()

    return docs.where(~rejected(F.col("text").cast("string")))
