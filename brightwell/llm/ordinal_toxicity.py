"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= g) = logistic(threshold[g] - w.x), with one weight vector for all ordered thresholds.
Features are the presence of words and word beginnings that a first pass over a bounded labelled
sample found to tell toxic texts from others. The expected grade is the severity.
"""
from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import held_out, materialize, slices, text_of

#: Fixed: what parts the words of features; A-Z are lower-cased before.
EDGES = r"[\s!-/:-@\[-`{-~]+"


@dataclass
class OrdinalModel:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > g) for each threshold g, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -500, 500)))


def word_list(text: str) -> list[str]:
    import re

    return [w for w in re.split(EDGES, text.lower()) if w]


#: Word beginnings of these lengths are features too, and so is meeting a feature this often.
BEGINNINGS, OFTEN = (5, 7), 3


def features(text: str) -> set[str]:
    """The text's words, beginnings of longer words (^...), and those of both that occur OFTEN times or more (...+)."""
    counts = Counter(word_list(text))
    for w, n in list(counts.items()):
        for size in BEGINNINGS:
            if len(w) > size:
                counts["^" + w[:size]] += n
    return counts.keys() | {f + "+" for f, n in counts.items() if n >= OFTEN}


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, levels: int, ridge: float = 1e-5, steps: int = 800, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) of the cumulative logit model, by Adam on the mean loss.

    rows: the numbers of the features present. Weights are kept from going below 0: a feature that
    marks toxic texts never excuses one. Thresholds are a first one and positive steps, so their order can't break.
    """
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, row = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)
    share = np.clip([(grades > g).mean() for g in range(levels - 1)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(levels - 1))
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, steps_up = p[:features], np.exp(p[features + 1 :])
        cuts = np.concatenate((p[features : features + 1], p[features] + np.cumsum(steps_up)))
        margin = np.bincount(row, w[flat], len(rows))
        # ends of each row's interval, P(grade <= g) at its upper and lower cut
        bounds = np.concatenate(([-np.inf], cuts, [np.inf]))
        hi, lo = 1 / (1 + np.exp(-(bounds[grades + 1] - margin))), 1 / (1 + np.exp(-(bounds[grades] - margin)))
        own = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / own, lo * (1 - lo) / own
        to_margin = (d_hi - d_lo) / len(rows)
        g = np.zeros_like(p)
        g[:features] = np.bincount(flat, to_margin[row], features) + ridge * w
        to_cut = (np.bincount(grades, -d_hi, levels)[: levels - 1] + np.bincount(grades, d_lo, levels)[1:levels]) / len(rows)
        g[features] = to_cut.sum()
        g[features + 1 :] = np.cumsum(to_cut[::-1])[::-1][1:] * steps_up
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p[:features] = np.maximum(p[:features], 0)
        rate *= 0.995
    cuts = np.concatenate((p[features : features + 1], p[features] + np.cumsum(np.exp(p[features + 1 :]))))
    return p[:features], cuts


def _sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(text, toxic) of at most most_rows labelled ids that aren't held out, those of the smallest hashes; equal texts count once."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = rows.select(F.col("doc_id").alias("label_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    texts = text_of(docs, "doc_id", "text")
    found = texts.join(F.broadcast(rows), texts["doc_id"] == rows["label_id"])  # bounded by most_rows
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _listed(batches):
    """(toxic, word): each document's features."""
    for b in batches:
        found = [sorted(features(t)) for t in b.column("text").to_pylist()]
        toxic = b.column("toxic").to_numpy().repeat(list(map(len, found)))
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([w for f in found for w in f], pa.string())], ["toxic", "word"])


def _likelihood_term(count, expected):
    return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)


def telling_words(sample: DataFrame, most_words: int = 1024, least_docs: int = 5) -> list[str]:
    """The features that mark toxic texts, the surest first: at most most_words.

    Sure: the root of the likelihood ratio statistic G2 of feature and label; 4 or more. Unlike
    smoothed odds it grows with a feature that other texts never have, so these come before those
    that some group of alike texts shares.
    """
    total = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not total[0] or not total[1]:
        return []
    toxic, other = F.lit(float(total[0])), F.lit(float(total[1]))
    counts = sample.select("text", "toxic").mapInArrow(_listed, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    t, o, share = F.col("t"), F.col("o"), (F.col("t") + F.col("o")) / (toxic + other)
    g2 = 2 * (_likelihood_term(t, toxic * share) + _likelihood_term(o, other * share) + _likelihood_term(toxic - t, toxic * (1 - share)) + _likelihood_term(other - o, other * (1 - share)))
    best = counts.where((t >= least_docs) & (t / toxic > o / other)).withColumn("sure", F.sqrt(F.greatest(g2, F.lit(0.0))))
    return [r["word"] for r in best.where("sure >= 4").orderBy(F.desc("sure"), "word").limit(most_words).collect()]


def _marked(words):
    """(toxic, numbers): each document's features among the telling ones, by number."""

    def run(batches):
        number = words.value
        for b in batches:
            texts = b.column("text").to_pylist()
            held = [sorted(number[f] for f in features(t) if f in number) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(held, pa.list_(pa.int32()))], ["toxic", "numbers"])

    return run


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, features: int, folds: int = 2, steps: int = 400) -> np.ndarray:
    """Grades 0 (not toxic), 1 and 2 of texts whose labels only say toxic or not.

    Each fold's texts are scored by a binary model that is fitted on the other folds, so no text's own
    label sets its grade: a toxic text is 2 where that score is at least the median of its fold's toxic
    texts, that is, where others' labels make it plainly toxic, and 1 where they leave it in doubt.
    Texts with equal features are in one fold. A fold without toxic texts elsewhere has grade 2 only.
    """
    fold = np.array([zlib.crc32(r.astype("<i8").tobytes()) % folds for r in rows], np.int64)
    grades = np.zeros(len(rows), np.int64)
    for f in range(folds):
        own = np.flatnonzero((fold == f) & (toxic == 1))
        if len(own):
            others = np.flatnonzero(fold != f)
            weights = fit_ordinal([rows[i] for i in others], toxic[others], features, 2, steps=steps)[0] if toxic[others].any() else np.zeros(features)
            margin = np.array([weights[rows[i]].sum() for i in own])
            grades[own] = np.where(margin >= np.median(margin), 2, 1)
    return grades


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_words: int = 1024) -> OrdinalModel:
    """The model of grades 0 (labelled not toxic), 1 and 2 (labelled toxic, see severity_grades).

    Only at most 2 x most_rows lists of at most most_words numbers reach the driver.
    """
    sample = materialize(_sample(docs, labels, most_rows), "toxic-sample")
    words = telling_words(sample, most_words)
    if not words:
        return OrdinalModel({}, np.empty(0), np.array([8.0, 9.0]))
    number = {w: i for i, w in enumerate(words)}
    shared = docs.sparkSession.sparkContext.broadcast(number)
    rows = sample.select("text", "toxic").mapInArrow(_marked(shared), "toxic int, numbers array<int>").limit(2 * most_rows).collect()
    rows = sorted((r["toxic"], tuple(r["numbers"])) for r in rows)
    toxic = np.array([r[0] for r in rows])
    held = [np.array(r[1], np.int64) for r in rows]
    weights, thresholds = fit_ordinal(held, severity_grades(held, toxic, len(words)), len(words), 3)
    return OrdinalModel(number, weights, thresholds)


def _score(parts, threshold: float):
    """parts: the model's fields, broadcast as plain values, for broadcasts are unpickled by name and executors have no copy of the package."""

    def run(batches):
        m = OrdinalModel(*parts.value)
        for batch in batches:
            for b in slices(batch, "text"):
                held = [sorted(m.words[f] for f in features(t) if f in m.words) for t in b.column("text").to_pylist()]
                margin = np.array([m.weights[np.array(h, np.int64)].sum() for h in held], np.float64)
                above = m.exceed(margin)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array((above[:, 0] >= threshold).astype(np.int32))], ["doc_id", "score", "severity", "toxic"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000, most_words: int = 1024) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of a grade above 0), severity (expected grade, 0 to 2), toxic (score >= threshold).

    Features are telling words and beginnings that at least 5 toxic texts of the sample have (telling_words), their weights
    are not below zero (fit_ordinal), and severity's grades come from out-of-fold scores (severity_grades): it says how surely
    other texts' labels make a text toxic, as labels hold no grades of their own.

    The whole text is read, in one pass without a shuffle (only training's bounded sample is grouped);
    the model, at most most_words weights, is broadcast. A null or empty text has no features and scores the base rate; a null doc_id stays;
    repeated rows repeat; an empty table gives no rows; without labels of both kinds nothing is
    toxic. Other columns are ignored.
    """
    model = train(docs, labels, most_rows, most_words)
    parts = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.thresholds))
    scored = text_of(docs, "doc_id", "text").mapInArrow(_score(parts, threshold), "doc_id long, score double, severity double, toxic int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "severity", "toxic")
