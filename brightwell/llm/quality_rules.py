"""Quality classifier: a sparse ensemble of rules.

Small boosted trees over text statistics are grown on a bounded sample of labelled rows; every path
from a root becomes a rule, a conjunction of comparisons of statistics. A logistic fit with an L1
penalty (lasso) keeps few rules, and these are compiled into one Spark column expression that scores
every whole text inside the JVM.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import columns_of, held_out

SPACE = r"[\x20\x09-\x0D]+"


def _kept(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all finite, also for an empty one; in terms of `_n`, `_words`, `_lines` (see with_statistics)."""
    n, words, lines = F.greatest(F.col("_n"), F.lit(1.0)), F.greatest(F.size("_words"), F.lit(1)).cast("double"), F.greatest(F.size("_lines"), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p("_n"),
        "word_length": F.col("_n") / words,
        "words_a_line": words / lines,
        "distinct_words": F.size(F.array_distinct("_words")) / words,
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "letters": _kept(text, r"[^\p{L}]+") / n,
        "capitals": _kept(text, r"[^\p{Lu}]+") / n,
        "digits": _kept(text, r"[^0-9]+") / n,
        "stops": _kept(text, r"[^.!?;:,]+") / n,
        "shouts": _kept(text, r"[^!?]+") / n,
        "symbols": _kept(text, r"[\p{L}\p{N}\s.,;:!?'\"()-]+") / n,
        "spaces": _kept(text, r"\S+") / n,
    }


NAMES = ["log_chars", "word_length", "words_a_line", "distinct_words", "distinct_lines", "letters", "capitals", "digits", "stops", "shouts", "symbols", "spaces"]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text (null: empty)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    rows = rows.select("doc_id", "text", F.length("text").cast("double").alias("_n"), words.alias("_words"), F.split("text", "\n").alias("_lines"))
    return rows.select("doc_id", *(c.cast("double").alias(name) for name, c in statistics(F.col("text")).items()))


@dataclass(frozen=True)
class Rule:
    """All of (statistic's number, True for <=, threshold)."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for j, low, at in self.tests:
            found &= (x[:, j] <= at) == low
        return found

    def column(self) -> Column:
        found = F.lit(True)
        for j, low, at in self.tests:
            c = F.col(NAMES[j])
            found = found & ((c <= at) if low else (c > at))
        return found


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for w, r in zip(self.weights, self.rules)), np.zeros(len(x))))))

    def column(self) -> Column:
        """The score as one expression over the columns of with_statistics."""
        total = F.lit(float(self.bias))
        for w, r in zip(self.weights, self.rules):
            total = total + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, tests: tuple, out: list[Rule], least: int) -> list[tuple[tuple, float]]:
    """Adds the rule of each node below the root to `out`; returns (tests, value) of the leaves."""
    value = -gradient.sum() / (hessian.sum() + 1.0)
    best = (1e-6, None)
    if depth and len(x) >= 2 * least:
        whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            bins = np.searchsorted(at, x[:, j], side="left")
            g, h, n = (np.cumsum(np.bincount(bins, w, len(at) + 1))[:-1] for w in (gradient, hessian, np.ones(len(x))))
            gain = g**2 / (h + 1.0) + (gradient.sum() - g) ** 2 / (hessian.sum() - h + 1.0) - whole
            gain[(n < least) | (len(x) - n < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), (j, float(at[gain.argmax()])))
    if best[1] is None:
        return [(tests, value)]
    j, at = best[1]
    leaves = []
    for low in (True, False):
        own, side = (*tests, (j, low, at)), (x[:, j] <= at) == low
        out.append(Rule(own))
        leaves += _grow(x[side], cuts, gradient[side], hessian[side], depth - 1, own, out, least)
    return leaves


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, seed: int) -> list[Rule]:
    """The rules of boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    share = y.mean()
    margin, found = np.full(len(x), math.log(share / (1 - share))), []
    for _ in range(trees):
        rows = rng.random(len(x)) < 0.5
        p = 1 / (1 + np.exp(-margin))
        for tests, value in _grow(x[rows], cuts, (p - y)[rows], (p * (1 - p))[rows], depth, (), found, max(5, len(x) // 400)):
            margin += rate * value * Rule(tests).holds(x)
    return list(dict.fromkeys(found))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) of the least mean logistic loss plus penalty x sum of absolute weights; the bias is free. FISTA."""
    a1 = np.hstack([a, np.ones((len(a), 1))])
    step = 4.0 / max(1e-9, np.linalg.norm(a1, 2) ** 2 / len(a))
    w = z = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(steps):
        move = z - step * a1.T @ (1 / (1 + np.exp(-(a1 @ z))) - y) / len(y)
        new = np.append(np.sign(move[:-1]) * np.maximum(np.abs(move[:-1]) - step * penalty, 0), move[-1])
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, z = new, new + (before - 1) / t * (new - w)
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 1e-4, most_rules: int = 60, seed: int = 7) -> RuleModel:
    """A model of at most most_rules rules: the penalty is doubled until no more are left. With one class only, its share is the score."""
    if not len(y) or y.min() == y.max():
        return RuleModel([], np.empty(0), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rules = tree_rules(x, y, trees, depth, rate, seed)
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64) if rules else np.empty((len(y), 0))
    while True:
        weights, bias = lasso_logistic(a, y, penalty)
        if np.count_nonzero(weights) <= most_rules:
            break
        penalty *= 2
    kept = np.flatnonzero(weights)
    return RuleModel([rules[i] for i in kept], weights[kept], bias)


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with quality, for a sample of at most most_rows labelled ids that aren't held out.

    The sample is that of the smallest hashes of the id, so it is the same wherever it is drawn. It
    is broadcast: most_rows bounds it. Several labels of an id: the smallest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = rows.select(F.col("doc_id").alias("label_id"), (F.col("quality") > 0).cast("double").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))  # no other column, whose name could clash
    return texts.join(F.broadcast(rows), texts["doc_id"] == rows["label_id"]).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **fit) -> RuleModel:
    """A model of labels.quality from at most most_rows labelled documents (several texts of an id: all of them, up to twice that)."""
    sample = training_rows(docs, labels, most_rows)
    rows = with_statistics(sample.select(F.struct("doc_id", "label").alias("both"), "text"), "both").select(F.col("doc_id.label").alias("label"), *NAMES)
    got = rows.limit(2 * most_rows).toPandas()
    order = np.lexsort(got[[*NAMES, "label"]].to_numpy().T)  # the same model whatever the order of rows
    return fit_rules(got[NAMES].to_numpy(np.float64)[order], got["label"].to_numpy(np.float64)[order], **fit)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Score is the probability of quality 1, from the text alone; predicted is 1 from `threshold` on.
    Ids whose crc32 (as text) is divisible by 5 are held out of training. A null or empty text is
    scored like any other; a null doc_id stays and its crc32 is that of the empty text; repeated
    rows repeat; an empty table gives no rows. Without labels the score is 0.5; with labels of one
    class only, near to that class. Other columns are ignored. One pass without a shuffle.
    """
    model = train(docs, labels, most_rows)
    scored = with_statistics(docs).select("doc_id", held_out("doc_id").alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """docs (all its columns) whose score is `threshold` or more, in the same single pass.

    A null text is scored as an empty one and stays null; a null doc_id is never a label's; repeated
    rows go or stay together; an empty table gives no rows.
    """
    model = train(docs, labels, most_rows)
    packed = docs.select(F.struct(*columns_of(docs)).alias("doc"), "text")
    scored = with_statistics(packed, "doc").where(model.column() >= threshold)
    return scored.select("doc_id.*")
