"""Classifiers: parts against brute force, held-out accuracy, awkward rows."""
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from brightwell.llm import ordinal_toxicity, quality_rules
from brightwell.llm.queries import op1_quality, op5_toxicity
from brightwell.sources import read_table
from tests.llm.cases import AWKWARD, by_key, documents, frame

ROOT = Path(__file__).resolve().parents[2]
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rules_agree_in_numpy_and_spark(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(quality_rules.NAMES)))
    model = quality_rules.fit_rules(x, (x[:, 2] + 0.3 * (x[:, 5] > 0.5) > 0.7).astype(float), trees=5)
    assert 0 < len(model.rules) <= 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{n} double" for n in quality_rules.NAMES))
    found = [r[0] for r in df.select(model.column()).collect()]
    assert found == pytest.approx(model.score(x[:50]).tolist(), abs=1e-12)


def test_lasso_drops_what_tells_nothing():
    rng = np.random.default_rng(4)
    a = (rng.random((2000, 20)) < 0.5).astype(float)
    y = (a[:, 3] > 0).astype(float)
    weights, _ = quality_rules.lasso_logistic(a, y, 0.02)
    assert weights[3] > 1 and np.count_nonzero(weights) <= 3


def test_quality_of_held_out_rows(spark):
    scored = op1_quality(spark, MIDDLE)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scored.count() == 10_000
    rows = scored.where("held_out").join(read_table(spark, MIDDLE, "labels"), "doc_id").collect()
    assert len(rows) > 500
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    clean = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(clean) > 0.99


def test_quality_without_labels_or_rows(spark):
    none = labels_of(spark, [])
    found = quality_rules.score_quality(frame(spark, AWKWARD), none).collect()
    assert len(found) == len(AWKWARD) and {r["score"] for r in found} == {0.5}
    some = labels_of(spark, [(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (8, 1, 0), (8, 0, 0), (12, 1, 0)])
    found = quality_rules.score_quality(frame(spark, AWKWARD), some).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert quality_rules.score_quality(frame(spark, []), some).count() == 0
    kept = quality_rules.drop_low_quality(frame(spark, AWKWARD), none)
    assert kept.columns == frame(spark, []).columns and kept.count() == len(AWKWARD)


def test_ordinal_fit_finds_order_and_weights():
    rng = np.random.default_rng(6)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(3000)]
    margin = np.array([2.5 * (0 in r) + 1.5 * (1 in r) for r in rows]) + rng.logistic(size=3000)
    grades = np.digitize(margin, [1.0, 3.0])
    weights, cuts = ordinal_toxicity.fit_ordinal(rows, grades, 6, 3)
    assert weights[:2] == pytest.approx([2.5, 1.5], abs=0.35) and np.abs(weights[2:]).max() < 0.3
    assert cuts == pytest.approx([1.0, 3.0], abs=0.35)


def test_toxicity_of_held_out_rows(spark):
    scored = op5_toxicity(spark, MIDDLE)
    assert scored.count() == 10_000
    rows = scored.where("held_out").join(read_table(spark, MIDDLE, "labels").withColumnRenamed("toxic", "label"), "doc_id").collect()
    toxic = [r for r in rows if r["label"] == 1]
    clean = [r for r in rows if r["label"] == 0]
    assert len(toxic) > 50
    assert np.mean([r["toxic"] for r in toxic]) > 0.85 and np.mean([r["toxic"] for r in clean]) < 0.02
    assert all(0 <= r["severity"] <= 2 and r["score"] <= 1 for r in rows)


def test_toxicity_of_awkward_rows(spark):
    some = labels_of(spark, [(1, 1, 0), (2, 0, None), (8, 1, 1), (None, 1, 1)])
    for labels in (some, labels_of(spark, [])):
        found = ordinal_toxicity.score_toxicity(frame(spark, AWKWARD), labels).collect()
        assert len(found) == len(AWKWARD) and not any(r["toxic"] for r in found)
    assert ordinal_toxicity.score_toxicity(frame(spark, []), some).count() == 0


def test_telling_words_come_before_those_of_alike_texts(spark):
    rows = [(f"mark a{i}", 1) for i in range(200)] + [(f"plain b{i}", 0) for i in range(1500)]
    rows += [(" ".join(f"alike{j}" for j in range(300)) + f" {i}", int(i % 5 < 3)) for i in range(60)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    found = ordinal_toxicity.telling_words(sample, most_words=20)
    assert found[0] == "mark" and len(found) == 20
    assert ordinal_toxicity.telling_words(sample.where("toxic = 0")) == []


def test_equal_texts_count_once(spark):
    rows = [(i, f"word{i % 3}") for i in range(60)]
    labels = labels_of(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)])
    found = ordinal_toxicity._sample(frame(spark, rows), labels, 100).collect()
    assert sorted((r["text"], r["toxic"]) for r in found) == [("word0", 1), ("word1", 0), ("word2", 0)]


def test_the_model_reaches_tasks_as_plain_values():
    """Executors have no copy of the package, and broadcasts are unpickled by name."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from brightwell.llm.queries import op5_toxicity
print("rows", op5_toxicity(spark, "/root/testdata/sf0.001").count())
op5_toxicity(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("scored")
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert "scored" in done.stdout, done.stderr[-2000:]


def test_features():
    assert ordinal_toxicity.features("It's a-b  Longest longest, LONGEST") == {"it", "s", "a", "b", "longest", "^longe", "longest+", "^longe+"}
    assert ordinal_toxicity.features("") == set()


def test_clashing_columns_change_nothing(spark):
    """Columns named like those that training uses, on documents and on labels."""
    rows = [(i, f"word {i} " * (i % 7 + 1) + "!" * (i % 2 * 9)) for i in range(60)]
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(60)])
    docs = frame(spark, rows)
    more = docs.selectExpr("*", "'x' label", "'x' label_id", "'x' _n", "'x' text_", "'x' doc", "'x' quality", "'x' toxic", "'x' `a.b`")
    wide = labels.selectExpr("*", "'x' text", "'x' label", "'x' label_id")
    plain = quality_rules.score_quality(docs, labels).collect()
    assert sorted(map(tuple, quality_rules.score_quality(more, wide).collect())) == sorted(map(tuple, plain))
    kept = quality_rules.drop_low_quality(more, wide)
    assert kept.columns == more.columns and kept.count() == sum(r["predicted"] for r in plain)


def test_held_out_rows_are_never_learned_from(spark):
    """held_out is zlib's crc32 of the id, and other labels there change no score."""
    import zlib

    rows = [(i, f"word {i} " * (i % 7 + 1) + "!" * (i % 2 * 9)) for i in range(80)]
    out = {i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0}
    found = []
    for turned in (False, True):
        labels = labels_of(spark, [(i, (i + (turned and i in out)) % 2, (i + (turned and i in out)) % 2) for i in range(80)])
        scored = quality_rules.score_quality(frame(spark, rows), labels).collect()
        assert {r["doc_id"] for r in scored if r["held_out"]} == out
        found.append(sorted(map(tuple, scored)))
    assert found[0] == found[1]


ODD = [(900, "ÀÉ Ünï 123!?  €§\u00a0x\n\n\tTab\x0b\x0c \x1c"), (901, "\n"), (902, "\U0001f600" * 9), (903, "!" * 50 + "\r\n" + "A" * 20)]


def statistics_by_hand(text):
    import regex

    text = text or ""
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    listed = text.split("\n")
    n, words, lines = max(len(text), 1), max(len(found), 1), len(listed)

    def share(pattern):
        return len(regex.findall(pattern, text)) / n

    return {
        "log_chars": math.log1p(len(text)), "word_length": len(text) / words, "words_a_line": words / lines,
        "distinct_words": len(set(found)) / words, "distinct_lines": len(set(listed)) / lines, "letters": share(r"\p{L}"),
        "capitals": share(r"\p{Lu}"), "digits": share("[0-9]"), "stops": share("[.!?;:,]"), "shouts": share("[!?]"),
        "symbols": share(r"""[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'"()-]"""), "spaces": share(r"[\x20\x09-\x0D]"),
    }


def test_quality_scores_by_hand(spark):
    """Statistics, rules and weights of whole texts, recomputed one text at a time."""
    rows = AWKWARD + ODD + [(1000 + i, t) for i, t in documents(SMALL)]
    docs = frame(spark, rows)
    by_hand = [(i, statistics_by_hand(t)) for i, t in rows]
    found = quality_rules.with_statistics(docs).collect()
    assert len(found) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r["doc_id"], *(r[n] for n in quality_rules.NAMES)) for r in found), key=key)
    want = sorted(((i, *(s[n] for n in quality_rules.NAMES)) for i, s in by_hand), key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    np.testing.assert_allclose([r[1:] for r in got], [r[1:] for r in want], rtol=1e-12, atol=0)
    labels = read_table(spark, SMALL, "labels").selectExpr("doc_id + 1000 doc_id", "quality", "toxic")
    model = quality_rules.train(docs, labels)
    assert model.rules
    want = []
    for i, s in by_hand:
        margin = model.bias
        for w, rule in zip(model.weights, model.rules):
            if all((s[quality_rules.NAMES[j]] <= at) == low for j, low, at in rule.tests):
                margin += w
        want.append((i, round(1 / (1 + math.exp(-margin)), 9)))
    scored = quality_rules.score_quality(docs, labels).collect()
    assert by_key((r["doc_id"], round(r["score"], 9)) for r in scored) == by_key(want)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    kept = quality_rules.drop_low_quality(docs, labels).collect()
    assert by_key((r["doc_id"], r["text"] or "") for r in kept) == by_key((i, t or "") for (i, t), (_, score) in zip(rows, want) if score >= 0.3)


def features_by_hand(text):
    words = [w for w in re.split(r"""[\s!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+""", text.lower()) if w]
    counts = Counter(words + [f"^{w[:n]}" for w in words for n in (5, 7) if len(w) > n])
    return set(counts) | {f"{f}+" for f in counts if counts[f] >= 3}


def test_toxicity_scores_by_hand(spark):
    """Score and severity of whole texts from the model's weights and thresholds, one text at a time."""
    rows = AWKWARD + ODD + [(1000 + i, t) for i, t in documents("/root/testdata/sf0.01")]
    docs = frame(spark, rows)
    labels = read_table(spark, "/root/testdata/sf0.01", "labels").selectExpr("doc_id + 1000 doc_id", "quality", "toxic")
    model = ordinal_toxicity.train(docs, labels)
    assert model.words and model.thresholds[0] < model.thresholds[1] and (model.weights >= 0).all()
    want = []
    for i, t in rows:
        margin = sum(model.weights[n] for f, n in model.words.items() if f in features_by_hand(t or ""))
        above = [1 / (1 + math.exp(cut - margin)) for cut in model.thresholds]
        want.append((i, round(above[0], 9), round(sum(above), 9), int(above[0] >= 0.3)))
    found = ordinal_toxicity.score_toxicity(docs, labels).collect()
    assert by_key((r["doc_id"], round(r["score"], 9), round(r["severity"], 9), r["toxic"]) for r in found) == by_key(want)


def test_severity_grades_come_from_other_texts():
    """A toxic text's grade doesn't hang on its own label, and doubtful ones get the lower grade."""
    rng = np.random.default_rng(3)
    rows, toxic = [], []
    for n in range(600):
        noise = 10 + np.flatnonzero(rng.random(30) < 0.2)
        kind = n % 3  # plainly toxic, in doubt (features that others have too), not toxic
        rows.append(np.concatenate(([0, 1] if kind == 0 else [2] if kind == 1 or n % 2 else [], noise)).astype(np.int64))
        toxic.append(int(kind < 2))
    grades = ordinal_toxicity.severity_grades(rows, np.array(toxic), 40)
    assert (grades[2::3] == 0).all() and set(grades) == {0, 1, 2}
    assert (grades[0::3] == 2).mean() > 0.95 and (grades[1::3] == 1).mean() > 0.95
    assert ordinal_toxicity.severity_grades([np.array([1])], np.array([1]), 3).tolist() == [2]


def test_toxicity_never_learns_from_held_out_rows(spark):
    import zlib

    rows = [(i, f"{'vile awful' if i % 3 == 0 else 'mild pleasant'} word{i} " * (i % 4 + 1)) for i in range(240)]
    out = {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    more = frame(spark, rows).selectExpr("*", "'x' label_id", "'x' toxic", "'x' word", "'x' `a.b`")
    found = []
    for turned in (False, True):
        labels = labels_of(spark, [(i, 1, int((i % 3 == 0) != (turned and i in out))) for i in range(240)])
        scored = ordinal_toxicity.score_toxicity(more, labels).collect()
        assert {r["doc_id"] for r in scored if r["held_out"]} == out
        assert all(r["toxic"] == int(r["doc_id"] % 3 == 0) for r in scored)
        found.append(sorted(map(tuple, scored)))
    assert found[0] == found[1]
