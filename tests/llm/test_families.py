"""Near copies of one text, each with edits of its own: the pairs looked at follow the places where edits meet."""
from itertools import combinations

import numpy as np

from brightwell.llm import common, minhash_bands
from tests.llm.cases import word_jaccard
from tests.llm.test_round4 import hashed


def edited(rng, words, edits, mark):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"{mark}x{at}"
    return " ".join(words)


def alike(texts):
    return {(i, j) for i, j in combinations(texts, 2) if word_jaccard(texts[i].encode(), texts[j].encode()) >= 0.8}


def test_edited_copies_meet_where_their_edits_do(spark):
    """300 texts with three edits each, the text that they come from not among them: nearly all their 44,850 pairs are unlike."""
    rng = np.random.default_rng(11)
    texts = {i: edited(rng, [f"w{x}" for x in range(150)], 3, f"new{i}") for i in range(300)}
    nodes, grams_of = hashed(spark, texts)
    given = nodes.selectExpr("key", "struct(least, key) text", "n")
    pairs = {(r["src"], r["dst"]) for r in minhash_bands._by_prefix(given, grams_of(given.select("key"))).collect()}
    assert alike(texts) <= pairs
    assert len(pairs) < 10_000


def test_no_alike_pair_of_a_family_is_missed(spark):
    """Families of other lengths and counts of edits, cut ends, short texts and one that is alone."""
    rng = np.random.default_rng(12)
    texts, family = {0: "alone", 1: "a b", 2: "b c", 3: "a b c d e f", 4: "a b c d e f g"}, {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
    for base, (length, most) in enumerate([(12, 2), (40, 3), (100, 5), (100, 12), (300, 9)]):
        for i in range(40):
            words = [f"b{base}w{x}" for x in range(length)][: length - int(rng.integers(0, 1 + length // 8))]
            texts[k := len(texts)] = edited(rng, words, int(rng.integers(0, most + 1)), f"new{i % 9}")
            family[k] = base % 3 + 2
    nodes, grams_of = hashed(spark, texts)
    given = nodes.selectExpr("key", "struct(least, key) text", "n")
    families = common.materialize(spark.createDataFrame([*family.items()], "key long, family long"), "test")
    for some in (given, given.join(families, "key")):
        pairs = {(r["src"], r["dst"]) for r in minhash_bands._by_prefix(some, grams_of(some.select("key"))).collect()}
        assert len(found := alike(texts)) > 300 and found <= pairs


def test_families_are_of_texts_that_buckets_connect(spark):
    rows = [((i, i), 5, b) for i, bs in enumerate([[1, 2], [2], [2, 3], [3], [4], [4], [5]]) for b in bs]
    members = common.materialize(spark.createDataFrame(rows, "text struct<least: long, key: long>, n long, bucket long"), "test")
    assert {r["key"]: r["family"] for r in minhash_bands._families(members).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
