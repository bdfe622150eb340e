"""Pairs that no hub meets, fingerprints that share quarters, and pairs carried over groups of candidates."""
import numpy as np
import pyarrow as pa

from brightwell.llm import block_ann, common, minhash_bands, simhash_ball
from tests.llm.cases import word_jaccard


def hashed(spark, texts):
    """(nodes in one bucket, grams_of) of texts by id."""
    grams = {i: minhash_bands.grams(t.encode()) for i, t in texts.items()}
    nodes = spark.createDataFrame([(i, i, len(g), [7]) for i, g in grams.items()], "key long, least long, n long, bands array<long>")
    table = common.materialize(spark.createDataFrame([(i, bytearray(g.tobytes())) for i, g in grams.items()], "key long, grams binary"), "test")
    return common.materialize(nodes, "test"), lambda keys: table.join(keys, "key", "left_semi")


def test_alike_texts_that_no_hub_meets_are_found(spark):
    """A bucket of 100 texts that share a passage; ten pairs of them are alike, and none is alike to a hub."""
    passage = [f"p{j}" for j in range(40)]
    texts = {i: " ".join(passage + [f"w{i}-{j}" for j in range(30)]) for i in range(100)}
    for i in range(50, 60):
        texts[i + 30] = texts[i] + " end"
    gone = minhash_bands.lost_texts(*hashed(spark, texts))
    assert sorted(r["key"] for r in gone.collect()) == list(range(80, 90))


def test_texts_that_stay_after_all_are_compared(spark):
    """Random edits of a few texts in one bucket: no alike pair stays, and what goes has an alike text that stays."""
    rng = np.random.default_rng(5)
    texts = {}
    for i in range(120):
        words = [f"b{i % 4}w{x}" for x in range(100)]
        for at in rng.choice(100, int(rng.integers(0, 5)), replace=False):
            words[at] = f"new{i % 7}x{at}"
        texts[i] = " ".join(words)
    for comparisons in (0, 1, 2):
        gone = {r["key"] for r in minhash_bands.lost_texts(*hashed(spark, texts), comparisons=comparisons).collect()}
        stay = [t.encode() for i, t in texts.items() if i not in gone]
        assert not any(word_jaccard(a, b) >= 0.8 for n, a in enumerate(stay) for b in stay[:n] if a != b)
        assert all(any(word_jaccard(texts[i].encode(), t) >= 0.8 for t in stay) for i in gone)


def test_unlike_texts_of_a_passage_make_no_pairs(spark):
    texts = {i: " ".join([f"p{j}" for j in range(80)] + [f"w{i}-{j}" for j in range(20)]) for i in range(300)}
    nodes, grams_of = hashed(spark, texts)
    given = nodes.selectExpr("key", "struct(least, key) text", "n")
    assert minhash_bands._by_prefix(given, grams_of(given.select("key"))).count() == 0


def test_links_of_close_fingerprints_only(spark, monkeypatch):
    """Variants are made of fingerprints that share two quarters with others; all pairs within the radius stay connected."""
    rng = np.random.default_rng(3)
    prints = set(rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64).tolist())
    for p in list(prints)[:60]:
        a, b = rng.choice(64, 2, replace=False)
        prints.add(int(np.int64(p) ^ np.uint64((1 << int(a)) | (1 << int(b))).astype(np.int64)))
    made, f = {}, simhash_ball.materialize
    monkeypatch.setattr(simhash_ball, "materialize", lambda df, name: made.setdefault(name, f(df, name)))
    found = {frozenset((r["src"], r["dst"])) for r in simhash_ball.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    close = {frozenset((a, b)) for a in prints for b in prints if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert found == close and len(close) >= 60
    assert made["close"].count() <= 2 * len(close)


def test_pairs_grow_with_the_logarithm_of_the_groups(spark, monkeypatch):
    """Norms are all alike and vectors repeat under many ids: groups that come later return only what gets ahead of what was found."""
    rng = np.random.default_rng(11)
    x = np.sign(rng.normal(size=(900, 16)))[rng.integers(900, size=16_000)].astype(np.float32)
    made, f = {}, block_ann.materialize
    monkeypatch.setattr(block_ann, "materialize", lambda df, name: made.setdefault(name, f(df, name)))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 16).cast(pa.list_(pa.float32()))}))
    found = block_ann.nearest(df, k=10, every=200, query_rows=50, block_rows=100, group_bytes=16_000).collect()
    groups, queries = made["nodes"].count(), np.arange(0, len(x), 200)
    assert groups >= 50
    assert sum(t.count() for name, t in made.items() if name.startswith("found")) < 0.2 * 10 * groups * len(queries)
    score = x[queries].astype(np.float64) @ x.astype(np.float64).T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == {(int(q), n + 1): int(i) for q, row in zip(queries, best) for n, i in enumerate(row)}
