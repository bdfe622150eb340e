"""Awkward columns, chains, hot keys, long texts and shared tables."""
import hashlib
import os
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from brightwell.llm import bpe_table, common, exact_dedup, minhash_bands, simhash_ball, substring_cms, warc_index
from brightwell.llm.queries import vocabulary
from tests.llm.cases import AWKWARD, by_key, documents, frame, print_of, substrings

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def made(monkeypatch):
    """The names of the shared tables that operators make."""
    names = []
    for module in (minhash_bands, warc_index, simhash_ball, exact_dedup):
        f = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, f=f: (names.append(name), f(df, name))[1])
    return names


def test_stages_take_columns_of_any_type_and_repeated_rows(spark):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in [*AWKWARD, *documents(SMALL)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "map('a', doc_id) m", "array(lang, null) l", "struct(doc_id, map(1, 2) as k) s", "'x' place", "'x' key")
    docs = docs.union(docs.where("doc_id % 3 = 0"))
    columns, left = docs.schema, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SMALL), "test")
        assert [(f.name, f.dataType.simpleString()) for f in docs.schema] == [(f.name, f.dataType.simpleString()) for f in columns]
        now = docs.count()
        assert 0 < now <= left
        left = now
        if name in ("exact_dedup", "near_dedup"):
            assert docs.selectExpr("coalesce(text, '')").distinct().count() == now
    assert corpus_pipeline.pack(spark, docs, SMALL).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_a_chain_settles_in_few_rounds(spark, made):
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(1000)]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(keys, keys[1:])], "src binary, dst binary")
    gone = {bytes(r["key"]) for r in minhash_bands.settle(edges).collect()}
    assert made.count("free") <= 20
    stays = [k not in gone for k in keys]
    assert not any(a and b for a, b in zip(stays, stays[1:]))
    assert all(any(stays[max(0, i - 1) : i + 2]) for i in range(1000))


def test_texts_that_no_first_hub_meets_are_compared_later(spark):
    """Three texts that all others of their bucket are unlike take its hubs; two of the others are alike all the same."""
    key = lambda x: bytearray(hashlib.md5(x.encode()).digest())
    unlike = [(f"t{i}", [f"w{i}-{j}" for j in range(50)]) for i in range(12)]
    texts = dict([*unlike, ("a", ["same"] + [f"s{j}" for j in range(60)]), ("b", ["other"] + [f"s{j}" for j in range(60)])])
    hashed = {n: minhash_bands.grams(" ".join(w).encode()) for n, w in texts.items()}
    nodes = spark.createDataFrame([(key(n), i, 50, [7]) for i, n in enumerate(texts)], "key binary, least long, n long, bands array<long>")
    table = spark.createDataFrame([(key(n), bytearray(h.tobytes())) for n, h in hashed.items()], "key binary, grams binary")
    # found in the first comparison or not, one pair elsewhere that is alike makes the rest be compared again
    more = spark.createDataFrame([(key("c"), 100, 50, [8]), (key("d"), 101, 50, [8])], "key binary, least long, n long, bands array<long>")
    same = spark.createDataFrame([(key(n), bytearray(hashed["a"].tobytes())) for n in "cd"], "key binary, grams binary")
    table = common.materialize(table.union(same), "test")
    gone = {bytes(r["key"]) for r in minhash_bands.lost_texts(nodes.union(more), lambda keys: table.join(keys, "key", "left_semi"), comparisons=10).collect()}
    assert gone == {bytes(key("b")), bytes(key("d"))}


def skewed_joins(spark, f, monkeypatch):
    """Runs f with low thresholds of skew; the plans of the tables that it wrote and of its result."""
    plans = []
    for module in (warc_index, simhash_ball, exact_dedup):
        made = module.materialize

        def explained(df, name, made=made):
            found = made(df, name)
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return found

        monkeypatch.setattr(module, "materialize", explained)
    low = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.2", "adaptive.advisoryPartitionSizeInBytes": "512", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(f"spark.sql.{k}", v)
        found = f()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    return found, plans


def test_a_hot_payload_is_split_and_html_stays(spark, monkeypatch):
    pages = [(i, f"http://h.example/{i}", "<p>same</p>") for i in range(6000)] + [(6000 + i, f"http://h.example/{i}", f"<p>{i}</p>") for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)
    found, plans = skewed_joins(spark, lambda: warc_index.warc_round_trip(df).select("page_id", "record_type", "refers_to").collect(), monkeypatch)
    assert Counter((r["record_type"], r["refers_to"]) for r in found) == {("revisit", 0): 5999, ("response", None): 51}
    revisits = [p for p in plans if "refers_to" in p and "Join" in p]
    assert any("skew=true" in p for p in revisits)
    for p in plans:
        assert not any("Exchange" in line and "html" in line for line in p.splitlines())


def test_equal_pages_are_dealt_over_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(None, None, "x")], "page_id long, url string, html string").crossJoin(spark.range(8000)).drop("id").repartition(8)
    path = f"{common.shared_dir(spark)}/equal-pages"
    warc_index.write_archives(df, path)
    index = warc_index.capture_index(spark, path, range_rows=1000)
    sizes = [r["count"] for r in index.selectExpr("spark_partition_id() p").groupBy("p").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 3000


def test_messages_are_in_proportion(spark, monkeypatch):
    """Ten times the text: messages to owners grow with it, though blocks and owners both grow."""
    counts = []
    for copies in (1, 10):
        seen = []
        f = substring_cms.bucketed
        monkeypatch.setattr(substring_cms, "bucketed", lambda df, name, key, n: seen.append((name, f(df, name, key, n))) or seen[-1][1])
        rows = [(2 * i + j, " ".join(f"w{i}-{k}" for k in range(60))) for i in range(30 * copies) for j in range(2)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        found = substring_cms.substring_dedup(docs, with_text=False, block_bytes=4000, owner_bytes=4000)
        assert found.where("n_removed = 60").count() == 30 * copies
        counts.append(dict(seen)["windows"].where("owner >= 0").count())
        monkeypatch.setattr(substring_cms, "bucketed", f)
    windows = 2 * 30 * 11
    assert counts[0] <= windows and counts[1] <= 10 * windows and counts[1] <= 14 * counts[0]


def test_each_word_is_encoded_once(spark):
    """Over all shards and blocks, by the words that the library is asked for."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(200))) for i in range(60)]
    asked = spark.sparkContext.accumulator(0)
    f = bpe_table.tokenizer

    def counting(vocab):
        found = f(vocab)

        class Encoder:
            def encode_batch_fast(self, words, **more):
                asked.add(len(words))
                return found.encode_batch_fast(words, **more)

        return Encoder()

    bpe_table.tokenizer = counting
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert bpe_table.bpe_encode(docs, vocabulary(), block_bytes=2000, shard_bytes=3000).count() == 60
    finally:
        bpe_table.tokenizer = f
    assert asked.value == len({w for _, t in rows for w in bpe_table.split_words(t)})


LONG = " ".join(f"w{i * 7919 % 40_009}" for i in range(850_000))  # some 5 MB


def test_long_texts_in_parts(spark):
    text = LONG.encode()
    assert len(text) > 5_000_000
    assert simhash_ball.fingerprint(text) == print_of(LONG)
    assert len(minhash_bands.grams(text)) == 40_009
    assert minhash_bands.shared_sorted(minhash_bands.grams(text), minhash_bands.grams(text + b" more")) > 0.9999


def test_a_long_text_is_deduplicated(spark):
    part = " ".join(LONG.split()[:120_000])
    rows = [(1, part), (2, f"new {part}"), (3, "short")]
    found = substring_cms.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert by_key(found.collect()) == by_key(substrings(rows))
    kept = simhash_ball.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_key(kept.select("doc_id").collect()) == [(1,), (3,)]


def test_scratch_leaves_only_what_it_keeps(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    before, tables = set(os.listdir(folder)), {t.name for t in spark.catalog.listTables()}
    with common.scratch(spark) as keep:
        kept = keep(exact_dedup.drop_exact_copies(frame(spark, AWKWARD)), "kept")
    assert kept.count() == len({t or "" for _, t in AWKWARD}) + 1  # the row that repeats id and text
    assert len(set(os.listdir(folder)) - before) == 1
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_place_of_copies(spark):
    rows = [(None, "x")] * 3 + [(1, "y")] * 2 + [(2, "y"), (2, "y")]
    found = exact_dedup.drop_exact_copies(frame(spark, rows), one_each=True).select("doc_id", "text").collect()
    assert by_key(found) == by_key([(None, "x"), (2, "y")])
    assert zlib.crc32(b"") == 0


def test_groups_of_small_norms_are_not_sent(spark, monkeypatch):
    """200,000 vectors whose norms differ: most groups of candidates are never sent, and results are exact."""
    import numpy as np
    import pyarrow as pa

    from brightwell.llm import block_ann

    rng = np.random.default_rng(8)
    x = (rng.normal(size=(200_000, 8)) * np.exp(rng.normal(size=(200_000, 1)))).astype(np.float32)
    tables, f = {}, block_ann.materialize
    monkeypatch.setattr(block_ann, "materialize", lambda df, name: tables.setdefault(name, f(df, name)))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 8).cast(pa.list_(pa.float32()))}))
    found = block_ann.nearest(df, k=5, every=2000, query_rows=30, block_rows=500, group_bytes=200_000).collect()
    nodes, buckets = tables["nodes"].count(), tables["asked"].count()
    assert nodes >= 30 and buckets >= 3
    assert tables["sent"].count() < 0.5 * buckets * (nodes - 1)
    queries = np.arange(0, len(x), 2000)
    score = x[queries].astype(np.float64) @ x.astype(np.float64).T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-score, axis=1)[:, :5]
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == {(int(q), n + 1): int(i) for q, row in zip(queries, best) for n, i in enumerate(row)}


def test_secrets_shuffle_no_text_and_run_no_python(spark, monkeypatch):
    """Every plan on the way, also where nothing may be broadcast."""
    from pyspark.sql import functions as F

    from brightwell.llm import secret_index

    plans = []
    for module, name in ((secret_index, "materialize"), (exact_dedup, "bucketed")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *more, f=f: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, *more))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = frame(spark, [*AWKWARD, *documents(SMALL, 20)])
        found = secret_index.secret_spans(docs).select("doc_id", F.sha2("text", 256))
        masked = secret_index.mask_secrets(docs)
        plans += [df._jdf.queryExecution().executedPlan().toString() for df in (found, masked)]
        assert masked.count() == found.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 10
    for plan in plans:
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                below = lines[i + 1]
                assert "text" not in below.replace("contains(", "") or "HashAggregate" in below or "Aggregate" in below, plan


def test_the_quality_stage_keeps_what_the_scores_say(spark):
    from brightwell.llm.queries import op1_quality
    from brightwell.sources import read_table

    docs = read_table(spark, SMALL, "documents")
    scores = {r["doc_id"]: r["predicted"] for r in op1_quality(spark, SMALL).collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL).select("doc_id", "text").collect()
    assert by_key(kept) == by_key([(i, t) for i, t in documents(SMALL) if scores[i] == 1])


def test_the_packing_stage_packs_each_document_once(spark):
    from brightwell.sources import read_table
    from tests.llm.test_round3 import padding

    docs = read_table(spark, SMALL, "documents")
    found = corpus_pipeline.pack(spark, docs, SMALL).collect()
    held = Counter()
    for r in found:
        held[r["doc_id"]] += r["length"]
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert held == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in documents(SMALL)}
    assert padding(found, 1024) >= 0
