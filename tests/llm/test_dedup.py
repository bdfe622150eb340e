"""Exact copies, near copies and repeated substrings against brute force."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightwell.llm import common, exact_dedup, minhash_bands, simhash_ball, substring_cms
from tests.llm.cases import AWKWARD, alike_kept, word_jaccard, by_key, documents, exact, frame, near, print_of, sha, substrings

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return AWKWARD + [(100 + i, t) for i, t in documents(SMALL)]


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, (1 << 48) - 1), max_size=300), st.integers(1, 9))
def test_golomb_round_trip(values, owners):
    values = np.array(sorted(values), np.int64)
    for owner in range(owners):
        base, end = (exact_dedup._owner_base(i, owners) for i in (owner, owner + 1))
        own = values[(values >= base) & (values < end)]
        if len(own):
            assert (own * owners >> 48 == owner).all() or owners > 1 << 15
            k, first, rest = exact_dedup.golomb_encode(own, base)
            assert (exact_dedup.golomb_decode(len(own), k, first, rest, base) == own).all()


def test_exact_dedup(spark, rows):
    found = exact_dedup.exact_dedup(frame(spark, rows).repartition(3))
    assert by_key(found.collect()) == by_key(exact(rows))


def test_exact_dedup_with_small_blocks_and_many_owners(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "send", lambda owners, f=exact_dedup.send: f(owners, 7))
    texts = exact_dedup.at_home(common.text_of(frame(spark, rows).repartition(3), "doc_id", "text"))
    places = {r["place"] for r in exact_dedup.suspects(texts, per_owner=40).collect()}
    marked = texts.select("doc_id", "place").collect()
    copies = {i for i, _, n, _, _ in exact(rows) if n > 1}
    assert {r["doc_id"] for r in marked if r["place"] in places} == copies


def test_rows_meet_their_marks_without_a_shuffle(spark):
    """Marked rows and the others, over several homes; only marks are shuffled."""
    rows = exact_dedup.at_home(spark.range(0, 1000, 1, 7).selectExpr("id doc_id", "cast(id as string) text"))
    for every in (3, 64, 2000):
        places = rows.where(F.col("doc_id") % every == 1).select("place")
        want = {i for i in range(1000) if i % every == 1}
        found = exact_dedup.join_marked(rows, places, "left_semi")
        assert sorted(r["doc_id"] for r in found.collect()) == sorted(want)
        others = exact_dedup.join_marked(rows, places, "left_anti")
        assert sorted(r["doc_id"] for r in others.collect()) == sorted(set(range(1000)) - want)
        for df in (found, others):
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert exact_dedup.join_marked(rows, rows.where("false").select("place"), "left_semi").count() == 0
    assert exact_dedup.join_marked(rows, rows.where("false").select("place"), "left_anti").count() == 1000


def test_drop_exact_copies_beside_clashing_columns(spark, rows):
    docs = frame(spark, rows).selectExpr("*", "'x' place", "'x' home", "'x' words", "'x' doc", "'x' to_home", "'x' text_sha256", "'x' keep_id", "'x' `a.b`", "'x' `c d`", "null none").repartition(3)
    found = exact_dedup.drop_exact_copies(docs)
    assert found.columns == docs.columns
    assert by_key([(r["doc_id"], r["text"]) for r in found.collect()]) == by_key([row for row, e in zip(rows, exact(rows)) if e[3]])
    assert by_key(exact_dedup.exact_dedup(docs).collect()) == by_key(exact(rows))


def test_drop_exact_copies_keeps_columns(spark, rows):
    docs = frame(spark, rows)
    found = exact_dedup.drop_exact_copies(docs)
    assert found.columns == docs.columns
    kept = [i for i, _, _, k, _ in exact(rows) if k]
    assert by_key([(r["doc_id"],) for r in found.collect()]) == by_key([(i,) for i in kept])


def test_simhash(spark, rows):
    assert by_key(simhash_ball.simhash_components(frame(spark, rows)).collect()) == by_key(near(rows))


def test_simhash_links_a_chain_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    chain = [int(rng.integers(1 << 63))]
    for _ in range(40):
        a, b = rng.choice(64, 2, replace=False)
        chain.append(chain[-1] ^ (1 << int(a)) ^ (1 << int(b)))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in chain]
    roots = common.connected_components(simhash_ball.links(spark.createDataFrame(signed, "fp long").distinct())).collect()
    assert {r["root"] for r in roots} == {min(signed)[0]} and len(roots) == len(set(signed))


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted((n, root(n)) for n in linked)


def test_no_links_give_no_components(spark):
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fingerprint_of_a_long_text():
    text = " ".join(f"a{i * 31 % 977}" for i in range(70_000))
    assert simhash_ball.fingerprint(text.encode()) == print_of(text)


def test_near_copies_of_an_id_with_unlike_texts(spark):
    """Row 5 with the first text is a copy of 3 and goes; row 5 with the second one is the smallest of its own group."""
    one, two = "the first text is about rivers and hills", "an unlike text that tells of ships at sea"
    docs = frame(spark, [(3, one), (5, one), (5, two), (9, two)])
    assert by_key(simhash_ball.drop_near_copies(docs).select("doc_id", "text").collect()) == by_key([(3, one), (5, two)])


def test_drop_near_copies_by_brute_force(spark):
    """Edited copies of two texts, from 0.6 to 0.99 alike: what goes is alike to what stays, and little stays that could go."""
    rng = np.random.default_rng(9)
    rows = list(AWKWARD)
    for base in range(2):
        words = [f"b{base}w{x}" for x in range(200)]
        for copy in range(40):
            edited = list(words)
            for at in rng.choice(200, copy % 9 + 1, replace=False):
                edited[at] = f"new{base}x{copy}x{at}"
            rows.append((1000 + len(rows) * 7 % 101 + 101 * base, " ".join(edited)))
    docs = frame(spark, rows).repartition(3)
    found = simhash_ball.drop_near_copies(docs)
    assert found.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in found.collect()}
    stay = {(t or "").encode() for _, t in kept}
    for i, t in rows:
        assert (i, t) in kept or any(word_jaccard((t or "").encode(), k) >= 0.8 for k in stay)
    exact = set(alike_kept(rows))
    assert exact - kept == set() or len(exact ^ kept) <= 6
    assert len(exact) <= len(kept) <= 1.1 * len(exact) and len(kept) < len({c for _, _, c in near(rows)})  # the radius alone finds fewer


def test_pairs_of_a_large_group_are_few(spark):
    """A group of 600 near copies: each is compared with the hubs of its buckets, not with all."""
    words = [f"w{x}" for x in range(120)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(600)]
    assert simhash_ball.drop_near_copies(frame(spark, rows)).select("doc_id").collect() == [(0,)]


def test_the_pipeline_drops_copies_of_0_8_and_no_others(spark):
    import corpus_pipeline

    words = [f"word{x}" for x in range(104)]
    near, far = list(words), list(words)
    near[50], near[70] = "other", "another"  # 10 of 100 shingles: 90 / 110 = 0.818
    far[30], far[50], far[70] = "some", "other", "more"  # 15 of 100: 85 / 115 = 0.74
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert by_key(corpus_pipeline.drop_near(spark, docs, "").select("doc_id").collect()) == [(1,), (3,)]


def test_the_pipeline_keeps_one_row_of_a_group_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    one, two, three = "the first text is about rivers and hills", "an unlike text that tells of ships at sea", "a third one has an id"
    docs = frame(spark, [(None, one), (None, one), (5, two), (5, two), (None, three), (7, three), (None, three.upper()), (8, None), (8, "")]).repartition(3)
    for stage, kept in ((corpus_pipeline.drop_copies, 5), (corpus_pipeline.drop_near, 4)):
        docs = common.materialize(stage(spark, docs, ""), "test-one-row")
        assert docs.count() == kept
    assert by_key(docs.select("doc_id").collect()) == [(5,), (7,), (8,), (None,)]


def test_word_jaccard():
    assert minhash_bands.word_jaccard(b"a b c d e", b"A B C D E") == 1.0
    assert minhash_bands.word_jaccard(b"a b c d e f", b"b c d e f g") == pytest.approx(1 / 3)


def test_substrings(spark, rows):
    found = substring_cms.substring_dedup(frame(spark, rows).repartition(3))
    got = found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert by_key(got) == by_key(substrings(rows))
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in found.collect())


def test_a_crowded_sketch_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(substring_cms, "SHARD", 64)
    found = substring_cms.substring_dedup(frame(spark, rows), cells=128, with_text=False)
    assert by_key(found.collect()) == by_key(substrings(rows))


def test_substrings_in_small_blocks_slices_and_segments(spark, rows, monkeypatch):
    """Long texts in segments of 70 words, many blocks, and many owners of cells and windows."""
    for name, value in (("SLICE", 600), ("SEGMENT", 70), ("OWNER_BYTES", 30_000), ("SHARD", 1 << 12)):
        monkeypatch.setattr(substring_cms, name, value)
    found = substring_cms.substring_dedup(frame(spark, rows).repartition(3), cells=1 << 15, block_bytes=20_000)
    assert by_key(found.drop("kept").collect()) == by_key(substrings(rows))
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in found.collect())


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 200), max_size=8), st.integers(50, 90))
def test_windows_of_segments(counts, segment):
    words = substring_cms.Words([[b"w%d" % (i * 31 + j) for j in range(n)] for i, n in enumerate(counts)], substring_cms.WordNumbers())
    found = []
    for hashes, starts, doc, at in words.windows(segment):
        for s, d, a in zip(starts, doc, at):
            assert (hashes[s : s + 50] == words.hashes[words.firsts[d] + a :][:50]).all()
            found.append((d, a))
    assert found == [(d, a) for d, n in enumerate(counts) for a in range(n - 49)]


def test_estimates_are_never_too_low():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 3, 400)).encode() for _ in range(4)]
    texts += [texts[0][5:], b" ".join(texts[1].split()[30:200])]
    words = substring_cms.Words([t.split() for t in texts], substring_cms.WordNumbers())
    windows = [tuple(w[i : i + 50]) for w in map(bytes.split, texts) for i in range(len(w) - 49)]
    ((hashes, starts, _, _),) = words.windows()
    grams, best = substring_cms._minimizers(hashes[:, 0])
    anchors = best[starts]
    counts = dict(zip(*np.unique(grams[np.unique(anchors)], return_counts=True)))
    for window, anchor in zip(windows, anchors):
        assert counts[grams[anchor]] >= windows.count(window) if windows.count(window) > 1 else True


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, exact_dedup.drop_exact_copies, simhash_ball.simhash_components, simhash_ball.drop_near_copies, substring_cms.substring_dedup])
def test_empty_tables(spark, f):
    assert f(frame(spark, [])).count() == 0
    assert f(frame(spark, [(None, None), (None, None)])).count() in (1, 2)


def test_one_of_a_kind_stays(spark):
    assert simhash_ball.drop_near_copies(frame(spark, [(4, "one of a kind")])).count() == 1


def test_a_hub_of_many_links(spark):
    edges = [(1, 10 + i) for i in range(3000)] + [(10, 9000)]
    found = common.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert found.where("root <> 1").count() == 0 and found.count() == 3002
