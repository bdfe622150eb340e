"""Ranked search, spelling variants and cutting-stock packing against brute force."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brightwell.llm import cutting_stock, lexical_nra, spelling_fst
from brightwell.llm.queries import op11_search, op12_variants, op13_cutting, vocabulary
from tests.llm.cases import AWKWARD, by_key, crc, documents, frame

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(rows, items, k=10):
    split = [(i, terms(t)) for i, t in rows]
    split = [(i, len(w), Counter(w)) for i, w in split if w]
    n_docs, n_terms = len(split), sum(n for _, n, _ in split)
    df = Counter(t for *_, c in split for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, n, counted in split:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counted[t] // (1000 * counted[t] + 8 * m)) for t, q in asked.items() if counted[t])
            if score > 0:
                scores.append((i, score))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r, i, s) for r, (i, s) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize(("shard", "depth", "query_bytes"), [(3, 1, 20), (7, 2, 200), (1 << 15, 256, 4 << 20)])
def test_search(spark, monkeypatch, shard, depth, query_bytes):
    monkeypatch.setattr(lexical_nra, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_nra, "DEPTH", depth)
    monkeypatch.setattr(lexical_nra, "STEP", 50)
    rows = AWKWARD + [(100 + i, t) for i, t in documents(SMALL, 60)] + [(500 + i, "one two three three") for i in range(30)] + [(None, "one two three three")]
    items = [(1, "One two, THREE"), (2, None), (3, ""), (4, "nowhere-found"), (1, "One two, THREE"), (None, "café rep rep"), (7, "shared1 shared2 shared3 one"), (8, documents(SMALL)[5][1])]
    asked = spark.createDataFrame([(i, t, 0, 1.0) for i, t in items], "item_id long, text string, item int, rank double")
    found = lexical_nra.search(frame(spark, rows).repartition(3), asked, query_bytes=query_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_key(found.collect()) == by_key(ranked(rows, items))


@settings(deadline=None, max_examples=100)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 60), st.integers(1, 8))
def test_nra_is_exact(seed, n_lists, n, k):
    rng = np.random.default_rng(seed)
    total, lists = np.zeros(n, np.int64), []
    for _ in range(n_lists):
        docs = rng.permutation(n)[: rng.integers(0, n + 1)]
        scores = np.sort(rng.integers(1, 6, len(docs)))[::-1] * rng.integers(1, 4)
        total[docs] += scores
        lists.append((docs, scores))
    depth, lexical_nra.DEPTH = lexical_nra.DEPTH, 1
    try:
        docs, scores = lexical_nra.nra(lists, n, k)
    finally:
        lexical_nra.DEPTH = depth
    best = sorted((-s, i) for i, s in enumerate(total.tolist()) if s > 0)[:k]
    assert sorted((-s, i) for i, s in zip(docs.tolist(), scores.tolist()))[:k] == best


def test_nra_reads_no_further_than_needed():
    docs = np.arange(100_000)
    scores = np.concatenate(([9] * 10, np.ones(len(docs) - 10, np.int64)))
    class Counted(np.ndarray):
        most = 0
        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop:
                Counted.most = max(Counted.most, at.stop)
            return super().__getitem__(at)
    found, _ = lexical_nra.nra([(docs, scores.view(Counted)), (docs, scores.view(Counted))], len(docs), 10)
    assert sorted(found.tolist()) == list(range(10))
    assert Counted.most <= 4 * lexical_nra.DEPTH


def test_search_of_empty_tables(spark):
    some = frame(spark, [(1, "one two")])
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_nra.search(some.limit(0), items).collect() == []
    assert lexical_nra.search(some, items.limit(0)).collect() == []


def test_search_query(spark):
    import pyarrow.parquet as pq

    items = list(zip(*(c.to_pylist() for c in pq.read_table(f"{SMALL}/benchmark.parquet", columns=["item_id", "text"]).columns)))
    assert by_key(op11_search(spark, SMALL).collect()) == by_key(ranked(documents(SMALL), items))


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def variants(rows, least=6, least_count=5, times=5, spared=199):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % spared == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= least_count}
    by_rest = defaultdict(set)  # the words with a code point left out, or one of their own, are near only if they share such a rest
    for w in n:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest[rest].add(w)
    near = defaultdict(set)
    for ws in by_rest.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize(("most_words", "held", "step"), [(2, 3, 10), (20_000, 1 << 17, 1 << 20)])
def test_variants(spark, monkeypatch, most_words, held, step):
    monkeypatch.setattr(spelling_fst, "HELD_WORDS", held)
    monkeypatch.setattr(spelling_fst, "STEP", step)
    monkeypatch.setattr(spelling_fst, "CHUNK_WORDS", 50)
    rng = random.Random(3)
    made = ["".join(rng.choice("abCdé") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    rows = AWKWARD + [(100 + i, t) for i, t in documents(SMALL, 40)] + [(1000 + i, " ".join(rng.choices(made, weights=range(1, 301), k=200)) + "×ıéè") for i in range(12)] + [(None, "Letters letters LETTERS letterz " * 40)]
    found = spelling_fst.group_variants(frame(spark, rows).repartition(3), least_length=4, least_count=2, times=2, spared=19, most_words=most_words)
    expected = variants(rows, 4, 2, 2, 19)
    assert by_key(found.select(COLUMNS).collect()) == by_key(expected)
    assert sum(r[3] is not None for r in expected) > 20 and any(r[5] not in (r[0], r[3]) for r in expected)


def test_near_pairs_once(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(4, 9))) for _ in range(500)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = sorted(tuple(sorted(r)) for r in spelling_fst.near_words(df, least_length=4, most_words=15).collect())
    assert found == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)]


def test_acceptor_is_minimal():
    acceptor = spelling_fst.Acceptor()
    first = acceptor.add(sorted(a + b for a in ("ka", "pe", "mo") for b in ("tte", "lle")))
    assert len(acceptor.next) == 9  # the end, e, t and l before it, the fork, a, e and o before that, the start
    assert acceptor.add(sorted(a + b for a in ("ka", "pe", "mo") for b in ("tte", "lle"))) == first


def test_variants_of_awkward_rows_and_none(spark):
    rows = [(1, "w" * 150 + "À"), (2, "w" * 150 + "À"), (3, "w" * 151), (4, None), (5, ""), (6, " ".join(["w" * 151] * 3))]
    found = spelling_fst.group_variants(frame(spark, rows), least_count=1, times=2)
    assert by_key(found.select(COLUMNS).collect()) == by_key(variants(rows, 6, 1, 2))
    with pytest.raises(ValueError, match="circles"):
        spelling_fst.group_variants(frame(spark, rows), times=1)
    assert spelling_fst.group_variants(frame(spark, rows).limit(0)).collect() == []


def test_variants_query(spark):
    assert by_key(op12_variants(spark, SMALL).select(COLUMNS).collect()) == by_key(variants(documents(SMALL)))


@pytest.fixture(scope="module")
def encode():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


def padding(found, capacity):
    """Tokens of padding; that sequences are gapless from 0 and hold capacity at most is checked on the way."""
    sequences, lost = defaultdict(list), 0
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        lost += capacity - at if at & (at - 1) else 0
    return lost


def check_pieces(rows, found, encode):
    """Pieces of each document, joined, are its ids; documents of one id and text are told apart by nothing, so each has as many pieces as any."""
    kinds = Counter((i, t or "") for i, t in rows)
    assert len({i for i, _ in kinds}) == len(kinds)
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {i for i, _ in kinds}
    for (i, text), copies in kinds.items():
        ids = [*encode(text), 0]
        covered = Counter()
        for r in by_doc[i]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
            covered[r["start"]] += 1
            covered[r["start"] + r["length"]] -= 1
        depth = 0
        for at in range(len(ids)):
            depth += covered[at]
            assert depth == copies


@pytest.mark.parametrize(("capacity", "grid"), [(1024, 64), (64, 8)])
def test_cutting(spark, encode, capacity, grid):
    rows = [r for r in AWKWARD if r[0] is not None] + [(100 + i, t) for i, t in documents(SMALL, 50)]
    found = cutting_stock.pack(frame(spark, rows).repartition(3), vocabulary(), capacity=capacity, grid=grid).collect()
    check_pieces(rows, found, encode)
    assert padding(found, capacity) <= 2 * capacity


def test_cutting_query(spark, encode):
    rows, found = documents(SMALL), op13_cutting(spark, SMALL).collect()
    check_pieces(rows, found, encode)
    assert padding(found, 1024) <= 2 * 1024
    tokens = sum(r["length"] for r in found)
    assert len({r["sequence_id"] for r in found}) <= -(-tokens // 1024) + 2


def test_cutting_of_nothing_and_of_ids_missing(spark, encode):
    assert cutting_stock.pack(frame(spark, []), vocabulary()).collect() == []
    assert [tuple(r)[:5] for r in cutting_stock.pack(frame(spark, [(None, None)]), vocabulary()).collect()] == [(None, 0, 1, crc([0]), 1)]


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 400), min_size=1, max_size=20))
def test_plans_use_up_the_histogram(histogram):
    done = cutting_stock.plan(histogram, 64, 8)
    columns = cutting_stock.Places(done, histogram).columns
    lengths = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    piece, start, length, sequence, offset = cutting_stock.find_places(columns, lengths, ranks)
    assert np.bincount(piece, weights=length).tolist() == lengths.tolist()
    assert (start % 8 == 0).all()
    order = np.lexsort((offset, sequence))
    fresh = np.diff(sequence[order], prepend=-1) != 0
    ends = (offset + length)[order]
    assert (offset[order] == np.where(fresh, 0, np.roll(ends, 1))).all()
    assert ends.max() <= 64
    assert len(set(sequence.tolist())) <= -(-int(lengths.sum()) // 64) * 1.02 + 2


def test_crc_of_a_part():
    data = bytes(range(256)) * 8
    for lo, hi in ((0, 64), (64, 128), (128, 512), (0, 512)):
        upto, before = zlib.crc32(data[: 4 * hi]), zlib.crc32(data[: 4 * lo])
        assert cutting_stock.crc_between(upto, before, hi - lo) == zlib.crc32(data[4 * lo : 4 * hi])
