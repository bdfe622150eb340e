"""BPE by a word table, decoding, and packing."""
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brightwell.llm import bpe, bpe_table, residual_packing
from brightwell.llm.queries import op4_bpe, op9_packing, vocabulary
from tests.llm.cases import AWKWARD, by_key, crc, documents, frame, sha

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: found.encode(t or "", add_special_tokens=False).ids, lambda ids: found.decode(ids, skip_special_tokens=False)


def little(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


MIXED = st.text(st.one_of(st.sampled_from(" \n\t\r\0'!.,aé \x1c​ \U0001f600中1"), st.characters(codec="utf-8")), max_size=60)


@settings(deadline=None, max_examples=400)
@given(MIXED)
def test_words_encode_alone_as_in_the_text(library, text):
    encode, _ = library
    assert [i for w in bpe.split_words(text) for i in encode(w)] == encode(text)


@settings(deadline=None, max_examples=400)
@given(st.text(st.sampled_from(" \n\t\r'!.,astrevmd1é \x1c\U0001f600中<|>"), max_size=60), st.booleans())
def test_the_fast_encoder_agrees(library, fast, text, special):
    text = text + "<|endoftext|>" + text if special else text
    assert fast.encode_to_numpy(text, allowed_special="all").tolist() == library[0](text)


@pytest.fixture(scope="module")
def fast():
    import tiktoken

    return tiktoken.Encoding(**bpe.ranked(vocabulary()))


@pytest.mark.parametrize(("block_bytes", "shard_bytes"), [(1, 20_000), (3000, 2000), (16 << 20, 16 << 20)])
def test_encode_and_decode(spark, library, monkeypatch, block_bytes, shard_bytes):
    monkeypatch.setattr(bpe_table, "ROW_WORDS", 20)
    rows = AWKWARD + [(100 + i, t) for i, t in documents(SMALL)]
    vocab = vocabulary()
    encoded = bpe_table.bpe_encode(frame(spark, rows).repartition(3), vocab, block_bytes=block_bytes, shard_bytes=shard_bytes)
    found = bpe_table.bpe_decode(encoded, vocab)
    encode, decode = library
    expected = [(i, len(ids := encode(t)), little(ids), decode(ids)) for i, t in rows]
    assert by_key([(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in found.collect()]) == by_key(expected)


def test_decoding_broken_utf8(spark, library):
    ids = [255, 188, 35496, 50256, 222]
    df = spark.createDataFrame([(1, 5, bytearray(little(ids)))], "doc_id long, n_tokens long, ids binary")
    assert bpe_table.bpe_decode(df, vocabulary()).first()["decoded"] == library[1](ids)


def test_query_digests(spark, library):
    encode, decode = library
    expected = [(i, len(ids := encode(t)), sha(little(ids)), sha(decode(ids))) for i, t in documents(SMALL)]
    assert by_key(op4_bpe(spark, SMALL).collect()) == by_key(expected)


def check_packing(rows, found, library, capacity=1024):
    encode, _ = library
    expected = []
    for i, t in rows:
        ids = [*encode(t), 2]
        for piece, (start, length) in enumerate(residual_packing.cut(len(ids), capacity)):
            expected.append((i, piece, start, length, crc(ids[start : start + length])))
    assert by_key([tuple(r)[:5] for r in found]) == by_key(expected)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in found)


@pytest.mark.parametrize("capacity", [1024, 50])
def test_packing(spark, library, capacity):
    rows = AWKWARD + [(100 + i, t) for i, t in documents(SMALL)]
    found = residual_packing.pack(frame(spark, rows).repartition(20), vocabulary(), capacity).collect()
    bins, tokens = check_packing(rows, found, library, capacity)
    flat = sorted((r["length"] for r in found), reverse=True)
    assert bins <= 1.05 * len(residual_packing.best_fit(flat, capacity)[0]) + 1


def test_packing_up_a_tree(spark, library, monkeypatch):
    monkeypatch.setattr(residual_packing, "NODE_ITEMS", 12)
    rows = documents(SMALL)
    bins, _ = check_packing(rows, residual_packing.pack(frame(spark, rows).repartition(9), vocabulary()).collect(), library)
    monkeypatch.setattr(residual_packing, "HANDED", 1)
    few, _ = check_packing(rows, residual_packing.pack(frame(spark, rows).repartition(9), vocabulary()).collect(), library)
    assert bins <= few


def test_lengths_that_follow_the_partition(spark, library):
    """Files sorted by source: texts of 600 tokens in one, of 400 in the other. Each sequence takes one of both."""
    rows = [(i, " the" * (599 if i < 300 else 399)) for i in range(600)]
    bins, _ = check_packing(rows, residual_packing.pack(frame(spark, rows).repartitionByRange(2, "doc_id"), vocabulary()).collect(), library)
    assert bins == 300


WHITE = [" " * 700_000, "\n" * 700_000, "\t" * 700_000, " \t\r\n" * 200_000, "\r\n " * 200_000]


def test_very_long_runs_of_white_space(spark, library):
    rows = [(i, f"a{w}b") for i, w in enumerate(WHITE)]
    check_packing(rows, residual_packing.pack(frame(spark, rows), vocabulary()).collect(), library)
    found = bpe_table.bpe_decode(bpe_table.bpe_encode(frame(spark, rows), vocabulary()), vocabulary()).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in found) == [(i, little(library[0](t)), t) for i, t in rows]


def test_query_packs_all(spark, library):
    bins, tokens = check_packing(documents(SMALL), op9_packing(spark, SMALL).collect(), library)
    assert tokens / (bins * 1024) > 0.9


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_by_hand(sizes):
    bins, fills = residual_packing.best_fit(sizes, 30)
    rooms = []
    for s in sizes:
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 30) - s)
    assert sorted(30 - f for f in fills) == sorted(rooms)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


def test_cut():
    assert residual_packing.cut(1024, 1024) == [(0, 1024)]
    assert residual_packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def test_empty_tables(spark):
    vocab = vocabulary()
    assert residual_packing.pack(frame(spark, []), vocab).count() == 0
    assert bpe_table.bpe_decode(bpe_table.bpe_encode(frame(spark, []), vocab), vocab).count() == 0
