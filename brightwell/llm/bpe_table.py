"""BPE encoding through a table of distinct words, and decoding through the table of pieces.

Documents are split into words in blocks; a block keeps its documents as lists of its words'
numbers, and sends its distinct words, by hash, to the shards of the word table. A shard encodes
each distinct word once, for all blocks that ask, and answers each block with the ids of its words,
which the block joins with its documents by position.
"""
from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.bpe import pieces, split_words, tokenizer
from brightwell.llm.common import arrow_schema, bucketed, ragged, slices, text_of

BLOCK_BYTES = 6 << 20
#: So many of a block's most frequent words have the smallest numbers.
FREQUENT = 4096
#: Bytes of text for each shard of the word table, which holds the distinct words of its shard: some 2 million at the very most, where no word repeats.
SHARD_BYTES = 16 << 20
#: Words in a row of a block's lists.
ROW_WORDS = 1 << 16
#: A block's lists of numbers (shard -1) and its distinct words for each shard (sizes are those of words), in one table.
SENT = "block long, shard int, n long, doc_ids array<long>, sizes binary, frequent binary, data binary"


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 3)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte plane by byte plane."""
    return _squeeze(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(code: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expand(code), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _sizes(parts: list[bytes]) -> bytes:
    return _pack(np.fromiter(map(len, parts), np.uint32, len(parts)))


def _block(schema: pa.Schema, block: int, shards: int, numbers: _Numbers, ids: list, lists: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of a block, which numbers its words by shard and spelling; its most frequent words take the smallest numbers instead."""
    names = sorted(numbers)
    met = np.fromiter((numbers[w] for w in names), np.int64, len(names))
    names = [w.encode() for w in names]
    shard = np.fromiter((crc32(w) % shards for w in names), np.int64, len(names))
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(names), np.int64)  # of a word as first met: its place by shard and spelling
    place[met[order]] = np.arange(len(names))
    words = np.concatenate(lists)
    often = np.argsort(-np.bincount(words, minlength=len(names)), kind="stable")[:FREQUENT]
    number = place + FREQUENT
    number[often] = np.arange(len(often))
    number, ends = number[words], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
    rows, lo = [], 0
    while lo < len(lists):
        first = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, first + ROW_WORDS, side="right")))
        rows.append((-1, len(names), ids[lo:hi], _pack(np.diff(ends[lo:hi], prepend=first)), None if lo else _pack(place[often]), _pack(number[first : ends[hi - 1]])))
        lo = hi
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        part = [names[i] for i in order[bounds[s] : bounds[s + 1]]]
        rows.append((s, len(part), None, _sizes(part), None, _squeeze(b"".join(part))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([block] * len(rows), *zip(*rows)), schema.types)], schema=schema)


def _blocks(shards: int, most_bytes: int):
    """Task side: the rows of SENT of blocks of about most_bytes of text."""
    schema = arrow_schema(SENT)

    def run(batches):
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 24, 0
        numbers, ids, lists = _Numbers(), [], []
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                for text in b.column("text").to_pylist():
                    parts = split_words(text)
                    lists.append(np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts)))
                ids += b.column("doc_id").to_pylist()
                held += b.column("text").nbytes
                if held >= most_bytes:
                    yield _block(schema, block, shards, numbers, ids, lists)
                    block, held = block + 1, 0
                    numbers, ids, lists = _Numbers(), [], []
        if lists:
            yield _block(schema, block, shards, numbers, ids, lists)

    return run


def _encode_words(vocab, kind: str):
    """A partition of the word table, its rows in order of shard: each distinct word is encoded once, on first sight; every block gets the ids of its words, in its order."""

    def run(batches):
        encoder, table, now = None, {}, None
        for b in batches:
            for block, shard, sizes, words in zip(*(b.column(c).to_pylist() for c in ("block", "shard", "sizes", "data"))):
                encoder = encoder or tokenizer(vocab.value)
                if shard != now:
                    table, now = {}, shard
                ends, text = np.cumsum(_unpack(sizes), dtype=np.int64).tolist(), _expand(words)
                asked = [text[i:j] for i, j in zip([0, *ends], ends)]
                new = [w for w in asked if w not in table]
                for lo in range(0, len(new), 2000):
                    part = new[lo : lo + 2000]
                    for w, e in zip(part, encoder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                        table[w] = np.array(e.ids, kind).tobytes()
                found = [table[w] for w in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([shard], pa.int32()), pa.array([_sizes(found)], pa.binary()), pa.array([_squeeze(b"".join(found))], pa.binary())],
                    ["block", "shard", "sizes", "ids"],
                )

    return run


def _join_by_position(kind: str):
    names = ["doc_id", "n_tokens", "ids"]
    types = [pa.int64(), pa.int64(), pa.binary()]

    def run(lists: pa.Table, answers: pa.Table) -> pa.Table:
        """lists: a block's documents; answers: the ids of its words by shard."""
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "sizes", "ids"))))
        lengths = np.concatenate([np.empty(0, np.int64), *(_unpack(r[1]).astype(np.int64) for r in rows)]) // np.dtype(kind).itemsize
        ids = np.frombuffer(b"".join(_expand(r[2]) for r in rows), kind).astype("<u4")
        if set(lists.column("n").to_pylist()) != {len(lengths)}:
            raise RuntimeError(f"a block has {lists.column('n').to_pylist()[:1]} words, its table {len(lengths)}")
        starts = np.cumsum(lengths) - lengths
        often = next(f for f in lists.column("frequent").to_pylist() if f)
        place = np.concatenate([np.resize(_unpack(often), FREQUENT).astype(np.int64), np.arange(len(lengths))])
        out = []
        for doc_ids, sizes, data in zip(*(lists.column(c).to_pylist() for c in ("doc_ids", "sizes", "data"))):
            at = place[_unpack(data)]
            edges = np.concatenate(([0], np.cumsum(lengths[at])))[np.concatenate(([0], np.cumsum(_unpack(sizes), dtype=np.int64)))]
            found = ids[ragged(starts[at], lengths[at])]
            parts = pa.array([found[i:j].tobytes() for i, j in zip(edges, edges[1:])], types[2])
            out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids, types[0]), pa.array(np.diff(edges)), parts], names))
        return pa.Table.from_batches(out, pa.schema(list(zip(names, types))))

    return run


def bpe_encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    The ids are those of the tokenizers library for the whole text, special tokens' strings in the
    text included and none added. A null text is an empty one and has no ids; a null doc_id stays;
    repeated rows repeat; an empty table gives no rows; other columns are ignored.

    Texts are read once: a block's lists of numbers and its words are written before either is
    used, so both are of the same reading. That table is bucketed by block, so lists are read where
    they are joined and neither they nor texts are shuffled: only compressed distinct words and
    their ids. A block holds about `block_bytes` of text (a longer text stands alone), which bounds
    its task's memory. Shards and buckets follow the bytes of text; a shard streams over the
    blocks' words and encodes each distinct one once. Messages are at most blocks x shards, and at
    most the blocks' distinct words.
    """
    texts, spark = text_of(docs, id_col, text_col), docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    kind = "<u2" if len(pieces(vocab)) <= 1 << 16 else "<u4"
    size, partitions = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = max(partitions, 1 + size // shard_bytes), max(partitions, 1 + size // (4 * BLOCK_BYTES))
    sent = bucketed(texts.mapInArrow(_blocks(shards, block_bytes), SENT), "words", "block", buckets)
    asked = sent.where("shard >= 0").select("block", "shard", "sizes", "data").repartition("shard").sortWithinPartitions("shard")
    answers = asked.mapInArrow(_encode_words(shared, kind), "block long, shard int, sizes binary, ids binary")
    lists = sent.where("shard < 0").drop("shard")
    return lists.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join_by_position(kind), "doc_id long, n_tokens long, ids binary")


def _decode(table):
    def run(batches):
        by_id = np.empty(len(table.value), object)
        by_id[:] = table.value
        for batch in batches:
            for b in slices(batch, "ids", 1 << 20):
                texts = [b"".join(by_id[np.frombuffer(i, "<u4")]).decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
                columns = [b.column(c) for c in b.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def bpe_decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with decoded, the text of its ids: each id takes its piece from
    the table of pieces (the vocabulary, so of fixed size, broadcast), special tokens' text included;
    bytes that are no UTF-8 become U+FFFD."""
    table = encoded.sparkSession.sparkContext.broadcast(pieces(vocab))
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(table), "doc_id long, n_tokens long, ids binary, decoded string")
