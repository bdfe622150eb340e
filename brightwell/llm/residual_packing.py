"""Best-fit packing of documents into sequences by hierarchical residual packing.

Tasks tokenize documents and cut them into pieces; full pieces are sequences of their own. The
others are dealt over partitions, so that each sees the whole mix of lengths, and every partition
packs its own best-fit, the longest first. Bins that are nearly full are finished; the others become
the items of the next round, in which a node takes the bins of several nodes below it and packs them
best-fit again, up a tree to its root.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.bpe import ranked, tokenizer
from brightwell.llm.common import materialize, slices, text_of

ITEM = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("offset", "<i4")])
PIECES = "sequence_id long, size int, items binary"
BINS = "node long, sequence_id long, done boolean, size int, items binary"
#: Pieces of a first partition, about; nodes below a node; bins this near to the capacity are finished.
NODE_ITEMS, FAN_IN, SLACK = 25_000, 8, 8
#: A node hands up its emptiest bins, so many at most. Any two bins of a node exceed the capacity
#: together, so at most one is half empty: only as many bins as a node has children can be joined above.
HANDED = 4_000


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or the short rest first and then full pieces."""
    rest = length % most if length > most else length
    return [(0, rest)] * (rest > 0) + [(s, most) for s in range(rest, length, most)]


def best_fit(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Items, in the order given, each to the open bin with the least room that holds it, else to a new one.

    Returns the items of each bin and its fill. Open bins are kept by room; a bit for each room that
    occurs makes the search one operation on an integer.
    """
    bins, fills, rooms, by_room = [], [], 0, [[] for _ in range(capacity + 1)]
    for i, size in enumerate(sizes):
        fit = rooms >> size
        if fit:
            room = size + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
            fills.append(0)
        bins[b].append(i)
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, fills


def _packed(items: list[bytes], sizes: np.ndarray, node: int, level: int, capacity: int, last: bool) -> pa.RecordBatch:
    """Bins of best-fit decreasing over composite items (bytes of ITEMs), in an order that depends on the items alone."""
    order = sorted(range(len(items)), key=lambda i: (-sizes[i], items[i]))
    bins, fills = best_fit([int(sizes[i]) for i in order], capacity)
    out = []
    for members in bins:
        parts, at = [], 0
        for m in members:
            part = np.frombuffer(items[order[m]], ITEM).copy()
            part["offset"] += at
            at += int(sizes[order[m]])
            parts.append(part.tobytes())
        out.append(b"".join(parts))
    n = len(bins)
    ids = (level << 58) + (node << 26) + np.arange(n, dtype=np.int64)
    fills = np.array(fills, np.int32)
    done = np.full(n, True) if last else fills >= capacity - SLACK
    done[np.argsort(fills, kind="stable")[HANDED:]] = True
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, node, np.int64)), pa.array(ids), pa.array(done), pa.array(fills), pa.array(out, pa.binary())], [c.split()[0] for c in BINS.split(", ")])


def encoder_of(fast: dict, vocab: str):
    """A function from a text to its ids. The fast encoder's pattern gives up on very long runs of white space, and such texts go to the tokenizers library."""
    import tiktoken

    encode, plain = tiktoken.Encoding(**fast).encode_to_numpy, []

    def ids(text: str) -> np.ndarray:
        try:
            return encode(text, allowed_special="all").astype("<u4")
        except ValueError:
            if not plain:
                plain.append(tokenizer(vocab))
            return np.array(plain[0].encode(text, add_special_tokens=False).ids, "<u4")

    return ids


def _pieces(shared, capacity: int, end_id: int):
    """Task side: a row per piece, with a number of its own."""

    def run(batches):
        from pyspark import TaskContext

        encode, end, number = encoder_of(*shared.value), np.array([end_id], "<u4"), TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = np.concatenate((encode(text), end))
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id or 0, doc_id is None, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), 0))
                items = np.array(rows, ITEM)
                data, step = items.tobytes(), ITEM.itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(len(rows), dtype=np.int64)), pa.array(items["length"]), pa.array([data[i : i + step] for i in range(0, len(data), step)], pa.binary())],
                    [c.split()[0] for c in PIECES.split(", ")],
                )
                number += len(rows)

    return run


def _merge(level: int, capacity: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        items, sizes = table.column("items").to_pylist(), table.column("size").to_numpy()
        return pa.Table.from_batches([_packed(items, sizes, key[0].as_py(), level, capacity, last)])

    return run


def _unfold(batches):
    for b in batches:
        items = b.column("items").to_pylist()
        rows = np.frombuffer(b"".join(items), ITEM)
        sequence = np.repeat(b.column("sequence_id").to_numpy(), [len(i) // ITEM.itemsize for i in items])
        doc = pa.array(rows["doc_id"].astype(np.int64), mask=rows["null"].astype(bool))
        rest = [pa.array(rows[c].astype(t)) for c, t in (("piece", np.int32), ("start", np.int64), ("length", np.int64), ("crc", np.int64))]
        yield pa.RecordBatch.from_arrays([doc, *rest, pa.array(sequence), pa.array(rows["offset"].astype(np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, vocab: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id (a null or empty text: end_id alone), so every row, repeated
    ones too, has a piece; a null doc_id stays. Only longer documents are cut: the short rest comes
    first, full pieces follow. Texts of any length and content are encoded whole. An empty table
    gives no rows; other columns are ignored.

    No text is shuffled, only pieces (some 40 bytes each) and bins. Pieces are dealt by the hash of
    a number of their own, so equal rows spread like any others. A round is written before the next
    reads it, and its packing depends on its items alone, so tasks that run again agree. Node counts
    follow the count of pieces; a node holds about NODE_ITEMS pieces, or FAN_IN x HANDED bins.
    """
    texts, spark = text_of(docs, id_col, text_col), docs.sparkSession
    shared = spark.sparkContext.broadcast((ranked(vocab), vocab))
    pieces = materialize(texts.mapInArrow(_pieces(shared, capacity, end_id), PIECES), "pieces")
    found = pieces.where(F.col("size") == capacity).select("sequence_id", "items")
    waiting = pieces.where(F.col("size") < capacity)
    level, nodes = 1, max(1, -(-waiting.count() // NODE_ITEMS))
    waiting = waiting.withColumn("node", F.pmod(F.xxhash64("sequence_id"), F.lit(nodes)))
    while True:
        packed = materialize(waiting.select("node", "size", "items").groupBy("node").applyInArrow(_merge(level, capacity, nodes == 1), BINS), "bins")
        found = found.unionByName(packed.where("done").select("sequence_id", "items"))
        if nodes == 1:
            break
        level, nodes = level + 1, -(-nodes // FAN_IN)
        waiting = packed.where("not done").withColumn("node", F.floor(F.col("node") / FAN_IN))
    return found.mapInArrow(_unfold, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
