"""Substring dedup with a count-min prefilter.

Pass 1 counts, in a count-min sketch, the positions that are the minimizer of some window of 50
words. Two equal windows have equal minimizers at different positions, so a minimizer's count is
never below its windows' own: the merged sketch overestimates window counts. The sketch lies with
the owners of ranges of its cells; blocks of documents send them their cells, compressed, and are
told which of these counted 2 or more. Pass 2 groups, by a 96-bit hash of the words, only windows
whose estimate is 2 or more; none that repeats is lost. It is a second exchange: a block sends each
such window once, with its smallest doc_id there, to the owner of a range of hashes, and is told
whether a smaller one has it elsewhere.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import arrow_schema, bucketed, expand, pack_array, ragged, slices, squeeze, table_of, text_of, unpack_array, word_parts

WINDOW, GRAM = 50, 32
#: The sketch has ROWS rows of cells; an owner has SHARD cells of a row.
ROWS, SHARD = 2, 1 << 22
#: Bytes of text for each cell: about 1 in 10 cells of a row is then used (a word has about 6 bytes, 1 in 10 is a minimizer).
CELL_BYTES = 7
#: Bytes of text of a block; of text that is split and hashed at a time; and words of a long text that are.
BLOCK_BYTES, SLICE, SEGMENT = 8 << 20, 2 << 20, 1 << 18
#: Bytes of text for each owner of windows, which at 6 bytes a word holds at most 4 million of them.
OWNER_BYTES = 24 << 20
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


class WordNumbers(dict):
    """Numbers of words in the order in which they are met, and two independent 64-bit hashes of each (the halves of XXH3-128)."""

    def __init__(self):
        super().__init__()
        self.hashed = np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found

    def hashes(self) -> np.ndarray:
        from itertools import islice

        from xxhash import xxh3_128_digest

        if len(self.hashed) < len(self):
            new = b"".join(map(xxh3_128_digest, islice(self, len(self.hashed), None)))
            self.hashed = np.concatenate((self.hashed, np.frombuffer(new, "<u8").reshape(-1, 2)))
        return self.hashed


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_M3)
    return x ^ (x >> np.uint64(29))


def _rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of each run of `width` values, sum of x[s+j] * base^j modulo 2^64."""
    powers = np.cumprod(np.full(len(x), base, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers, dtype=np.uint64)))
    back = np.cumprod(np.full(len(x), pow(base, -1, 1 << 64), np.uint64))
    return (sums[width:] - sums[:-width]) * back[: len(x) - width + 1]


def _minimizers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams' hashes, for each window the position of its least gram, the leftmost of ties)."""
    grams = _mix(_rolling(x, GRAM, _M2))
    span = WINDOW - GRAM + 1
    best, width = np.arange(len(grams)), 1
    while width < span:  # best over `width` grams becomes best over twice as many, as far as span
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        best, width = np.where(grams[right] < grams[left], right, left), width + step
    return grams, best


class Words:
    """The words of a run of documents, end to end, and the windows that lie within one document.

    A document is its text, or a list of its words. A long text is split in parts, so that what is
    held of a word is its two hashes; its windows come in segments that overlap by a window less a
    word, so that each of them lies in one.
    """

    def __init__(self, docs: list[bytes | list[bytes]], known: WordNumbers):
        numbers, counts = [np.empty(0, np.uint32)], []
        for doc in docs:
            parts = [np.fromiter(map(known.__getitem__, ws), np.uint32, len(ws)) for ws in (word_parts(doc) if isinstance(doc, bytes) else [doc])]
            counts.append(sum(map(len, parts)))
            numbers += parts
        self.counts = np.array(counts, np.int64)
        self.hashes = known.hashes()[np.concatenate(numbers)]
        self.firsts = np.cumsum(self.counts) - self.counts

    def windows(self, segment: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For segments: (hashes of its words, windows' starts in it, their documents, their starts in these)."""
        segment, spans, lo = segment or SEGMENT, [], 0
        while lo < len(self.counts):  # whole documents up to `segment` words, or parts of one
            hi = max(lo + 1, int(np.searchsorted(self.firsts + self.counts, self.firsts[lo] + segment, side="right")))
            first, end = int(self.firsts[lo]), int(self.firsts[hi - 1] + self.counts[hi - 1])
            step = max(1, segment - WINDOW + 1)
            spans += [(lo, hi, first, end)] if hi > lo + 1 or end - first <= segment else [(lo, hi, a, min(a + segment, end)) for a in range(first, max(first + 1, end - WINDOW + 1), step)]
            lo = hi
        for lo, hi, first, end in spans:
            begin = np.maximum(self.firsts[lo:hi], first)
            counts = np.maximum(0, np.minimum(self.firsts[lo:hi] + self.counts[lo:hi], end) - begin - WINDOW + 1)
            if counts.sum():
                starts, doc = ragged(begin, counts), np.repeat(np.arange(lo, hi), counts)
                yield self.hashes[first:end], starts - first, doc, starts - self.firsts[doc]


def _cells(grams: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (_mix(grams + np.uint64((row + 1) * _M1 & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64)


def _gaps(ascending: np.ndarray) -> bytes:
    return pack_array(np.diff(ascending, prepend=0).astype("<u4"))


def _from_gaps(code: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(code, "<u4"), dtype=np.int64)


#: A block's documents (row -1; shard numbers the parts; texts is their texts end to end, sizes their bytes), and its cells of a shard:
#: gaps between these, ascending, and a bit for each that counts more than once in the block.
SENT = "block long, row int, shard int, doc_ids array<long>, sizes binary, texts binary, cells binary, more binary"


def _send_cells(cells: int, most_bytes: int):
    """Task side: the rows of SENT of blocks of about most_bytes of text (a longer text stands alone)."""
    schema = arrow_schema(SENT)

    def run(batches):
        from pyspark import TaskContext

        block, held, parts, grams, known = TaskContext.get().partitionId() << 24, 0, 0, [], WordNumbers()

        def cell_rows():
            every = np.concatenate([*grams, np.empty(0, np.uint64)])
            for row in range(ROWS):
                values, counts = np.unique(_cells(every, row, cells), return_counts=True)
                bounds = np.searchsorted(values, np.arange(0, cells + SHARD, SHARD))
                for shard in np.flatnonzero(np.diff(bounds)).tolist():
                    lo, hi = bounds[shard], bounds[shard + 1]
                    yield block, row, shard, None, None, None, _gaps(values[lo:hi] - shard * SHARD), np.packbits(counts[lo:hi] > 1).tobytes()

        for batch in batches:
            for b in slices(batch, "text", SLICE):
                texts, ids = b.column("text").cast(pa.binary()).to_pylist(), b.column("doc_id").to_pylist()
                words = Words([t if i is not None else b"" for i, t in zip(ids, texts)], known)
                for hashes, starts, _, _ in words.windows():
                    own, best = _minimizers(hashes[:, 0])
                    grams.append(own[np.unique(best[starts])])
                sizes = np.fromiter(map(len, texts), "<u8", len(texts))
                yield table_of([(block, -1, parts, ids, pack_array(sizes), squeeze(b"".join(texts)), None, None)], schema)
                parts, held = parts + 1, held + int(sizes.sum()) + 64 * len(texts)
                if held >= most_bytes:
                    yield table_of(list(cell_rows()), schema)
                    block, held, parts, grams, known = block + 1, 0, 0, [], WordNumbers()
        if held:
            yield table_of(list(cell_rows()), schema)

    return run


def _count_cells(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """An owner's cells: the sum of what blocks say, up to 2; each is told which of its own reach 2."""
    counts = np.zeros(SHARD, np.uint8)
    asked = [(b, _from_gaps(c), m) for b, c, m in zip(*(table.column(x).to_pylist() for x in ("block", "cells", "more")))]
    for _, at, more in asked:
        counts[at] = np.minimum(counts[at] + 1 + np.unpackbits(np.frombuffer(more, np.uint8))[: len(at)], 2)
    often = [_gaps(at[counts[at] > 1]) for _, at, _ in asked]
    n = len(asked)
    return pa.table({"block": pa.array([a[0] for a in asked], pa.int64()), "row": pa.array([key[0].as_py()] * n, pa.int32()), "shard": pa.array([key[1].as_py()] * n, pa.int32()), "often": pa.array(often, pa.binary())})


def _often(grams: np.ndarray, said: list[np.ndarray], cells: int) -> np.ndarray:
    """Which grams have an estimate of 2 or more; said: the cells of each row that do, ascending."""
    found = np.ones(len(grams), bool)
    for row in range(ROWS):
        at = np.flatnonzero(found)
        if not len(said[row]):
            return np.zeros(len(grams), bool)
        cell = _cells(grams[at], row, cells)
        place = np.minimum(np.searchsorted(said[row], cell), len(said[row]) - 1)
        found[at] = said[row][place] == cell
    return found


#: A block's documents (owner -1): counts of words, digests of all words, and of those with windows of an estimate of 2 or more, the text and
#: where such windows start, sure where a smaller document of the block has it too, else which distinct one it is; `owners` (part 0) has the
#: owner of each distinct one in this order. And its distinct windows for an owner: h1, h2 and least, the smallest doc_id that has it.
ASKED = "block long, owner int, part int, doc_ids array<long>, n_words array<long>, digests array<string>, texts array<binary>, starts array<binary>, sure array<binary>, numbers array<binary>, owners binary, h1 binary, h2 binary, least binary"


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each owner with the places that name it, ascending, by one sort."""
    owner = owner.astype(np.int64)
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(owner[order[lo]]), order[lo:hi]


def _send_windows(cells: int, owners: int, with_text: bool):
    schema = arrow_schema(ASKED)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block, said = docs.column("block")[0].as_py(), []
        replies = sorted(zip(*(answers.column(c).to_pylist() for c in ("row", "shard", "often"))))
        for row in range(ROWS):
            said.append(np.concatenate([np.empty(0, np.int64), *(_from_gaps(o) + s * SHARD for r, s, o in replies if r == row)]))
        known, found, plain = WordNumbers(), [], []
        parts = sorted(zip(*(docs.column(c).to_pylist() for c in ("shard", "doc_ids", "sizes", "texts"))))
        for part, ids, sizes, data in parts:
            ends, data = np.cumsum(unpack_array(sizes, "<u8"), dtype=np.int64).tolist(), expand(data)
            texts = [data[i:j] for i, j in zip([0, *ends], ends)]
            words = Words([t if i is not None else b"" for i, t in zip(ids, texts)], known)
            first = len(plain)
            for hashes, starts, doc, at in words.windows():
                grams, best = _minimizers(hashes[:, 0])
                places, inverse = np.unique(best[starts], return_inverse=True)
                keep = np.flatnonzero(_often(grams[places], said, cells)[inverse])
                h1 = _rolling(hashes[:, 0], WINDOW, _M1)[starts[keep]]
                h2 = (_mix(_rolling(hashes[:, 1], WINDOW, _M2)[starts[keep]]) >> np.uint64(32)).astype("<u4")
                found.append((h1, h2, first + doc[keep], at[keep]))
            may = {int(d) - first for f in found for d in np.unique(f[2]) if d >= first}
            plain += [(i, *_digest(t), squeeze(t) if with_text or n in may else None, part) for n, (i, t) in enumerate(zip(ids, texts))]
        h1, h2, doc, at = map(np.concatenate, zip((np.empty(0, np.uint64), np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)), *found))
        del found, known
        ids = np.array([p[0] or 0 for p in plain], np.int64)[doc]
        order = np.lexsort((ids, h2, h1))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
        group = np.cumsum(fresh) - 1
        least = ids[order][fresh]
        sure = np.empty(len(order), bool)
        sure[order] = ids[order] > least[group]  # a smaller document of this block has the window: no one else need be asked
        number = np.empty(len(order), np.int64)
        number[order] = group
        head = order[fresh]
        rank = np.empty(len(head), np.int64)  # distinct windows are numbered by the place of their smallest document, so that numbers follow the texts
        rank[np.argsort(head)] = np.arange(len(head))
        number, head = rank[number], np.sort(head)
        owner = (h1[head] >> np.uint64(32)).astype(np.int64) * owners >> 32
        rows = []
        edges = np.searchsorted(doc, np.arange(len(plain) + 1))
        for lo in range(0, max(1, len(plain)), 500):
            own = range(lo, min(lo + 500, len(plain)))
            spans = [slice(edges[d], edges[d + 1]) for d in own]
            kept = [s.stop > s.start for s in spans]
            starts = [_gaps(at[s]) if k else None for s, k in zip(spans, kept)]
            bits = [np.packbits(sure[s]).tobytes() if k else None for s, k in zip(spans, kept)]
            numbers = [pack_array(np.diff(number[s], prepend=0).astype("<i4")) if k else None for s, k in zip(spans, kept)]
            rows.append((block, -1, lo, *([plain[d][i] for d in own] for i in range(4)), starts, bits, numbers, pack_array(owner.astype("<u4")) if not lo else None, None, None, None))
        for o, at_owner in _by_owner(owner):
            sent = head[at_owner]
            rows.append((block, o, 0, *[None] * 8, pack_array(h1[sent].astype("<u8")), pack_array(h2[sent]), pack_array(ids[sent].astype("<i8"))))
        return pa.Table.from_batches([table_of(rows, schema)])

    return run


def _answer_windows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """An owner's windows: each block is told which of its own a smaller doc_id than its smallest has."""
    asked = [[unpack_array(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("h1", "<u8"), ("h2", "<u4"), ("least", "<i8"))]
    h1, h2, least = map(np.concatenate, asked)
    order = np.lexsort((least, h2, h1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    gone = np.empty(len(order), bool)
    gone[order] = least[order] > least[order][fresh][np.cumsum(fresh) - 1]
    marks = [np.packbits(x).tobytes() for x in np.split(gone, np.cumsum([len(x) for x in asked[0]])[:-1])]
    return pa.table({"block": table.column("block"), "owner": pa.array([key[0].as_py()] * len(marks), pa.int32()), "gone": pa.array(marks, pa.binary())})


def _digest(text: bytes) -> tuple[int, str]:
    """The count of a text's words, and the SHA-256 of these, joined by spaces."""
    n, found = 0, hashlib.sha256()
    for words in word_parts(text):
        if words:
            found.update((b" " if n else b"") + b" ".join(words))
            n += len(words)
    return n, found.hexdigest()


def remove_covered(text: bytes, n: int, starts: np.ndarray) -> tuple[int, bytes]:
    """The words of a text of n words that no window of 50 from one of `starts` covers: their count, and they joined by spaces."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, n), -1)
    left, at, kept = np.cumsum(edge[:-1]) == 0, 0, []
    for words in word_parts(text):
        own = [words[i] for i in np.flatnonzero(left[at : at + len(words)])]
        at += len(words)
        if own:
            kept.append(b" ".join(own))
    return int(left.sum()), b" ".join(kept)


FOUND = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def _finish(with_text: bool):
    schema = arrow_schema(FOUND)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        owner = unpack_array(next(o for o in docs.column("owners").to_pylist() if o), "<u4")
        gone, out = np.zeros(len(owner), bool), []
        places = dict(_by_owner(owner))
        for o, marks in zip(*(answers.column(c).to_pylist() for c in ("owner", "gone"))):
            at = places[o]
            gone[at] = np.unpackbits(np.frombuffer(marks, np.uint8))[: len(at)].astype(bool)
        for part in docs.select(["doc_ids", "n_words", "digests", "texts", "starts", "sure", "numbers"]).to_pylist():
            rows = []
            for doc_id, n, digest, text, starts, sure, numbers in zip(*part.values()):
                left, removed = None, 0
                if starts is not None:
                    at = _from_gaps(starts)
                    hit = np.unpackbits(np.frombuffer(sure, np.uint8))[: len(at)].astype(bool) | gone[np.cumsum(unpack_array(numbers, "<i4"), dtype=np.int64)]
                    if hit.any():
                        stays, left = remove_covered(expand(text), n, at[hit])
                        removed, digest = n - stays, hashlib.sha256(left).hexdigest()
                if with_text and left is None:
                    left = b" ".join(expand(text).split())
                rows.append((doc_id, n, removed, digest, left if with_text else None))
            out.append(table_of(rows, schema))
        return pa.Table.from_batches(out, schema)

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, with_text: bool = True, block_bytes: int = BLOCK_BYTES, owner_bytes: int | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by spaces).

    Words are runs of anything but ASCII white space. A word goes if a window of 50 words covers it
    whose sequence also starts in a document with a smaller doc_id, judged on the input. Sequences
    are told apart by 96 bits: 64 and 32 bits of rolling hashes over two independent hashes of each
    word. A null text has no words. Rows without an id neither lose words nor cost others theirs.
    Rows that repeat an id are never compared with each other. An empty table gives no rows.

    Texts are read once and kept with their block, in tables bucketed by block, and so are never
    shuffled; nothing is broadcast or sent to the driver. A window that is in very many documents
    reaches its owner once from each block. `cells` (a power of 2; by default it follows the bytes
    of text) sizes the sketch: a fuller one lets more windows through to the exact pass, and never
    fewer than repeat. Messages are at most blocks x owners and at most the suspect windows, and a
    block's work is in proportion to its windows, not to the owners: from about a TB of text on,
    messages become small (some windows each), which larger blocks and owners (block_bytes,
    owner_bytes) put off. A long text stands alone in its block and is split in parts.
    Without `with_text`, `kept` is missing and only texts with suspect windows are written again.
    """
    spark = docs.sparkSession
    texts = text_of(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells or max(SHARD, 1 << (size // CELL_BYTES).bit_length())
    owners, buckets = 1 + size // (owner_bytes or OWNER_BYTES), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // (4 * block_bytes))
    sent = bucketed(texts.mapInArrow(_send_cells(cells, block_bytes), SENT), "cells", "block", buckets)
    said = sent.where("row >= 0").select("block", "row", "shard", "cells", "more").groupBy("row", "shard").applyInArrow(_count_cells, "block long, row int, shard int, often binary")
    own = sent.where("row < 0").select("block", "shard", "doc_ids", "sizes", "texts")
    asked = own.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_send_windows(cells, owners, with_text), ASKED)
    asked = bucketed(asked, "windows", "block", buckets)
    told = asked.where("owner >= 0").select("block", "owner", "h1", "h2", "least").groupBy("owner").applyInArrow(_answer_windows, "block long, owner int, gone binary")
    own = asked.where("owner < 0").drop("owner", "part", "h1", "h2", "least")
    found = own.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_finish(with_text), FOUND)
    return found.withColumn("kept", F.col("kept").cast("string")) if with_text else found.drop("kept")
