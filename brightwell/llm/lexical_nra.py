"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Tasks read texts once and keep, for shards of documents, the occurrences of the queries' terms. With
the corpus' counts known, a shard sorts each term's list by impact. For each query, the lists are
read from their heads: a document's score lies between what was read of it and that plus the heads
of the lists where it wasn't met yet. Reading goes on until the best documents, their ties and their
scores are certain. The best of all shards are merged.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.common import arrow_schema, materialize, pack_array, slices, table_of, text_of, unpack_array

#: Each byte's lower-cased self where terms have it (digits, letters, all but ASCII), else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a long text that are split at a time.
STEP = 1 << 20
#: A shard ends at so many documents, or occurrences of (document, term).
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Bytes of queries that are answered in one reading of the documents.
QUERY_BYTES = 4 << 20
#: Places of each list in the first round of reading, and by how much a round goes deeper than the one before.
DEPTH, DEEPER = 256, 4
#: A shard: its documents that have terms and all terms of these; the documents that hold a query's term, their lengths; for each such term,
#: ascending, the count of its documents, and these with their occurrences.
SHARDS = "n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms array<int>, counts array<int>, docs binary, tfs binary"
FOUND = "item long, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in parts of about STEP bytes."""
    plain, lo = text.translate(FOLD), 0
    while lo < len(plain):
        end = plain.find(b" ", lo + STEP)
        hi = end if end >= 0 else len(plain)
        yield plain[lo:hi].split()
        lo = hi


def _shards(numbers):
    """Task side: documents to SHARDS; numbers: the number of each term of a query."""
    schema = arrow_schema(SHARDS)

    def shard(n_docs: int, n_terms: int, ids: list, lengths: list[int], found: list[Counter]) -> pa.RecordBatch:
        size = np.fromiter(map(len, found), np.int64, len(found))
        term = np.fromiter((t for c in found for t in c), np.int64, int(size.sum()))
        tf = np.fromiter((n for c in found for n in c.values()), np.int64, len(term))
        order = np.argsort(term, kind="stable")
        terms, counts = np.unique(term, return_counts=True)
        docs = np.repeat(np.arange(len(found)), size)[order]
        row = (n_docs, n_terms, ids, pack_array(np.array(lengths, "<i8")), terms.tolist(), counts.tolist(), pack_array(docs.astype("<u4")), pack_array(tf[order].astype("<i8")))
        return table_of([row], schema)

    def run(batches):
        known = numbers.value
        n_docs, n_terms, ids, lengths, found, held = 0, 0, [], [], [], 0
        for batch in batches:
            for b in slices(batch, "text"):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                    n, counted = 0, Counter()
                    for part in terms_of(text):
                        n += len(part)
                        counted.update(filter(known.__contains__, part))
                    n_docs, n_terms = n_docs + (n > 0), n_terms + n
                    if counted:
                        ids.append(doc_id)
                        lengths.append(n)
                        found.append(Counter({known[t]: c for t, c in counted.items()}))
                        held += len(counted)
                    if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                        yield shard(n_docs, n_terms, ids, lengths, found)
                        n_docs, n_terms, ids, lengths, found, held = 0, 0, [], [], [], 0
        if n_docs:
            yield shard(n_docs, n_terms, ids, lengths, found)

    return run


def weight(n: int, df: int) -> int:
    """A term's weight, of n documents and the df that hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): the k highest sums over the lists and all that tie with the last of these, in no order.

    A list holds documents (below n, each once) and what they score there, above 0 and descending.
    """
    lower, ends, depth = np.zeros(n, np.int64), [0] * len(lists), DEPTH
    while True:
        heads = []
        for i, (docs, scores) in enumerate(lists):
            end = min(len(docs), depth)
            lower[docs[ends[i] : end]] += scores[ends[i] : end]
            ends[i] = end
            heads.append(int(scores[end]) if end < len(docs) else 0)
        met, left = np.flatnonzero(lower), sum(heads)
        least = int(np.partition(lower[met], len(met) - k)[len(met) - k]) if len(met) >= k else 0
        if not left:
            best = met[lower[met] >= least]
            return best, lower[best]
        if least > left:  # what wasn't met at all can't be among the best
            rest = np.full(n, left, np.int64)
            for (docs, _), end, head in zip(lists, ends, heads):
                if head:
                    rest[docs[:end]] -= head
            may = met[lower[met] + rest[met] >= least]
            if not rest[may].any():
                best = may[lower[may] >= least]
                return best, lower[best]
        depth *= DEEPER


def _search(asked, k: int):
    """Task side: each shard's best for each query."""
    schema = arrow_schema(FOUND)

    def run(batches):
        items, weights, n_docs, n_terms = asked.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths = unpack_array(row["lengths"], "<i8")
                docs, tf = unpack_array(row["docs"], "<u4").astype(np.int64), unpack_array(row["tfs"], "<i8")
                m = 25 + (75 * lengths * n_docs) // n_terms
                impact = (10**9 * tf) // (1000 * tf + 8 * m[docs])
                counts = np.array(row["counts"], np.int64)
                order = np.lexsort((docs, -impact, np.repeat(np.arange(len(counts)), counts)))
                docs, impact = docs[order], impact[order]
                ends = np.cumsum(counts)
                span = {t: slice(e - c, e) for t, e, c in zip(row["terms"], ends.tolist(), counts.tolist())}
                ids, rows = row["doc_ids"], []
                for item, terms in items:
                    lists = [(docs[span[t]], impact[span[t]] * (weights[t] * n)) for t, n in terms if t in span and weights[t] > 0]
                    if lists:
                        best = sorted(zip(*(x.tolist() for x in nra(lists, len(ids), k))), key=lambda x: (-x[1], ids[x[0]] is None, ids[x[0]] or 0))
                        rows += [(item, ids[d], score) for d, score in best[:k]]
                if rows:
                    yield table_of(rows, schema)

    return run


def _answer(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(item, doc_id, score): the best of each shard for a block of queries."""
    spark = docs.sparkSession
    counted = [(item, Counter(t for part in terms_of(text) for t in part)) for item, text in items]
    numbers = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
    shards = materialize(docs.mapInArrow(_shards(spark.sparkContext.broadcast(numbers)), SHARDS), "postings")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weights = {r["terms"]: weight(n_docs, r["df"]) for r in held.collect()}
    asked = spark.sparkContext.broadcast(([(item, sorted((numbers[t], n) for t, n in c.items())) for item, c in counted], weights, n_docs, n_terms))
    return shards.mapInArrow(_search(asked, k), FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items its k best documents with a score above 0, equal scores by ascending doc_id.

    A term is a run of ASCII letters (lower-cased), digits and any other characters than ASCII. A
    document scores the sum of weight x saturated frequency over the query's terms, repeats included
    (see _search and weight for the integers). Null and empty texts have no terms: such documents
    count nowhere, such queries get no rows. Equal rows of items are queries each; rows that repeat
    a document are documents each. A null doc_id ranks after others of its score. An empty table
    gives no rows; other columns are ignored. Long texts are split in parts.

    Texts are read once for each query_bytes of queries and never shuffled. A block of queries, its
    terms and their weights are broadcast (a block has about query_bytes of text; a longer query
    stands alone). A shard's postings and bounds are what a task holds. Each shard sends at most k
    rows a query, and of these each task k on to the ranking.
    """
    spark = docs.sparkSession
    texts = text_of(docs, id_col, text_col)
    queries = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.coalesce(F.col(query_col), F.lit("")).cast("binary").alias("query"))
    queries = materialize(queries, "queries")
    blocks = 1 + (queries.agg(F.sum(F.octet_length("query"))).first()[0] or 0) // query_bytes
    found = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "query").collect()
        if rows:
            found = found.unionByName(_answer(texts, [(r["item"], bytes(r["query"])) for r in rows], k))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return queries.select("item", "item_id").join(best, "item").select("item_id", "rank", "doc_id", "score")
