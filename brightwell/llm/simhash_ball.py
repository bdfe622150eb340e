"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 2 or less share a value within distance 1 of each. So every
distinct fingerprint emits its 65 variants of half the radius, and those that meet on a variant are
linked. A variant has at most 65 such neighbours, so no bucket grows with the data.
"""
from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.common import columns_of, connected_components, materialize, scratch, slices, text_of, word_parts
from brightwell.llm.exact_dedup import at_home, join_marked
from brightwell.llm.minhash_bands import bands, digest_key, grams, lost_texts

RADIUS = 2


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text (UTF-8), unsigned; 0 if it has no word.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are `width`
    words joined by spaces (a shorter text: all its words). Hashes are XXH64; a bit is set if more
    than half of the hashes have it. Long texts are summed in blocks.
    """
    from xxhash import xxh64_intdigest

    # on bytes, only A-Z change and only the six ASCII spaces part words
    counts, n, held, hashed = np.zeros(64, np.int64), 0, [], partial(xxh64_intdigest, seed=seed)
    for part in word_parts(text.lower()):
        held += part
        if len(held) >= width:
            counts, n = counts + _bits(map(hashed, map(b" ".join, zip(*(held[i:] for i in range(width)))))), n + len(held) - width + 1
            held = held[len(held) - width + 1 :]
    if not n and held:
        counts, n = _bits([hashed(b" ".join(held))]), 1
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bits(hashes) -> np.ndarray:
    """How many of the hashes have each bit."""
    found = np.fromiter(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(found), 1 << 15):
        total += np.unpackbits(found[lo : lo + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return total


def _fingerprints(batches):
    for batch in batches:
        for b in slices(batch, "text"):
            prints = np.fromiter((fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def links(nodes: DataFrame) -> DataFrame:
    """(src, dst) among distinct fingerprints (fp): enough pairs at distance 2 or less to connect all such pairs.

    The members of a variant's bucket are all within the radius of each other, so each is linked
    to the one before it; the same pair from several variants is kept once and verified.

    Two bits spoil two of a fingerprint's four quarters at most, so fingerprints that share no two
    quarters with another one have no link, and only the others' variants are made.
    """
    quarter = [F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    halves = F.array(*(quarter[i] + F.shiftleft(quarter[j], 16) + F.lit(n << 32) for n, (i, j) in enumerate(combinations(range(4), 2))))
    shared = nodes.select("fp", F.explode(halves).alias("half")).withColumn("count", F.count("*").over(Window.partitionBy("half")))
    nodes = materialize(shared.where("count > 1").select("fp").distinct(), "close")
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    variants = nodes.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("other", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))).where("other is not null")
    pairs = met.select(F.col("other").alias("src"), F.col("fp").alias("dst")).distinct()
    return pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of distance 2 or less; equal
    fingerprints link at distance 0, the zero fingerprint of wordless texts like any other. Null
    text: empty. A null doc_id keeps its row and is never a component's id unless all ids there are
    null. Repeated rows repeat in the result. An empty table gives no rows. Equal fingerprints meet
    in a partial aggregate, so a large group of copies is one node.
    """
    prints = materialize(text_of(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    with scratch(docs.sparkSession) as keep:
        nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        roots = connected_components(links(prints.select("fp").distinct()))
        placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        placed = materialize(placed, "placed")
        # both sides are read from tables, so that a component of very many fingerprints is a key that AQE can split
        least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
        classes = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
        classes = keep(classes, "classes")  # read from a table, so that a fingerprint of very many documents is a key that AQE can split
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signed(batches):
    """(place, doc_id, key, fp, n, bands): a text's fingerprint, its count of shingles and the hashes of its bands."""
    for batch in batches:
        for b in slices(batch, "text", 1 << 20):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            sizes, lists = [], []
            for t in texts:
                hashes = grams(t)
                sizes.append(len(hashes))
                lists.append(bands(hashes))
            columns = [*(b.column(c) for c in ("place", "doc_id", "key")), pa.array(prints.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "doc_id", "key", "fp", "n", "bands"])


def _grams(batches):
    """(key, grams) of (key, text)."""
    for batch in batches:
        for b in slices(batch, "text", 1 << 20):
            found = pa.array([grams(t).astype("<u8").tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), found], ["key", "grams"])


def drop_near_copies(docs: DataFrame, one_each: bool = False) -> DataFrame:
    """docs (all its columns, of any type) without near copies: a row goes only if a row that stays has a text alike to its own.

    Texts are alike when their sets of five-word shingles (word_jaccard: lower-cased, split at white
    space; fewer words: one shingle; null, empty and blank texts are alike) have a Jaccard similarity
    of 0.8 or more, counted on whole texts by 64-bit hashes of the shingles. Candidates are texts of
    one SimHash component, and texts that share a band of MinHash values, as few pairs of 0.8 are
    within the radius. The smallest doc_id stays, but for chains of many texts (settle); a null id is
    above all others. Of one text, the rows of its smallest id stay; with one_each, one of these.
    Rows of one id with unlike texts go or stay by their own text. An empty table gives no rows.
    Texts are told apart by their MD5. Long texts are read in parts.

    Rows are written once, at their home, and the places of those that go are sent there, so no text
    is shuffled; the hashes of texts in candidate pairs are.
    """
    rows = at_home(docs.select(F.struct(*columns_of(docs)).alias("doc")))
    texts = rows.select("home", "place", F.col("doc.doc_id").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text")).withColumn("key", digest_key(F.col("text")))
    text_of(docs, "doc_id", "text")  # bounds the session's batches by bytes
    with scratch(docs.sparkSession) as keep:
        signed = materialize(texts.select("place", "doc_id", "key", "text").mapInArrow(_signed, "place long, doc_id long, key binary, fp long, n long, bands array<long>"), "signatures")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "place")).alias("first")
        nodes = signed.groupBy("key").agg(first, F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in ("fp", "n", "bands")))
        roots = connected_components(links(signed.select("fp").distinct()))
        component = F.xxhash64(F.lit("component"), F.coalesce("root", "fp"))
        nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("bands", F.concat("bands", F.array(component)))
        nodes = materialize(nodes.select("key", F.col("first.doc_id").alias("least"), F.col("first.place").alias("place"), "copies", "n", "bands"), "nodes")

        def grams_of(places: DataFrame) -> DataFrame:
            found = join_marked(texts, places.withColumnRenamed("key", "place"), "left_semi")
            return found.select(F.col("place").alias("key"), "text").mapInArrow(_grams, "key long, grams binary")

        # among themselves, distinct texts are the places of their first rows
        gone = lost_texts(nodes.select(F.col("place").alias("key"), "least", "n", "bands"), grams_of)
        gone = materialize(gone.select(F.col("key").alias("stays"), F.lit(True).alias("gone")), "gone")
        marked = nodes.select("key", "least", F.col("place").alias("stays"), "copies").join(gone, "stays", "left").where("gone or copies > 1")
        other = F.col("place") != F.col("stays") if one_each else ~F.col("doc_id").eqNullSafe(F.col("least"))
        lost = signed.select("place", "doc_id", "key").join(materialize(marked, "marked"), "key").where(F.col("gone").isNotNull() | other)
        lost = keep(lost.select("place"), "lost")
    return join_marked(rows, lost, "left_anti").select("doc.*")
