"""Exact dedup by a Golomb-coded fingerprint exchange.

Rows are written once, each at its home: the task that wrote it, a bucket key of that table. Each
task sorts the 48-bit fingerprints of its texts and sends them, as Golomb-Rice coded gaps, to the
owners of ranges of fingerprints. Owners answer with a bitmap for each message: which of its
fingerprints occurs again. The answers make one bitmap a home, of its rows that are suspects; it meets
the rows in their bucket, so only suspects' texts are shuffled, to be grouped by their bytes, and the
rest are unique.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import bucketed, columns_of, materialize, scratch, text_of

BITS = 48
SENT = "block long, owner long, n long, k int, first binary, rest binary, again binary, counts binary, keys binary"


def golomb_encode(values: np.ndarray, base: int) -> tuple[int, bytes, bytes]:
    """(k, unary quotients, k-bit remainders) of the gaps of ascending values, the first from base."""
    gaps = np.diff(values, prepend=np.int64(base))
    k = int(max(0, np.floor(np.log2(max(1.0, gaps.mean()))))) if len(gaps) else 0
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    low = ((gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, first: bytes, rest: bytes, base: int) -> np.ndarray:
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(first, np.uint8)) == 0)[:n]
    gaps = (np.diff(zeros, prepend=-1) - 1).astype(np.int64) << k
    if k:
        low = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
        gaps += low @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps) + base


def _owner_base(owner: int, owners: int) -> int:
    """The least fingerprint f with f * owners >> BITS == owner."""
    return -(-(owner << BITS) // owners)


def send(owners: int, most_rows: int = 1 << 20):
    """Task side: (key, print) rows to one coded message for each owner; a block has most_rows at most."""

    def block(keys: np.ndarray, prints: np.ndarray, number: int) -> pa.RecordBatch:
        order = np.argsort(prints, kind="stable")
        keys, prints = keys[order], prints[order]
        values, counts = np.unique(prints, return_counts=True)
        at = np.concatenate(([0], np.cumsum(counts)))
        bounds = np.searchsorted(values, [_owner_base(i, owners) for i in range(owners + 1)])
        rows: list[tuple] = []
        for owner in np.flatnonzero(np.diff(bounds)).tolist():
            lo, hi = int(bounds[owner]), int(bounds[owner + 1])
            k, first, rest = golomb_encode(values[lo:hi], _owner_base(owner, owners))
            rows.append((number, owner, hi - lo, k, first, rest, np.packbits(counts[lo:hi] > 1).tobytes(), counts[lo:hi].astype("<i4").tobytes(), keys[at[lo] : at[hi]].astype("<i8").tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
        names = [x.split()[0] for x in SENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append((b.column("key").to_numpy(zero_copy_only=False), b.column("print").to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows >= most_rows:
                yield block(*map(np.concatenate, zip(*held)), number)
                number, held, rows = number + 1, [], 0
        if rows:
            yield block(*map(np.concatenate, zip(*held)), number)

    return run


def answer(owners: int):
    """Owner side: a bitmap for each message, set where the fingerprint came from two places or twice from one."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = _owner_base(int(key[0]), owners)
        streams = [golomb_decode(n, k, a, b, base) for n, k, a, b in zip(pdf.n, pdf.k, pdf["first"], pdf.rest)]
        again = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8))[:n] for a, n in zip(pdf.again, pdf.n)]).astype(bool)
        values, inverse, counts = np.unique(np.concatenate(streams), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[inverse[again]] = True
        ends = np.cumsum(pdf.n.to_numpy())
        return pd.DataFrame({"block": pdf.block, "owner": pdf.owner, "marks": [np.packbits(x).tobytes() for x in np.split(twice[inverse], ends[:-1])]})

    return run


def _suspects(batches):
    for b in batches:
        out = [np.empty(0, np.int64)]
        for n, counts, keys, marks in zip(*(b.column(c).to_pylist() for c in ("n", "counts", "keys", "marks"))):
            marked = np.unpackbits(np.frombuffer(marks, np.uint8))[:n].astype(bool)
            out.append(np.frombuffer(keys, "<i8")[np.repeat(marked, np.frombuffer(counts, "<i4"))])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["key"])


#: Bits of a row's place within its home, as monotonically_increasing_id lays them out.
PLACE_BITS = 33


def at_home(rows: DataFrame) -> DataFrame:
    """rows, place (unique, and stable from now on) and home (the task that wrote the row), as a table in buckets of home.

    What is sent to a home meets its rows without a shuffle of these. Buckets are as many as
    spark.sql.shuffle.partitions; a task writes one file.
    """
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumn("home", F.shiftright("place", PLACE_BITS))
    return bucketed(placed, "homes", "home", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bitmap(pdf: pd.DataFrame) -> pd.DataFrame:
    """A home's bitmap in words of 64 bits, set at the places given."""
    at = pdf["place"].to_numpy() & ((1 << PLACE_BITS) - 1)
    bits = np.zeros(-(-(int(at.max()) + 1) // 64) * 64, np.uint8)
    bits[at] = 1
    return pd.DataFrame({"to_home": [pdf["home"].iloc[0]], "words": [np.packbits(bits, bitorder="little").view("<i8")]})


def join_marked(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """The rows of an at_home table at these places (left_semi), or all others (left_anti): places are sent home as one bitmap each."""
    homes = places.select("place", F.shiftright("place", PLACE_BITS).alias("home")).groupBy("home").applyInPandas(_bitmap, "to_home long, words array<long>")
    marks = materialize(homes, "bitmaps")
    at = rows["place"].bitwiseAND((1 << PLACE_BITS) - 1)
    marked = F.bit_get(F.get(marks["words"], F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1
    return rows.join(marks.hint("shuffle_hash"), (rows["home"] == marks["to_home"]) & marked, how)


def suspects(texts: DataFrame, per_owner: int = 1 << 18) -> DataFrame:
    """(place) of each row of an at_home table whose text's fingerprint occurs more than once.

    The count of owners follows the row count, so an owner reads about `per_owner` fingerprints.
    """
    owners = max(1, -(-texts.count() // per_owner))
    prints = texts.select(F.col("place").alias("key"), F.shiftrightunsigned(F.xxhash64("text"), 64 - BITS).alias("print"))
    sent = materialize(prints.mapInArrow(send(owners), SENT), "prints")
    marks = sent.select("block", "owner", "n", "k", "first", "rest", "again").groupBy("owner").applyInPandas(answer(owners), "block long, owner long, marks binary")
    back = sent.select("block", "owner", "n", "counts", "keys").join(marks, ["block", "owner"])
    return back.mapInArrow(_suspects, "place long")


def copy_groups(texts: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, keep_place, group_size) of each text of an at_home table that occurs more than once, compared byte by byte.

    Grouping is by the text itself after a partial aggregate in each task, so a hot group sends one
    row a task. The SHA-256 is a verified group's handle.
    """
    marked = join_marked(texts, suspects(texts), "left_semi")
    last = F.max(F.struct("doc_id", (-F.col("place")).alias("less"))).alias("last")
    groups = marked.groupBy("text").agg(last, F.count("*").alias("group_size")).where("group_size > 1")
    return groups.select(F.sha2("text", 256).alias("text_sha256"), F.col("last.doc_id").alias("keep_id"), (-F.col("last.less")).alias("keep_place"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is an empty one. The largest doc_id of a group
    stays (a null id is below all others). Rows that repeat both id and text are one document: each
    carries the same decision and all count in group_size. An empty table gives no rows; other
    columns are ignored. The join back is by SHA-256, its hot keys split by AQE.
    """
    texts = at_home(text_of(docs, id_col, text_col))
    all_docs = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    with scratch(docs.sparkSession) as keep:
        groups = keep(copy_groups(texts), "groups")
    return all_docs.join(groups.hint("merge"), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, one_each: bool = False) -> DataFrame:
    """docs (all its columns, of any type) without the rows that exact_dedup drops.

    Rows that repeat the kept row's id and text stay with it, and of a group whose ids are all null
    every row stays; with one_each, one row of a group stays. A null text equals an empty one; an
    empty table gives no rows. Rows stay where they were written: the places of those that go are
    sent to them.
    """
    rows = at_home(docs.select(F.struct(*columns_of(docs)).alias("doc")))
    texts = rows.select("home", "place", F.col("doc.doc_id").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    other = F.col("place") != F.col("keep_place") if one_each else ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    with scratch(docs.sparkSession) as keep:
        groups = materialize(copy_groups(texts), "groups")
        lost = texts.select("place", "doc_id", F.sha2("text", 256).alias("text_sha256")).join(groups.hint("merge"), "text_sha256").where(other)
        lost = keep(lost.select("place"), "lost")
    return join_marked(rows, lost, "left_anti").select("doc.*")
