"""What the operators share: shared tables, Arrow helpers, connected components."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: on local[...] a temporary one, kept in the session; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='brightwell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: the lineage ends there,
    lost executors cost nothing that was written, and the planner knows the table's true size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append((path, None))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like materialize, as a table in buckets of the key: where it is joined by that key, it isn't shuffled. There are no more buckets than Spark takes."""
    buckets = min(buckets, int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{table}"
    _made.append((path, table))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Shared tables made within it go at its end, from the folder and the catalog, but for those written by the function it gives (like materialize).

    A result that reads such tables must be written within it: an operator's result is lazy.
    """
    before, kept = len(_made), []

    def keep(df: DataFrame, name: str, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
        found = write(df, name)
        kept.append(_made[-1])
        return found

    try:
        yield keep
    finally:
        for path, table in _made[before:]:
            if (path, table) not in kept:
                if table:
                    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made[before:] = kept


#: The shared tables made so far: (path, name in the catalog or None).
_made: list[tuple[str, str | None]] = []
_SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of rows in a batch that Spark hands to a Python task.
BATCH_BYTES = 4 << 20


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the whole text (null: empty), so that no other column's name can clash.

    As texts are about to go to Python tasks, the session's batches are bounded by bytes, and not
    only by a count of rows, which says nothing of memory where texts are long.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """The batch in runs of rows of about `most_bytes` of that column (a longer row stands alone)."""
    sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(np.nan_to_num(sizes)):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def word_parts(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (runs of anything but ASCII white space), in parts of about `step` bytes."""
    lo = 0
    while lo < len(text):
        hi = lo + step
        end = _SPACE.search(text, hi)
        hi = end.start() if end else len(text)
        yield text[lo:hi].split()
        lo = hi


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... (lengths[0] of them), then those of starts[1], and so on."""
    total = int(lengths.sum())
    offset = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts, lengths)
    return offset + np.arange(total, dtype=np.int64)


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (src, dst): root is the smallest node reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) as joins and min-aggregates;
    no neighbour list is ever gathered. Both sides of each join are read from tables just written, so
    a hub is a skewed join key that AQE splits (it does so only where a side comes straight from its
    shuffle), or the least neighbours are broadcast where their size is under Spark's threshold. The
    number of rounds grows with the logarithm of the longest chain.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs, before = materialize(pairs.distinct(), "links"), None

    def to_least(rows: DataFrame, least: DataFrame, kept: str) -> DataFrame:
        return rows.where(kept).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(to_least(both, least, "v > u").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = to_least(large, least, "true").where("u <> v")
        pairs = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 1)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def pack_array(values: np.ndarray) -> bytes:
    """An array, compressed byte plane by byte plane."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpack_array(code: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(code), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows (tuples in the schema's order) as one batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)
