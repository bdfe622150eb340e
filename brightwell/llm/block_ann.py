"""Nearest neighbours by a block matrix join with int8 tiles and exact bounds.

Vectors are packed into blocks with int8 codes, scales and the norms of what quantisation lost. A
tile multiplies the codes of a group of queries with those of a group of candidates; the product
and its error bound tell which pairs can still be among the k nearest. Only these are computed on
the original vectors, in double precision, and the tiles' short lists are merged by heaps.

Candidates are grouped by norm. Queries first meet the group of the largest norms, then, round by
round, three times as many groups as they have met. The k-th product found so far goes with each
query: it tells how large a norm must be for a product to matter, so that groups of smaller norms are
never sent, and pairs that don't reach it aren't returned.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwell.llm.common import arrow_schema, materialize, table_of

BLOCK = "dim int, part long, n long, ids binary, codes binary, scale binary, lost binary, norm binary, vectors binary, top double"
MERGE = 32


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, norm of the rest) of float64 rows: row = scale * codes + rest."""
    with np.errstate(all="ignore"):
        scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)  # a smaller one could underflow
        codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
        return codes, scale, norms(x - codes * scale[:, None])


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows, not too small where squares underflow; infinite where they overflow."""
    with np.errstate(all="ignore"):
        return np.linalg.norm(x, axis=1) + 1e-150


def _blocks(kind: str, most_rows: int):
    names = [c.split()[0] for c in BLOCK.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.float64()]

    def row(ids: np.ndarray, x: np.ndarray, part: int) -> tuple:
        codes, scale, lost = quantize(x.astype(np.float64))
        norm = norms(x.astype(np.float64))
        return x.shape[1], part, len(ids), ids.astype("<i8").tobytes(), codes.tobytes(), scale.tobytes(), lost.tobytes(), norm.tobytes(), x.tobytes(), float(norm.max())

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 24
        for b in batches:
            ids, lists = b.column("vec_id").to_numpy(), b.column("embedding")
            dims = pa.compute.list_value_length(lists).to_numpy()
            rows = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), most_rows):
                    own = at[lo : lo + most_rows]
                    x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(own), dim)
                    rows.append(row(ids[own], x, part))
                    part += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return run


class _Side:
    """The blocks of one group, end to end."""

    def __init__(self, table: pa.Table, kind: str):
        def flat(name, dtype):
            return np.concatenate([np.frombuffer(v, dtype) for v in table.column(name).to_pylist()])

        self.ids = flat("ids", "<i8")
        self.codes = flat("codes", np.int8).reshape(len(self.ids), -1)
        self.scale, self.lost, self.norm = flat("scale", np.float64), flat("lost", np.float64), flat("norm", np.float64)
        self.vectors = flat("vectors", kind).reshape(len(self.ids), -1)
        #: What a pair of each query has to reach: the k-th product found so far, and its vec_id.
        self.floor = (flat("floor", np.float64), flat("floor_id", "<i8")) if "floor" in table.column_names else None


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, the terms added in order."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


def tile(q: _Side, c: _Side, k: int, rows: int = 256, columns: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, exact products) of each query's k nearest of these candidates, each id once, without those behind the query's floor; and each query's k-th product.

    A tile is `rows` queries by `columns` candidates. What a query has found so far is carried on: its
    k-th best product bounds the pairs of later tiles. Bounds that aren't finite exclude nothing.
    """
    wide = np.float32 if 127 * 127 * q.codes.shape[1] < 1 << 24 else np.float64  # sums of code products stay exact
    out = []
    for lo in range(0, len(q.ids), rows):
        own = slice(lo, min(lo + rows, len(q.ids)))
        codes, n = q.codes[own].astype(wide), own.stop - lo
        row, cid, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        kth = q.floor[0][own].copy() if q.floor else np.full(n, -np.inf)
        for at in range(0, len(c.ids), columns):
            side = slice(at, min(at + columns, len(c.ids)))
            with np.errstate(all="ignore"):
                near = (codes @ c.codes[side].astype(wide).T).astype(np.float64) * (q.scale[own, None] * c.scale[side])
                c_norm = c.norm[side] + c.lost[side]
                bound = (q.norm[own] + q.lost[own])[:, None] * c.lost[side] + q.lost[own, None] * c_norm
                bound += 1e-12 * (q.norm[own, None] * c_norm) + 1e-300
                low, high = near - bound, near + bound
            sure = np.isfinite(low) & np.isfinite(high)
            low, high = np.where(sure, low, -np.inf), np.where(sure, high, np.inf)
            self_pairs = q.ids[own, None] == c.ids[side]
            low[self_pairs] = -np.inf
            repeats = int(np.unique(c.ids[side], return_counts=True)[1].max())
            keep = k * repeats  # so many rows hold k ids at least
            least = kth if keep > low.shape[1] else np.maximum(kth, np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep])
            qi, ci = np.nonzero((high >= least[:, None]) & ~self_pairs)
            row = np.concatenate((row, qi))
            score = np.concatenate((score, exact_products(q.vectors[own][qi], c.vectors[side][ci])))
            cid = np.concatenate((cid, c.ids[side][ci]))
            row, cid, score = _best(row, cid, score, k)
            counts = np.bincount(row, minlength=n)
            full = np.flatnonzero(counts >= k)
            kth[full] = np.fmax(kth[full], score[(np.cumsum(counts) - 1)[full]])  # no number bounds nothing
        if q.floor:
            least, least_id = (x[own][row] for x in q.floor)
            ahead = (least == -np.inf) | (score > least) | ((score == least) & (cid < least_id))
            row, cid, score = row[ahead], cid[ahead], score[ahead]
        out.append((q.ids[own][row], cid, score, kth))
    return tuple(map(np.concatenate, zip(*out)))


def _best(row: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, in order: by product, then id; of an id, its best product."""
    order = np.lexsort((-score, cid, row))
    row, cid, score = row[order], cid[order], score[order]
    first = np.ones(len(row), bool)
    first[1:] = (np.diff(row) != 0) | (np.diff(cid) != 0)
    row, cid, score = row[first], cid[first], score[first]
    order = np.lexsort((cid, -score, row))
    row, cid, score = row[order], cid[order], score[order]
    starts = np.searchsorted(row, row, side="left")
    short = np.arange(len(row)) - starts < k
    return row[short], cid[short], score[short]


PAIRS = "bucket long, node long, query_id long, vec_id long, score double"
FLOORS = "bucket long, dim int, part long, floor binary, floor_id binary, need double"
#: Products and norms are off by less than so much of themselves.
SLACK = 1e-9


def _pairs(bucket, node, qid, cid, score) -> pa.Table:
    n = len(qid)
    return pa.table({"bucket": pa.array(np.full(n, bucket, np.int64)), "node": pa.array(np.full(n, node, np.int64)), "query_id": pa.array(np.asarray(qid, np.int64)), "vec_id": pa.array(np.asarray(cid, np.int64)), "score": pa.array(np.asarray(score, np.float64))})


def least_norm(norm: np.ndarray, kth: np.ndarray) -> float:
    """The norm that a vector needs for a product with some of these queries to reach what is their k-th best so far; minus infinity if any will do."""
    with np.errstate(all="ignore"):
        need = kth / (norm * (1 + SLACK))
    return float(np.where((kth > 0) & np.isfinite(need), need, -np.inf).min())


def _tile(k: int, kind: str):
    """Task side: a group of queries and one of candidates to PAIRS."""

    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _pairs(0, 0, [], [], [])
        return _pairs(key[0].as_py(), key[1].as_py(), *tile(_Side(queries, kind), _Side(candidates, kind), k)[:3])

    return run


def _floors(k: int):
    """Task side: a bucket's blocks of queries and the best pairs so far to each block's floors (_Side) and least norm."""
    schema = arrow_schema(FLOORS)

    def run(key: tuple, blocks: pa.Table, best: pa.Table) -> pa.Table:
        qid, cid, score = (best.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
        order = np.lexsort((cid, -score, qid))
        qid, cid, score = qid[order], cid[order], score[order]
        known, start, count = np.unique(qid, return_index=True, return_counts=True)
        at = start[count >= k] + k - 1
        known, score, cid = known[count >= k], score[at], cid[at]
        rows = []
        for dim, part, ids, norm in zip(*(blocks.column(c).to_pylist() for c in ("dim", "part", "ids", "norm"))):
            ids, floor = np.frombuffer(ids, "<i8"), np.full(len(ids) // 8, -np.inf)
            floor_id = np.zeros(len(ids), np.int64)
            if len(known):
                to = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                own = (known[to] == ids) & ~np.isnan(score[to])  # no number bounds nothing
                floor[own], floor_id[own] = score[to][own], cid[to][own]
            rows.append((key[0].as_py(), dim, part, floor.tobytes(), floor_id.tobytes(), least_norm(np.frombuffer(norm), floor)))
        return pa.Table.from_batches([table_of(rows, schema)])

    return run


def merge_heaps(lists: list[list[tuple[float, int]]], k: int) -> list[tuple[float, int]]:
    """The k first of sorted lists of (-score, id), each id once, by a heap over the lists' heads; no numbers come last."""
    out, seen = [], set()
    for score, i in heapq.merge(*lists, key=lambda p: (p[0] != p[0], *p)):
        if i not in seen:
            seen.add(i)
            out.append((score, i))
            if len(out) == k:
                break
    return out


def _merge(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        qid, cid, score, node = (table.column(c).to_numpy() for c in ("query_id", "vec_id", "score", "from"))
        order = np.lexsort((cid, -score, node, qid))
        qid, cid, score, node = qid[order], cid[order], score[order], node[order]
        edge = np.flatnonzero((np.diff(qid, prepend=qid[0] - 1) != 0) | (np.diff(node, prepend=node[0] - 1) != 0))
        found: dict[int, list] = {}
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(qid)]):
            found.setdefault(int(qid[lo]), []).append(list(zip((-score[lo:hi]).tolist(), cid[lo:hi].tolist())))
        best = {q: merge_heaps(lists, k) for q, lists in found.items()}
        rows = [(q, i, -s) for q, near in best.items() for s, i in near]
        return _pairs(key[0].as_py(), key[1].as_py(), *(zip(*rows) if rows else ([], [], [])))

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector that isn't null, zero or empty and whose components are all finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 4096, block_rows: int = 1024, group_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row whose id is divisible by `every`.

    Exact: bounds discard only pairs that k others beat for certain, and bounds that overflow discard
    nothing. Ties go to the smaller vec_id; a row never finds its own id. Vectors that `usable`
    refuses take no part; vectors of unlike lengths never meet. Pairs whose product is no number
    (infinities of both signs among its terms) come last. Rows that repeat an id are candidates each,
    and an id is listed once, at its best score. With fewer than k candidates all are listed; an
    empty table gives no rows. Other columns are ignored.

    Candidates are dealt by norm, in groups of about `group_bytes` of vectors, whatever their length,
    and queries in groups of about `query_rows`. A task holds one group of each, carries each query's
    k best over its candidates and returns no more than these. All queries meet the group of the
    largest norms, and then in each round three times the groups met before, but only those whose norms
    are large enough for what was found. A task returns only pairs that come before the k-th found in
    earlier rounds: if products don't depend on the group, that is some 3 k pairs a query and round, so
    pairs grow with the logarithm of the groups. Where all norms are alike, every group meets every
    group. Short lists are merged in rounds of MERGE groups.
    """
    rows = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    kind = "<f8" if isinstance(vectors.schema[vector_col].dataType.elementType, T.DoubleType) else "<f4"
    queries = materialize(rows.where(F.col("vec_id") % every == 0).mapInArrow(_blocks(kind, block_rows), BLOCK), "queries")
    n_c, bytes_c = rows.agg(F.count("*"), F.sum(F.size("embedding").cast("long") * int(kind[-1]))).first()
    n_q = queries.agg(F.sum("n")).first()[0] or 0
    groups_q = max(1, -(-n_q // query_rows))
    # no fewer tasks than the session has partitions for, where there are blocks enough
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")) // groups_q, n_c // (4 * block_rows))
    groups_c = max(1, spread, -(-(bytes_c or 0) // group_bytes))
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("squares", squares).repartitionByRange(groups_c, F.desc("squares"), "vec_id").select("vec_id", "embedding")
    candidates = materialize(dealt.mapInArrow(_blocks(kind, block_rows), BLOCK), "candidates")
    # groups follow the bytes, also where Spark dealt more partitions than asked for
    parts = (candidates.agg(F.max("part")).first()[0] or 0) // (1 << 24) + 1
    candidates = candidates.withColumn("node", F.expr(f"(shiftright(part, 24) * {min(groups_c, parts)}) div {parts}"))
    queries = queries.withColumn("bucket", F.pmod(F.xxhash64("dim", "part"), F.lit(groups_q)))

    nodes = materialize(candidates.groupBy("node", "dim").agg(F.max("top").alias("top")), "nodes")
    lo, hi = nodes.agg(F.min("node"), F.max("node")).first()
    keys = ["bucket", "node", "dim"]

    def meet(asking: DataFrame, sent: DataFrame) -> DataFrame:
        """sent: (bucket, node, dim) of the groups that meet."""
        left, right = asking.join(sent, ["bucket", "dim"]), candidates.join(sent, ["node", "dim"])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k, kind), PAIRS)

    asked = materialize(queries.select("bucket", "dim").distinct(), "asked")
    needs, asking, best = asked.withColumn("need", F.lit(float("-inf"))), queries, None
    at, number = lo or 0, 0
    while True:
        behind = min(4 * at - 3 * (lo or 0) - 1, hi or 0) if number else at  # the last group of this round
        own = nodes.where(F.col("node").between(at, behind)).withColumnRenamed("dim", "of_dim")
        sent = needs.join(own, (F.col("dim") == F.col("of_dim")) & (F.col("top") * (1 + SLACK) >= F.col("need"))).select(*keys)
        found = materialize(meet(asking, materialize(sent, f"sent{number or ''}")), f"found{number}").withColumn("node", F.col("node") - at + 1)
        found, width = found if best is None else found.unionByName(best), behind - at + 2
        while width > 1:
            above = found.withColumn("from", F.col("node")).withColumn("node", F.floor(F.col("node") / MERGE))
            found, width = above.groupBy("bucket", "node").applyInArrow(_merge(k), PAIRS), -(-width // MERGE)
        best, at = materialize(found, f"best{number}"), behind + 1
        if at > (hi or 0):
            break
        floors = queries.select("bucket", "dim", "part", "ids", "norm").groupBy("bucket").cogroup(best.groupBy("bucket"))
        floors = materialize(floors.applyInArrow(_floors(k), FLOORS), f"floors{number}")
        needs = floors.groupBy("bucket", "dim").agg(F.min("need").alias("need"))
        asking, number = queries.join(floors.drop("need"), ["bucket", "dim", "part"]), number + 1
    found = best
    # an id that several query rows share may have a list in several buckets
    found = found.groupBy("query_id", "vec_id").agg(F.coalesce(F.max(F.when(~F.isnan("score"), F.col("score"))), F.lit(float("nan"))).alias("score"))
    ranked = found.select("query_id", F.struct((-F.col("score")).alias("less"), "vec_id").alias("near")).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("near")), 1, k).alias("near"))
    return ranked.select("query_id", F.posexplode("near").alias("at", "near")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), (-F.col("near.less")).alias("score"))
