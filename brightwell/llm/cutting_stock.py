"""Packing of documents into sequences as a cutting-stock problem, solved by column generation.

Tasks tokenize documents. Full pieces are sequences of their own; what is left of each document
counts in a histogram of lengths, whose size the capacity bounds. A linear program over patterns
(which lengths, and how many of each, share a sequence) covers the histogram. Its columns are
generated: a knapsack by dynamic programming over the dual prices finds patterns worth more than
they cost; so are columns that cut a length in two. Patterns are rounded down, what remains is
packed by patterns of its own, and the documents, ranked within their length, take the patterns'
places by their rank.
"""
from __future__ import annotations

import json
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.bpe import ranked
from brightwell.llm.common import arrow_schema, materialize, slices, text_of
from brightwell.llm.residual_packing import cut, encoder_of

#: Documents are cut at multiples of so many tokens from the start of their rest; the CRC-32 up to each of these is kept.
GRID = 64
#: What a cut costs, in tokens of padding; the objective's distance from the tokens themselves that is good enough; simplex steps at most.
CUT_COST, NEAR_ENOUGH, MOST_STEPS = 1.0, 5e-4, 3_000
#: A piece: the task that cut it, its number among the task's pieces of that length, and the CRC-32 of what is before each GRID-th token.
PIECES = "doc_id long, task long, at long, start long, length int, doc_tokens long, crc long, marks binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass
class Plan:
    """Patterns ({length: how often}, sequences of it) and cuts (length, head, pieces so cut) that use up a histogram."""

    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    cuts: list[tuple[int, int, int]] = field(default_factory=list)


class Master:
    """The linear program: min cost x, columns x = counts, by the revised simplex method with an explicit inverse."""

    def __init__(self, lengths: list[int], counts: np.ndarray, capacity: int):
        self.lengths, self.capacity, self.n = np.array(lengths), capacity, len(lengths)
        self.row = {length: i for i, length in enumerate(lengths)}
        self.want = counts + 1e-4 * (1 + np.arange(self.n) % 97) / 97  # so that steps rarely are of length 0
        self.columns = [({i: capacity // length}, float(capacity)) for i, length in enumerate(lengths)]
        self._start(counts)

    def _start(self, counts: np.ndarray) -> None:
        """A first basis from first fit decreasing: each pattern uses up one more length, so the matrix is triangular."""
        left = dict(zip(range(self.n), self.want.tolist()))
        while left:
            room, pattern = self.capacity, Counter()
            for i in sorted(left, reverse=True):
                fits = min(room // int(self.lengths[i]), max(1, int(left[i])))
                if fits:
                    pattern[i] += fits
                    room -= fits * int(self.lengths[i])
                    if room < self.lengths[0]:
                        break
            times = min(left[i] / a for i, a in pattern.items())
            spent = min(pattern, key=lambda i: left[i] / pattern[i])
            for i, a in pattern.items():
                left[i] -= times * a
            del left[spent]
            self.columns[spent] = (dict(pattern), float(self.capacity))
        self.basis = list(self.columns)
        self._invert()

    def _invert(self) -> None:
        matrix = np.zeros((self.n, self.n))
        for j, (column, _) in enumerate(self.basis):
            for i, a in column.items():
                matrix[i, j] = a
        self.inverse = np.linalg.inv(matrix)
        self.x = self.inverse @ self.want
        self.prices = np.array([c for _, c in self.basis]) @ self.inverse

    def objective(self) -> float:
        return float(sum(c * x for (_, c), x in zip(self.basis, self.x)))

    def saves(self, column: dict[int, int], cost: float) -> float:
        """How much the objective falls for each unit of a column."""
        return sum(self.prices[i] * a for i, a in column.items()) - cost

    def enter(self, column: dict[int, int], cost: float) -> bool:
        """Takes a column into the basis, if that saves anything now."""
        gain = self.saves(column, cost)
        if gain <= 1e-7 * self.capacity:
            return False
        ways = self.inverse[:, list(column)] @ np.array(list(column.values()), float)
        ratio = np.where(ways > 1e-9, np.maximum(self.x, 0) / np.where(ways > 1e-9, ways, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            return False
        row = self.inverse[r] / ways[r]
        self.x -= ratio[r] * ways
        self.x[r] = ratio[r]
        ways[r] = 0
        changed = np.flatnonzero(np.abs(ways) > 1e-12)
        self.inverse[changed] -= np.outer(ways[changed], row)
        self.inverse[r] = row
        self.prices -= gain * row
        self.basis[r] = (column, cost)
        return True


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): the largest price of a pattern of each total up to capacity, and the index of a length in it (-1: as of one less)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for total in range(1, capacity + 1):
        fits = np.searchsorted(lengths, total, side="right")
        best[total] = best[total - 1]
        if fits:
            worth = best[total - lengths[:fits]] + prices[:fits]
            i = int(np.argmax(worth))
            if worth[i] > best[total]:
                best[total], last[total] = worth[i], i
    return best, last


def _pattern(lengths: list[int], last: list[int], lower: list[int], total: int) -> Counter:
    """Indices of the lengths of the best pattern up to `total`; lower: for each total the largest one up to it that a length ends."""
    found: Counter = Counter()
    while (total := lower[total]) > 0:
        found[last[total]] += 1
        total -= lengths[last[total]]
    return found


def generate(histogram: dict[int, int], capacity: int, grid: int = GRID, most_steps: int = MOST_STEPS) -> tuple[list[tuple[dict[int, int], float]], list[tuple[int, int, float]]]:
    """Patterns and cuts of the linear program with how often each is used, in fractions."""
    heads = [h for h in range(grid, capacity, grid)]
    present = sorted(x for x, n in histogram.items() if n)
    lengths = sorted({*present, *(h for h in heads if h < present[-1]), *(x - h for x in present for h in heads if h < x)})
    master = Master(lengths, np.array([histogram.get(x, 0) for x in lengths], float), capacity)
    tokens, steps = sum(x * n for x, n in histogram.items()), 0
    ways = [(i, master.row[h], master.row[x - h]) for i, x in enumerate(lengths) for h in heads if h < x and h in master.row and x - h in master.row]
    whole, head, tail = (np.array(c, np.int64) for c in zip(*ways)) if ways else [np.empty(0, np.int64)] * 3
    while steps < most_steps and master.objective() > tokens * (1 + NEAR_ENOUGH):
        best, last = knapsack(master.lengths, master.prices, capacity)
        entered, ends = 0, last.tolist()
        lower = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0)).tolist()
        worth = best[capacity - master.lengths] + master.prices  # of the best pattern with each length
        seen = set()
        for i in np.argsort(-worth, kind="stable")[:256].tolist():
            if worth[i] <= capacity * (1 + 1e-6):
                break
            column = _pattern(lengths, ends, lower, capacity - lengths[i])
            column[i] += 1
            key = tuple(sorted(column.items()))
            if key not in seen:
                seen.add(key)
                entered += master.enter(dict(column), float(capacity))
        saved = master.prices[whole] - master.prices[head] - master.prices[tail] - CUT_COST
        for j in np.argsort(-saved, kind="stable")[:128].tolist():
            if saved[j] <= 1e-3:
                break
            column = Counter({int(whole[j]): 1})
            column.subtract([int(head[j]), int(tail[j])])
            entered += master.enter(dict(column), CUT_COST)
        if not entered:
            break
        steps += entered
        if steps // 300 > (steps - entered) // 300:
            master._invert()
    master._invert()
    patterns, cuts = [], []
    for (column, _), x in zip(master.basis, master.x):
        if x <= 1e-6:
            continue
        if min(column.values()) > 0:
            patterns.append(({lengths[i]: a for i, a in column.items()}, float(x)))
        else:
            parts = [lengths[i] for i, a in column.items() for _ in range(-a)]
            length = next(lengths[i] for i, a in column.items() if a > 0)
            cuts.append((length, next(p for p in parts if p % grid == 0), float(x)))
    return patterns, cuts


def _fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest length that is left with those that fill its sequence best."""
    first = max(left)
    room = capacity - first
    reached, steps = 1, []  # bit s: a total of s can be made
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        most = min(left[length] - (length == first), room // length)
        step = 1
        while most > 0:
            take = min(step, most)
            steps.append((reached, length, take))
            reached |= reached << (length * take) & full
            most, step = most - take, step * 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    found: Counter = Counter({first: 1})
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            found[length] += take
            total -= length * take
    return dict(found)


def plan(histogram: dict[int, int], capacity: int, grid: int = GRID, most_steps: int = MOST_STEPS) -> Plan:
    """Patterns and cuts, in whole numbers, that use up the histogram exactly."""
    left = Counter({x: n for x, n in histogram.items() if n})
    done = Plan()
    if not left:
        return done
    patterns, cuts = generate(dict(left), capacity, grid, most_steps)
    for length, head, x in sorted(cuts, reverse=True):
        n = min(int(x + 1e-6), left[length])
        if n:
            done.cuts.append((length, head, n))
            left[length] -= n
            left[head] += n
            left[length - head] += n
    for pattern, x in patterns:
        n = min([int(x + 1e-6), *(left[length] // a for length, a in pattern.items())])
        if n:
            done.patterns.append((pattern, n))
            for length, a in pattern.items():
                left[length] -= n * a
    left = Counter({x: n for x, n in left.items() if n})
    while left:
        pattern = _fullest(left, capacity)
        gap = capacity - sum(x * a for x, a in pattern.items())
        n = min(left[x] // a for x, a in pattern.items())
        if gap:
            n = 1
            rest = left - Counter(pattern)
            for part in (gap // grid * grid, gap % grid):  # a head, then a tail, of others
                whole = max((x for x in rest if x > part and (part % grid == 0 or x % grid == part)), default=0) if part else 0
                if whole:
                    other = whole - part
                    done.cuts.append((whole, part if part % grid == 0 else other, 1))
                    left.update([part, other])
                    left[whole] -= 1
                    pattern[part] = pattern.get(part, 0) + 1
                    rest = left - Counter(pattern)
        done.patterns.append((pattern, n))
        left = left - Counter({x: n * a for x, a in pattern.items()})
    return done


class Places:
    """Where the pieces of each length go by their rank: to a pattern's sequence and offset, or to a cut, whose parts are ranked after the pieces of their lengths.

    Ranks of a length are parted into intervals, the rows of `columns`; `find_places` looks one up by binary search.
    """

    def __init__(self, done: Plan, histogram: dict[int, int]):
        used, supply, rows, sequence = Counter(), Counter(histogram), [], 0
        for length, head, n in done.cuts:
            rows.append((length, used[length], -1, 0, 0, head, supply[head], supply[length - head] + (n if 2 * head == length else 0)))
            used[length] += n
            supply[head] += n
            supply[length - head] += n
        for pattern, n in done.patterns:
            at = 0
            for length, a in sorted(pattern.items(), reverse=True):
                rows.append((length, used[length], a, sequence, at, 0, 0, 0))
                used[length] += n * a
                at += length * a
            sequence += n
        if +used != +supply:
            raise RuntimeError("the plan doesn't use up the histogram")
        self.columns = np.array(sorted(rows), np.int64).reshape(-1, 8).T


def find_places(columns: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, start in it, length, sequence, offset) of the parts of pieces of these lengths and ranks."""
    of_length, first, copies, sequence, at, heads, head_rank, tail_rank = columns
    keys = (of_length << 44) + first
    piece, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(piece):
        i = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        k, whole = rank - first[i], copies[i] > 0
        j, n = i[whole], copies[i[whole]]
        out.append((piece[whole], start[whole], length[whole], sequence[j] + k[whole] // n, at[j] + k[whole] % n * length[whole]))
        j, k, head = i[~whole], k[~whole], heads[i[~whole]]
        piece, start, length = np.tile(piece[~whole], 2), np.concatenate((start[~whole], start[~whole] + head)), np.concatenate((head, length[~whole] - head))
        rank = np.concatenate((head_rank[j] + k, tail_rank[j] + k))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 5


def crc_between(upto: int, before: int, tokens: int) -> int:
    """The CRC-32 of the last `tokens` ids of a run, from those of the run and of what is before them."""
    zeros = bytes(4 * tokens)
    return upto ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def _pieces(shared, capacity: int, end_id: int, grid: int):
    """Task side: the rows of PIECES."""
    schema = arrow_schema(PIECES)

    def run(batches):
        from pyspark import TaskContext

        encode, end, task = encoder_of(*shared.value), np.array([end_id], "<u4"), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            for b in slices(batch, "text"):
                columns: list[list] = [[] for _ in schema.names]
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = np.concatenate((encode(text), end))
                    for start, length in cut(len(ids), capacity):
                        data, marks = memoryview(ids[start : start + length].tobytes()), None
                        if length < capacity:
                            sums = [0]
                            for lo in range(0, length, grid):
                                sums.append(zlib.crc32(data[4 * lo : 4 * (lo + grid)], sums[-1]))
                            crc, marks = sums[-1], np.array(sums[:-1], "<u4").tobytes()
                        else:
                            crc = zlib.crc32(data)
                        for column, value in zip(columns, (doc_id, task, seen[length], start, length, len(ids), crc, marks)):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _place(shared, grid: int):
    """Task side: pieces with their rank to rows of PLACED."""
    schema = arrow_schema(PLACED)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rank, length, start, crc = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "length", "start", "crc"))
            piece, at, size, sequence, offset = find_places(shared.value, length, rank)
            found, marks = crc[piece], b.column("marks")
            for i in np.flatnonzero(size < length[piece]).tolist():
                p, lo, hi = int(piece[i]), int(at[i]), int(at[i] + size[i])
                sums = np.append(np.frombuffer(marks[p].as_py(), "<u4"), crc[p])
                found[i] = crc_between(int(sums[-(-hi // grid)]), int(sums[lo // grid]), hi - lo)
            taken = pa.array(piece)
            columns = [b.column("doc_id").take(taken), pa.array(start[piece] + at), pa.array(size), pa.array(found), b.column("doc_tokens").take(taken), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _solve(capacity: int, grid: int, most_steps: int):
    """Task side: the rows of the histogram (length, n), in one task, to its plan and its counts, as JSON."""

    def run(batches):
        histogram: dict[int, int] = {}
        for b in batches:
            histogram.update(zip(b.column("length").to_pylist(), b.column("n").to_pylist()))
        if histogram:
            done = plan(histogram, capacity, grid, most_steps)
            found = {"patterns": [(list(pattern.items()), n) for pattern, n in done.patterns], "cuts": done.cuts, "histogram": list(histogram.items())}
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], ["plan"])

    return run


def pack(docs: DataFrame, vocab: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", grid: int = GRID, most_steps: int = MOST_STEPS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id (a null or empty text: end_id alone), so every row, repeated
    ones too, has a piece; a null doc_id stays. Longer documents than the capacity are parted into a
    rest and full pieces; rests are cut again where the linear program says so. Texts of any length
    and content are encoded whole. An empty table gives no rows; other columns are ignored.

    Only pieces (some 100 bytes each) may be shuffled, to meet the ranks of their task's first ones
    by length: the pairs of task and length are counted, so a length that very many documents have is
    no hot key. The histogram has at most `capacity` lengths whatever the input, so the program is
    one task's; its plan, of some thousand patterns, is broadcast.
    """
    texts, spark = text_of(docs, id_col, text_col), docs.sparkSession
    shared = spark.sparkContext.broadcast((ranked(vocab), vocab))
    pieces = materialize(texts.mapInArrow(_pieces(shared, capacity, end_id, grid), PIECES), "pieces")
    rests = pieces.where(F.col("length") < capacity)
    counted = materialize(rests.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = counted.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1)
    solved = histogram.mapInArrow(_solve(capacity, grid, most_steps), "plan string").first()
    found = json.loads(solved["plan"]) if solved else {"patterns": [], "cuts": [], "histogram": []}
    done = Plan([(dict(pattern), n) for pattern, n in found["patterns"]], found["cuts"])
    places = spark.sparkContext.broadcast(Places(done, dict(found["histogram"])).columns)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = materialize(counted.select("task", "length", F.coalesce(before, F.lit(0)).alias("first")), "firsts")
    ranked_rests = rests.join(firsts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("at"))
    found = ranked_rests.mapInArrow(_place(places, grid), PLACED)
    number = F.lit(1 << 62) + F.shiftleft("task", 36) + F.col("at")
    full = pieces.where(F.col("length") == capacity).select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return found.unionByName(full)
