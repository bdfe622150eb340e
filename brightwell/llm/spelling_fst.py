"""Spelling variants: words one edit apart, by finite-state composition.

A vocabulary acceptor, composed with a one-edit transducer and with the acceptor again, accepts the
pairs of words that are one edit apart. Its work is parted by initial states: an edit within a
region of a word leaves what stands before and after it unchanged, so the words that agree there are
one partition, whose acceptor reads their open parts only. Each edit's place lies in one region, so
each pair is accepted once. A partition of very many words is parted again, by halves of its region.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import arrow_schema, materialize, slices, table_of, text_of

RUN = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES, SPARED = 6, 5, 5, 199
#: Characters of a long text that are split at a time; distinct words of a task that are counted before they are sent on.
STEP, HELD_WORDS = 1 << 20, 1 << 17
#: Words of a partition beyond which it is parted again, and words whose acceptors are in memory at a time.
MOST_WORDS, CHUNK_WORDS = 20_000, 20_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A word of n occurrences in the partition `key`: an edit from its place `lo` on and before `hi` (or at the end, if hi is the shorter
#: one's length `short`) leaves its first `lo` and its last short - hi code points as they are.
MEMBER = "key string, short int, lo int, hi int, word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


def runs_of(text: str, least: int) -> Iterator[list[str]]:
    """The runs of letters of a text that have `least` code points or more, in parts of about STEP characters."""
    find, outside, lo = re.compile(f"[{RUN}]{{{least},}}").findall, re.compile(f"[^{RUN}]"), 0
    while lo < len(text):
        end = outside.search(text, lo + STEP)
        hi = end.start() if end else len(text)
        yield find(text, lo, hi)
        lo = hi


def _count_words(least: int, spared: int):
    """Task side: (word, n), where a word may come several times."""

    def run(batches):
        held: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for b in slices(batch, "text"):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for part in runs_of(text, least):
                        for word, n in Counter(w.translate(LOWER) for w in part).items():
                            h = crc32(word.encode(), seed)
                            if h % spared == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                            if len(word) >= least:
                                held[word] += n
                        if len(held) >= HELD_WORDS:
                            yield sent()
                            held.clear()
        if held:
            yield sent()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spared: int = SPARED) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, of least_length code points or more and least_count occurrences.

    Where `spared` divides the CRC-32 of doc_id:run, the run's code point at that number modulo its
    length is left out. A null text has no runs, a null doc_id counts as an empty one.
    """
    counted = text_of(docs, id_col, text_col).mapInArrow(_count_words(least_length, spared), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _regions(words: DataFrame, least: int) -> DataFrame:
    """Rows of MEMBER but the key: each word as the shorter, or equally long, of a pair and as the longer one, with edits in either half."""
    shorts = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    rows = words.select("word", "n", shorts).where(F.col("short") >= least)
    half = F.floor(F.col("short") / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("short").alias("hi")))).alias("half")
    return rows.select("word", "n", "short", halves).select("short", "half.lo", "half.hi", "word", "n")


def _keyed(rows: DataFrame) -> DataFrame:
    fixed = [F.col("short").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string"), F.expr("left(word, lo)"), F.expr("right(word, short - hi)")]
    return rows.select(F.concat_ws("\u0001", *fixed).alias("key"), "short", "lo", "hi", "word", "n")


def partitions(words: DataFrame, least: int = LEAST_LENGTH, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows of MEMBER in partitions of most_words at most, or of a region of one place (which an alphabet's square bounds)."""
    members = _keyed(_regions(words, least))
    while True:
        members = materialize(members, "members")
        hot = members.where("hi - lo > 1").groupBy(F.col("key").alias("hot")).count().where(F.col("count") > most_words)
        hot = materialize(hot.select("hot"), "hot")
        if hot.isEmpty():
            return members
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("half")
        parted = members.join(hot, members["key"] == hot["hot"], "left_semi").select("short", halves, "word", "n").select("short", "half.lo", "half.hi", "word", "n")
        members = members.join(hot, members["key"] == hot["hot"], "left_anti").unionByName(_keyed(parted))


class Acceptor:
    """A minimal acyclic acceptor, built from sorted strings; states are numbers, equal ones are one. Several languages share one store of states."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]  # state 0 accepts the empty string alone: strings added together are equally long
        self.known: dict[tuple, int] = {}
        self.common: dict[tuple[int, int], list[str]] = {}

    def add(self, strings: list[str]) -> int | None:
        """The initial state of a language of ascending, equally long strings; None if there are none."""
        if not strings:
            return None
        path: list[dict[str, int]] = [{} for _ in range(len(strings[0]))]  # the arcs of the states that the last string passes

        def close(upto: int, last: str) -> None:
            for depth in range(len(path) - 1, upto - 1, -1):
                target = self._state(path[depth + 1]) if depth + 1 < len(path) else 0
                path[depth][last[depth]] = target
                if depth + 1 < len(path):
                    path[depth + 1] = {}

        before = strings[0]
        for s in strings[1:]:
            same = next(i for i, (a, b) in enumerate(zip(before, s)) if a != b)
            close(same, before)
            before = s
        close(0, before)
        return self._state(path[0]) if path else 0

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.next)
            self.next.append(arcs)
        return found

    def both(self, a: int, b: int) -> list[str]:
        """The strings that lead to acceptance from either state, which are equally far from it."""
        alone: list[str] = []
        while a and b:  # as long as one of them has one arc, there is one way on
            x, y = self.next[a], self.next[b]
            if len(x) > 1 and len(y) > 1:
                break
            c = next(iter(x if len(x) == 1 else y))
            if c not in x or c not in y:
                return []
            alone.append(c)
            a, b = x[c], y[c]
        first = "".join(alone)
        if not a or not b:
            return [first]
        key = (a, b) if a < b else (b, a)
        found = self.common.get(key)
        if found is None:
            found = []
            for c in x:
                if c in y:
                    found += [c + s for s in self.both(x[c], y[c])]
            self.common[key] = found
        return [first + s for s in found] if first else found

    def replaced(self, state: int) -> Iterator[tuple[str, str]]:
        """The composition with a transducer that replaces one code point: pairs of strings of a language, once each."""
        stack = [("", state)]
        while stack:
            path, q = stack.pop()
            alone: list[str] = []
            while len(self.next[q]) == 1:
                ((c, q),) = self.next[q].items()
                alone.append(c)
            path += "".join(alone)
            arcs = list(self.next[q].items())
            for i, (c, x) in enumerate(arcs):
                for d, y in arcs[:i]:
                    for s in self.both(x, y):
                        yield path + c + s, path + d + s
                stack.append((path + c, x))

    def deleted(self, long: int, short: int, before: str, at_end: bool) -> Iterator[tuple[str, str]]:
        """The composition with one that deletes a code point: (string of `long`, string of `short`).

        Of equal neighbours the first is deleted, also where the code point `before` is one. at_end:
        whether the last of a string may be.
        """
        stack = [([""], long, short, before)]
        while stack:
            path, q, r, last = stack.pop()
            while True:
                ways = []
                for c, x in self.next[q].items():
                    if c != last and (r or at_end):
                        for s in self.both(x, r):
                            first = "".join(path)
                            yield first + c + s, first + s
                    if c in self.next[r]:
                        ways.append((c, x, self.next[r][c]))
                if len(ways) != 1:
                    break
                ((last, q, r),) = ways
                path.append(last)
            first = "".join(path)
            stack += [([first, c], x, y, c) for c, x, y in ways]


def near_pairs(acceptor: Acceptor, short: int, lo: int, hi: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """The pairs of a partition's words that are one edit apart, the edit within its region; each once."""
    parts: list[list[str]] = [[], []]
    for w in words:
        parts[len(w) - short].append(w[lo : len(w) - short + hi])
    first, rest = words[0][:lo], words[0][len(words[0]) - short + hi :]
    equal, longer = acceptor.add(sorted(parts[0])), acceptor.add(sorted(parts[1]))
    if equal is not None:
        pairs = [acceptor.replaced(equal)]
        if longer is not None:
            pairs.append(acceptor.deleted(longer, equal, first[-1:], hi == short))
        for found in pairs:
            for x, y in found:
                yield first + x + rest, first + y + rest


def _compose(as_pairs: bool):
    """Task side: partitions, one after another, to (word, other) or to what a partition knows of each word (NEAR)."""
    schema = arrow_schema("word string, other string" if as_pairs else NEAR)

    def partition(acceptor: Acceptor, short: int, lo: int, hi: int, n: dict[str, int]):
        pairs = near_pairs(acceptor, short, lo, hi, list(n))
        if as_pairs:
            yield from pairs
            return
        count: Counter = Counter()
        best: dict[str, tuple[int, str]] = {}
        for pair in pairs:
            for x, y in (pair, pair[::-1]):
                count[x] += 1
                held, other = best.get(x), (-n[y], y)
                if held is None or other < held:
                    best[x] = other
        yield from ((w, c, -best[w][0], best[w][1]) for w, c in count.items())

    def run(batches):
        acceptor, held, out = Acceptor(), 0, []
        now, where, words = None, None, {}
        for b in batches:
            for key, *place, word, n in zip(*(b.column(c).to_pylist() for c in ("key", "short", "lo", "hi", "word", "n"))):
                if key != now:
                    if len(words) > 1:
                        for row in partition(acceptor, *where, words):
                            out.append(row)
                            if len(out) >= 10_000:
                                yield table_of(out, schema)
                                out = []
                        held += len(words)
                        if held >= CHUNK_WORDS:
                            acceptor, held = Acceptor(), 0
                    now, where, words = key, place, {}
                words[word] = n
        if len(words) > 1:
            out += partition(acceptor, *where, words)
        if out:
            yield table_of(out, schema)

    return run


def _composed(words: DataFrame, as_pairs: bool, least: int, most_words: int) -> DataFrame:
    members = partitions(words, least, most_words)
    count = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(count, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compose(as_pairs), "word string, other string" if as_pairs else NEAR)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, other): each pair of words (a column of distinct ones, with counts n) one inserted, deleted or replaced code point apart, once."""
    return _composed(words, True, least_length, most_words)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last; steps double each round. Each form has `times` its word's count or more, so chains end."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = steps.join(further, steps["root"] == further["_word"], "left")
        steps = materialize(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, spared: int = SPARED, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per word (count_words): word, n, n_near, form, form_n, root.

    n_near counts the words one edit apart. A word's form is the one of these with the largest n
    (ties: the smallest in code-point order) if that is `times` its own or more, else null; root is
    the last of the forms from it on, itself if it has none. Null and empty texts have no words;
    repeated rows count again; an empty table gives no rows; other columns are ignored. Long texts
    are split in parts.

    Texts are read once; a task sends each word's count, of so many words at a time. What is shuffled
    after that are words: four rows each, and more only of partitions beyond most_words; a partition
    reports each word's count and best, not its pairs.
    """
    if times <= 1:
        raise ValueError("times must be above 1: else forms could go round in circles")
    words = materialize(count_words(docs, id_col, text_col, least_length, least_count, spared), "words")
    near = _composed(words, False, least_length, most_words)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    near = near.groupBy(F.col("word").alias("near_word")).agg(F.sum("n_near").alias("n_near"), best)
    rows = words.join(near, words["word"] == near["near_word"], "left")
    is_form = -F.col("best.less") >= F.lit(times) * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "variants")
    roots = _roots(rows.where("form is not null"))
    found = rows.join(roots.withColumnRenamed("word", "_word"), rows["word"] == F.col("_word"), "left")
    return found.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
