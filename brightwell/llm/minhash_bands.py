"""Which near copies go: candidates from shared buckets, each pair verified on whole texts.

Radius-2 balls of SimHash (op3's contract) meet few pairs that are 0.8 alike, so buckets are the
bands of MinHash signatures besides SimHash components (simhash_ball). Within a bucket, texts are
compared with its hubs first; the alike pairs among what stays are then found by their rarest
shingles. Pairs are of keys; a text is compared by the sorted hashes of its shingles.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.common import connected_components, materialize, word_parts

WIDTH, SIMILAR = 5, 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8, 0.05 at 0.3.
BANDS, ROWS = 20, 5
#: The texts of a bucket that all its others are compared with at first, twice as many each time after that; and how often, before the rest's pairs are looked for one by one.
HUBS, COMPARISONS = 3, 1
#: Less than any difference between sizes that tells; products of sizes are rounded by less.
EPS = 1e-6
#: Rounds in which the smallest id decides; chains that are longer are settled in an order of hashes.
ROUNDS_BY_ID = 4

_rng = np.random.default_rng(42)
_MULTIPLY = _rng.integers(1 << 31, size=(BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(1 << 32, size=(BANDS * ROWS, 1), dtype=np.uint32)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, width: int = 5) -> set[bytes]:
    """The `width`-word shingles of a lower-cased text; one with fewer words is one shingle."""
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def shared(x: set, y: set) -> float:
    """Jaccard similarity of two sets, not both empty."""
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def word_jaccard(a: bytes, b: bytes, width: int = 5) -> float:
    """Jaccard similarity of the sets of `width`-word shingles; texts with fewer words are one shingle."""
    return shared(shingles(a, width), shingles(b, width))


def grams(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of a text's shingles (see shingles). A text of m bytes needs some 20 m bytes at most, whatever its length."""
    from xxhash import xxh3_64_intdigest

    parts = [np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_parts(text.lower())]
    words = np.concatenate([np.empty(0, np.uint64), *parts])
    span = min(width, len(words))
    found = np.full(max(1, len(words) - span + 1), span, np.uint64)
    for i in range(span):
        found = found * _M1 + words[i : len(words) - span + 1 + i]
    found = (found ^ (found >> np.uint64(32))) * _M2
    return np.unique(found ^ (found >> np.uint64(29)))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash for each band of the least values of a text's grams."""
    from xxhash import xxh64_intdigest

    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for lo in range(0, len(high), 2048):
        least = np.minimum(least, (_MULTIPLY * high[None, lo : lo + 2048] + _ADD).min(axis=1))
    return [xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(least.reshape(BANDS, ROWS))]


def shared_sorted(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct values, not both empty; chunks of the longer one bound the memory."""
    if len(x) < len(y):
        x, y = y, x
    both = 0
    for lo in range(0, len(x), 1 << 20):
        part = x[lo : lo + (1 << 20)]
        other = y[np.searchsorted(y, part[0]) : np.searchsorted(y, part[-1], side="right")]
        if len(other):
            at = np.minimum(np.searchsorted(part, other), len(part) - 1)
            both += int((part[at] == other).sum())
    return both / (len(x) + len(y) - both)


def _alike(batches):
    for b in batches:
        one, other = b.column("one"), b.column("other")
        alike = [shared_sorted(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= SIMILAR for x, y in zip(one, other)]
        yield b.select(["src", "dst"]).filter(pa.array(alike, pa.bool_()))


def digest_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def settle(edges: DataFrame) -> DataFrame:
    """(key) of what goes, of undirected edges whose src is before dst: each has a neighbour that stays, and of two neighbours one goes.

    In the order of the edges, what has no undecided neighbour before it stays and its neighbours
    go. A chain would take as many rounds as it is long where it follows that order, so after
    ROUNDS_BY_ID an order of hashes is taken: it is random, and rounds then grow with the logarithm
    of the edges.
    """
    done, rounds = [], 0
    while not edges.isEmpty():
        free = materialize(edges.select(F.col("src").alias("key")).distinct().join(edges.select(F.col("dst").alias("key")), "key", "left_anti"), "free")
        lost = materialize(edges.join(free.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("dst").alias("key")).distinct(), "lost")
        done.append(lost)
        rounds += 1
        left = edges.join(lost.withColumnRenamed("key", "src"), "src", "left_anti").join(lost.withColumnRenamed("key", "dst"), "dst", "left_anti")
        left = left.select("src", "dst")
        if rounds == ROUNDS_BY_ID:
            low = F.xxhash64("src") <= F.xxhash64("dst")
            left = left.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("dst"))
        edges = materialize(left, "edges")
    gone = edges.select(F.col("src").alias("key"))
    for lost in done:
        gone = gone.unionByName(lost)
    return gone


def _hubs(members: DataFrame, hubs: int, seed: int) -> DataFrame:
    """(bucket, hub, hub_n) of buckets of two texts or more: the smallest text (seed 0), and those of the least seeded hashes."""
    by = [F.min(F.struct(F.xxhash64("text", F.lit(seed + i)).alias("hash"), "text", "n")) for i in range(hubs)]
    if not seed:
        by[0] = F.min(F.struct(F.lit(0).cast("long").alias("hash"), "text", "n"))
    found = members.groupBy("bucket").agg(F.count("*").alias("count"), *(f.alias(f"hub{i}") for i, f in enumerate(by))).where("count > 1")
    both = F.explode(F.array_distinct(F.array(*(F.struct(f"hub{i}.text", f"hub{i}.n") for i in range(hubs))))).alias("hub")
    return found.select("bucket", both).select("bucket", F.col("hub.text").alias("hub"), F.col("hub.n").alias("hub_n"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y)["key"].alias("src"), F.greatest(x, y)["key"].alias("dst")]


def _with_hubs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(src, dst) of texts that share a bucket, one of them a hub there."""
    near = F.least("n", "hub_n") >= F.lit(SIMILAR) * F.greatest("n", "hub_n") - F.lit(EPS)  # else their sizes alone tell that they aren't alike
    met = members.join(hubs, "bucket").where((F.col("hub") != F.col("text")) & near)
    return met.select(*_pair("hub", "text")).distinct()


def _exploded(batches):
    """(family, gram) of (family, grams)."""
    for b in batches:
        counts = pa.compute.binary_length(b.column("grams")).to_numpy() // 8
        grams_ = np.frombuffer(b"".join(b.column("grams").to_pylist()), "<i8")
        at = np.repeat(np.arange(b.num_rows), counts)
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([b.column("family").take(pa.array(at[lo : lo + (1 << 16)])), pa.array(grams_[lo : lo + (1 << 16)])], ["family", "gram"])


def _apart(batches):
    """(key, family, size, gram) of (key, family, grams, core): the grams of a text or its family's core that the other lacks, and null, which all hold; size counts them."""
    for b in batches:
        for i, (own, core) in enumerate(zip(b.column("grams"), b.column("core"))):
            own = np.frombuffer(own.as_buffer(), "<i8")
            found = np.setxor1d(own, core.values.to_numpy(), assume_unique=True) if core.is_valid else own
            for lo in range(0, len(found) + 1, 1 << 16):
                grams_ = pa.array(found[lo : lo + (1 << 16)])
                if lo + (1 << 16) > len(found):
                    grams_ = pa.concat_arrays([grams_, pa.nulls(1, pa.int64())])
                same = pa.array(np.full(len(grams_), i))
                size = pa.array(np.full(len(grams_), len(found) + 1))
                yield pa.RecordBatch.from_arrays([b.column("key").take(same), b.column("family").take(same), size, grams_], ["key", "family", "size", "gram"])


def _families(members: DataFrame) -> DataFrame:
    """(key, family) of the texts of buckets that have two or more: those that share a bucket are of one family."""
    least = members.groupBy("bucket").agg(F.min("text.key").alias("dst"), F.count("*").alias("count")).where("count > 1")
    edges = members.join(materialize(least.select("bucket", "dst"), "firsts"), "bucket").select(F.col("text.key").alias("src"), "dst")
    return materialize(connected_components(edges).select(F.col("node").alias("key"), F.col("root").alias("family")), "families")


def _by_prefix(texts: DataFrame, hashed: DataFrame) -> DataFrame:
    """(src, dst): all pairs of texts (key, text, n and family; one family if it is missing) that are of one family and alike are among them; hashed has their grams.

    Prefix and position filters as PPJoin's (Xiao et al. 2008), but on how texts differ from what their
    family has in common. The core of a family is the grams that more than half of its texts hold (at
    most twice a text's mean count of grams), and each text is taken as what it has beside the core and
    what it lacks of it: two texts differ by as many grams as before, so nothing is lost, whatever the
    core is. In the order of how many texts of the family hold them, what comes before the first one
    that two texts share tells them apart: an eighth of a text's own count of grams at most in the
    smaller one, a quarter in the other. All texts share a last one, for those that hold little else.

    What one text only has meets nothing. Copies of one text with edits of their own meet where they
    lack the same grams, which few of them do, and not in the grams that nearly all of them hold.
    """
    if "family" not in texts.columns:
        texts = texts.withColumn("family", F.lit(0))
    key, family = (f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("key", "family"))
    hashed = hashed.select("key", "grams").join(texts.select("key", "family"), "key")
    held = hashed.select("family", "grams").mapInArrow(_exploded, f"{family}, gram long").groupBy("family", "gram").agg(F.count("*").alias("held")).where("held > 1")
    held = held.join(texts.groupBy("family").agg(F.count("*").alias("texts")), "family")
    core = 2 * F.col("held") > F.col("texts")
    common = materialize(held.select("family", "gram", core.alias("core"), F.when(core, F.col("texts") - F.col("held")).otherwise(F.col("held")).alias("held")), "common")
    cores = materialize(common.where("core").groupBy("family").agg(F.collect_list("gram").alias("core")), "cores")
    apart = hashed.join(cores, "family", "left").select("key", "family", "grams", "core").mapInArrow(_apart, f"{key}, {family}, size long, gram long")
    ranked = materialize(apart, "tokens").join(common.select("family", "gram", "held"), ["family", "gram"], "left").where("held > 1 or gram is null")
    by = Window.partitionBy("key")
    place = F.col("size") - F.count("*").over(by) + F.row_number().over(by.orderBy(F.col("gram").isNull(), "held", "gram"))
    ranked = ranked.join(texts.select("key", "text", "n"), "key").select("family", "text", "n", "size", F.coalesce("gram", F.lit(0)).alias("gram"), place.alias("place"))
    ranked = materialize(ranked.where(F.col("place") <= F.floor(F.lit((1 - SIMILAR) / SIMILAR) * F.col("n") + F.lit(EPS)) + 1), "prefixes")
    first = F.floor(F.lit((1 - SIMILAR) / SIMILAR / 2) * F.col("n") + F.lit(EPS)) + 1
    less = ranked.where(F.col("place") <= first).select("family", "gram", *(F.col(c).alias(f"less_{c}") for c in ("text", "n", "size", "place")))
    ordered = F.struct("less_size", "less_text") < F.struct("size", "text")
    near = F.least("n", "less_n") >= F.lit(SIMILAR) * F.greatest("n", "less_n") - F.lit(EPS)
    most = F.least(F.col("size") - F.col("place"), F.col("less_size") - F.col("less_place")) + 1
    enough = F.col("size") + F.col("less_size") - 2 * most <= F.lit((1 - SIMILAR) / (1 + SIMILAR)) * (F.col("n") + F.col("less_n")) + F.lit(EPS)
    return ranked.join(less, ["family", "gram"]).where(ordered & near & enough).select(*_pair("less_text", "text")).distinct()


def lost_texts(nodes: DataFrame, grams_of: Callable[[DataFrame], DataFrame], comparisons: int = COMPARISONS) -> DataFrame:
    """(key) of the distinct texts that go: nodes are (key, least, n, bands), grams_of gives (key, grams) of a table of keys.

    Every alike pair that shares a bucket is found or has a text that goes for another one: of two
    such texts one goes at least, and what goes has an alike text that stays (settle).

    Buckets of one text only, which are most, fall away first. The texts of each bucket are compared
    with its hubs: HUBS at first, the smallest one and those of the least seeded hashes, then twice as
    many others of what is left, so often as `comparisons` says. So pairs are in proportion to the
    texts, however large a group of copies is. Of what is left, the buckets that have two texts or more
    besides their first hubs hold the rest of the pairs; _by_prefix gives all of these that can be
    alike, in families of texts that buckets connect. It is done again for buckets with texts that a later choice let stay, until there is
    nothing new.
    """
    order = F.struct(F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"), "key")
    shared = nodes.select("key", F.explode(F.array_distinct("bands")).alias("bucket")).withColumn("count", F.count("*").over(Window.partitionBy("bucket"))).where("count > 1")
    members = materialize(shared.select("key", "bucket"), "shared").join(nodes.select("key", order.alias("text"), "n"), "key")
    members, kind = materialize(members.select("text", "n", "bucket"), "members"), nodes.schema["key"].dataType.simpleString()
    gone, edges, known = nodes.where("false").select("key"), None, None

    def left() -> DataFrame:
        return members.join(gone, F.col("text.key") == gone["key"], "left_anti")

    def compared(pairs: DataFrame, hashed: DataFrame | None = None) -> bool:
        """Compares the pairs that weren't yet; whether some are alike, by which gone was chosen again."""
        nonlocal gone, edges, known
        pairs = materialize(pairs if known is None else pairs.join(known, ["src", "dst"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return False
        if hashed is None:
            wanted = pairs.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
            hashed = materialize(grams_of(materialize(wanted, "wanted")), "grams")
        one = pairs.join(hashed.select(F.col("key").alias("src"), F.col("grams").alias("one")), "src")
        two = one.join(hashed.select(F.col("key").alias("dst"), F.col("grams").alias("other")), "dst").select("src", "dst", "one", "other")
        found = materialize(two.mapInArrow(_alike, f"src {kind}, dst {kind}"), "alike")
        known = pairs if known is None else known.unionByName(pairs)
        if found.isEmpty():
            return False
        edges = found if edges is None else edges.unionByName(found)
        gone = materialize(settle(edges), "gone")
        return True

    hubs, seed, first = HUBS, 0, None
    for _ in range(comparisons):
        found = materialize(_hubs(left(), hubs, seed), "hubs")
        first = found.select("bucket", F.col("hub").alias("text")) if first is None else first
        if not compared(_with_hubs(left(), found)):
            break
        hubs, seed = 2 * hubs, seed + hubs
    rest = members if first is None else members.join(first, ["bucket", "text"], "left_anti")  # the first hubs met all texts
    rest, before, families = materialize(rest, "besides"), None, None
    while True:
        now = materialize(rest.join(gone, F.col("text.key") == gone["key"], "left_anti"), "left")
        open_ = now.groupBy("bucket").count().where("count > 1").select("bucket")
        if before is not None:  # pairs of texts that stayed then are known, so a new one has a text that did not
            open_ = open_.join(now.join(before, ["bucket", "text"], "left_anti"), "bucket", "left_semi")
        texts = materialize(now.join(open_, "bucket", "left_semi").select("text.key", "text", "n").distinct(), "open")
        if texts.isEmpty():
            return gone
        families = _families(rest) if families is None else families
        hashed = materialize(grams_of(texts.select("key")), "grams")
        if not compared(_by_prefix(texts.join(families, "key"), hashed), hashed):
            return gone
        before = now
