"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regex yields a Boolean query over trigrams that any match must contain. The index lists
the documents of each trigram that some query names; postings are intersected for each clause, and
only the documents found are verified with the regex. A rule whose regex needs no trigram is run
over every text.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import columns_of, materialize, scratch, text_of
from brightwell.llm.exact_dedup import PLACE_BITS, at_home


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters or more.

    `scan` is a pattern with the same kept matches that finds fewer failing ones; by default `pattern`.
    """

    kind: str
    pattern: str
    group: int
    least: int
    scan: str = ""


#: Fixed: the base kinds, in the order in which ties are listed. A run that is too short for access
#: or hex holds no other match that is long enough, so there the least length can be part of the scan.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
]

#: A query is an OR of clauses, each a set of trigrams that must all occur; the empty clause asks for nothing.
Query = frozenset
ANYTHING: Query = frozenset([frozenset()])
MOST = 64


def _least(clauses) -> Query:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Query, b: Query) -> Query:
    found = _least({x | y for x, y in product(a, b)})
    return found if len(found) <= MOST else a


def _grams(words: set[str]) -> Query:
    return _least({frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words})


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """(all lower-cased strings that the node matches, if few; a query that holds where it matches)."""
    from re import _constants as c

    if op is c.LITERAL:
        return {chr(arg).lower()}, ANYTHING
    if op is c.AT:
        return {""}, ANYTHING
    if op is c.IN and all(o is c.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(x).lower() for _, x in arg}, ANYTHING
    if op is c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is c.BRANCH:
        sides = [_sequence(x) for x in arg[1]]
        if all(words is not None for words, _ in sides):
            return set().union(*(words for words, _ in sides)), ANYTHING
        return None, _least(set().union(*(_grams(words) if words is not None else query for words, query in sides)))
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        low, high, inner = arg
        words, query = _sequence(inner)
        if (low, high) == (0, 1) and words is not None:
            return words | {""}, ANYTHING
        if low >= 1:
            return None, query if words is None else _grams(words)
    return None, ANYTHING


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    words, query, whole = {""}, ANYTHING, True
    for op, arg in nodes:
        more, asks = _node(op, arg)
        if more is not None and len(words) * len(more) <= MOST:
            words = {a + b for a, b in product(words, more)}
        else:
            query, whole = _both(_both(query, _grams(words)), asks), False
            words = more if more is not None and len(more) <= MOST else {""}
    return (words, ANYTHING) if whole else (None, _both(query, _grams(words)))


def trigram_query(pattern: str) -> Query:
    """The trigrams, lower-cased, that a text must contain for the pattern to match in it."""
    from re import _parser

    words, query = _sequence(_parser.parse(pattern))
    return query if words is None else _grams(words)


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key): the inverted index of the given trigrams; key is a document's. Case is folded."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("key", F.explode(held).alias("gram")).distinct()


def candidates(texts: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, rules): for documents that some query finds, the kinds whose query finds them.

    The postings of each clause are intersected by counting, for each document, how many of its trigrams it has.
    """
    spark = texts.sparkSession
    clauses = [(kind, i, len(clause), gram) for kind, query in sorted(queries.items()) for i, clause in enumerate(sorted(map(sorted, query))) for gram in clause]
    index = materialize(postings(texts, sorted({c[3] for c in clauses})), "postings")
    asked = spark.createDataFrame(clauses, "kind string, clause int, size int, gram string")
    met = index.join(F.broadcast(asked), "gram").groupBy("key", "kind", "clause", "size").count().where("count = size")  # asked: the rules' own trigrams
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable isn't computed anew for each element of an inner array."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


#: Running totals are built in parts of so many elements, as each step of an aggregate copies its state.
PART = 256


def _running(values: Column, add) -> Column:
    """array<int>: values[0], add(values[0], values[1]), ... of an array of integers from 0 on; add is a sum or a maximum.

    Parts have their own totals, to each of which that of the parts before it is added, so the work
    grows with the array's length (up to some millions of elements).
    """

    def steps(part: Column) -> Column:  # 0, then the totals
        return F.aggregate(part, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def whole(parts: Column) -> Column:
        before = steps(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.transform(F.slice(p, 2, PART), lambda x: add(b, x))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda i: steps(F.slice(v, i * PART + 1, F.lit(PART))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(_let(values, cut), whole))


SPAN = "struct<start:int,rule:int,end:int,start_byte:int,end_byte:int>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<SPAN> of the rule's kept matches in the text: offsets in code points and in bytes of UTF-8.

    The parts between matches and the matches themselves give the offsets, by running totals.
    """
    pattern = F.lit(rule.scan or rule.pattern)
    gaps, hits, values = F.split(text, rule.scan or rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def of_match(gap: Column, hit: Column, value: Column) -> Column:
        return F.struct((F.length(gap) + F.length(hit)).alias("chars"), (F.octet_length(gap) + F.octet_length(hit)).alias("bytes"), F.length(hit).alias("hit"), F.octet_length(hit).alias("hit_bytes"), F.length(value).alias("value"))

    # the part behind the last match has none and falls away
    matches = F.filter(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h"), values.alias("v")), lambda x: of_match(x["g"], x["h"], x["v"])), lambda m: m["hit"].isNotNull())

    def placed(m: Column) -> Column:
        ends = _running(F.transform(m, lambda x: x["chars"]), lambda a, x: a + x)
        end_bytes = _running(F.transform(m, lambda x: x["bytes"]), lambda a, x: a + x)
        every = F.transform(F.arrays_zip(m.alias("m"), ends.alias("e"), end_bytes.alias("b")), lambda x: F.struct(x["m"]["value"].alias("value"), _span(x["e"] - x["m"]["hit"], number, x["e"], x["b"] - x["m"]["hit_bytes"], x["b"]).alias("span")))
        return F.transform(F.filter(every, lambda x: x["value"] >= rule.least), lambda x: x["span"])

    return _let(matches, placed)


def _span(start: Column, number: int, end: Column, start_byte: Column, end_byte: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end"), start_byte.alias("start_byte"), end_byte.alias("end_byte"))


def _bits_at_home(found: DataFrame, kinds: list[str]) -> DataFrame:
    """(to_home, bits0, bits1, ...: an array<long> for each kind) of candidates whose key is a place at home: a bit for each place, set where the kind's query finds it."""
    at = F.col("key").bitwiseAND((1 << PLACE_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = found.groupBy(F.shiftright("key", PLACE_BITS).alias("to_home"), F.shiftright(at, 6).cast("int").alias("word"))
    words = words.agg(*(F.bit_or(F.when(F.array_contains("rules", kind), bit).otherwise(F.lit(0).cast("long"))).alias(f"of{n}") for n, kind in enumerate(kinds)))
    homes = words.groupBy("to_home").agg(F.max("word").alias("last"), *(F.map_from_entries(F.collect_list(F.struct("word", f"of{n}"))).alias(f"of{n}") for n in range(len(kinds))))

    def dense(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.col(f"of{n}")[i], F.lit(0).cast("long")))

    return homes.select("to_home", *(dense(n).alias(f"bits{n}") for n in range(len(kinds))))


def _with_spans(rows: DataFrame, rules: list[Rule], text: Column) -> DataFrame:
    """rows (row) with text and with spans, array<SPAN> by start, then rule; text: what it is of row."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: query for kind, query in queries.items() if query != ANYTHING}
    if indexed:
        rows = at_home(rows)
        with scratch(rows.sparkSession) as keep:
            found = materialize(candidates(rows.select(F.col("place").alias("key"), text.alias("text")), indexed), "candidates")
            marks = keep(_bits_at_home(found, sorted(indexed)), "bitmaps", materialize)
        rows = rows.join(marks.hint("shuffle_hash"), rows["home"] == marks["to_home"], "left")
    at, found, rows = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1), [], rows.withColumn("text", text)
    for number, rule in enumerate(rules):
        asked = F.col("text").rlike(rule.scan or rule.pattern)
        if rule.kind in indexed:
            word = F.get(F.col(f"bits{sorted(indexed).index(rule.kind)}"), F.shiftright(at, 6).cast("int"))
            asked = F.coalesce(F.bit_get(word, at.bitwiseAND(63).cast("int")) == 1, F.lit(False)) & asked
        found.append(F.when(asked, spans(F.col("text"), rule, number)).otherwise(F.array().cast(f"array<{SPAN}>")))
    return rows.select("row", "text", F.sort_array(F.concat(*found)).alias("spans"))


def secret_spans(docs: DataFrame, rules: list[Rule] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, and spans, array<SPAN> by start, then rule.

    rule is the number of the rule in the list; offsets are code points (and bytes), the end
    exclusive. A null text is an empty one; a null doc_id stays; rows that repeat a document repeat
    in the result; an empty table gives no rows; other columns are ignored. The work for a text grows
    with its length and its matches. Rows are written once, at their home, read for the index and
    again for verifying; candidates are sent home as bitmaps, so texts are never shuffled.
    """
    rows = text_of(docs, id_col, text_col).select(F.struct("doc_id", "text").alias("row"))
    return _with_spans(rows, rules, F.col("row.text")).select(F.col("row.doc_id").alias("doc_id"), "text", "spans")


def span_count(found: Column, rule: int) -> Column:
    return F.size(F.filter(found, lambda s: s["rule"] == rule)).cast("long")


def span_list(found: Column, rules: list[Rule] = BASE_RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (array<SPAN>, in order) replaced by the mask.

    It is put together from the parts between the runs, cut out of its bytes by their offsets.
    """

    def joined(x: Column) -> Column:
        reach = F.transform(x["ends"], lambda e: e)
        pairs = F.arrays_zip(x["found"].alias("span"), F.concat(F.array(F.lit(0)), reach).alias("before"))
        fresh = F.filter(pairs, lambda p: p["span"].isNotNull() & (p["span"]["start_byte"] >= p["before"]))
        gaps = F.transform(fresh, lambda p: F.substring(x["data"], p["before"] + 1, p["span"]["start_byte"] - p["before"]).cast("string"))
        rest = F.substring(x["data"], F.element_at(x["ends"], -1) + 1, F.octet_length(x["data"])).cast("string")
        return F.array_join(F.concat(gaps, F.array(rest)), mask)

    ends = _running(F.transform(found, lambda s: s["end_byte"]), lambda a, e: F.greatest(a, e))
    whole = F.struct(text.cast("binary").alias("data"), found.alias("found"), ends.alias("ends"))
    return F.when(F.size(found) == 0, text).otherwise(_let(whole, joined))


def mask_secrets(docs: DataFrame, rules: list[Rule] = BASE_RULES) -> DataFrame:
    """docs (all its columns) with the secrets in text masked and n_chars, where there is one, kept true for the rows that change.

    No row is dropped: rows with null ids, null or empty texts and repeated rows stay, an empty table
    gives no rows. Rows travel whole through secret_spans' passes, so nothing is joined back. Long
    texts are masked whole.
    """
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))
    found = _with_spans(rows, rules, F.coalesce("row.text", F.lit(""))).select("row", "spans", masked(F.col("text"), F.col("spans")).alias("new"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    same = F.size("spans") == 0
    return found.select(*(F.when(same, F.col("row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
