"""WARC archives of pages, and their capture index by external merge.

Each record is a gzip member of its archive, so a capture's row in the index (archive, offset and
length of the member) is enough to read that record alone. Each reading task sorts its captures by
URL key and time: a run. Runs are cut by ranges of the key, and each range is merged from its pieces
of runs by a loser tree, which gives capture histories in global order.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwell.llm.common import BATCH_BYTES, binary_array, materialize, shared_dir
from brightwell.llm.exact_dedup import at_home, join_marked

CRLF, END = "\r\n", "\r\n\r\n"
#: zlib's name for the gzip format.
GZIP = 31
#: Compressed bytes after which an archive is closed; a task holds one archive in memory.
ARCHIVE_BYTES = 16 << 20
#: Pages carry no time of capture; page n counts as captured n (modulo 10^9) seconds after this one.
FIRST_CAPTURE = "2024-01-01 00:00:00"
CAPTURE = "urlkey string, capture_time string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, archive string, record_offset long, record_length long, run long, at long"
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
RANGE_ROWS = 100_000


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits make four base32 ones."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classify(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits): both page_id, url, html, size (bytes of the payload), payload_digest and refers_to.

    A revisit's payload is equal, by its SHA-1, to that of refers_to, the smallest page_id of the
    equal payloads of at least least_bytes; its html is left out. Pages are written once, at their
    home, and the places of revisits are sent there, so no html is shuffled. Digests and the first
    pages of repeated ones are tables, so a payload of very many pages is a key that AQE can split.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = at_home(rows.withColumn("size", F.octet_length("html")).withColumn("payload_digest", base32_sha1(F.col("html").cast("binary"))))
    payloads = materialize(rows.select("place", "page_id", "url", "size", "payload_digest").where(F.col("size") >= least_bytes), "payloads")
    first = payloads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    first = materialize(first.drop("n"), "first")
    revisits = materialize(payloads.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "revisits")
    columns = ["page_id", "url", "html", "size", "payload_digest", "refers_to"]
    responses = join_marked(rows, revisits, "left_anti").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(columns), revisits.withColumn("html", F.lit("")).select(columns)


def _record() -> Column:
    """A record with the blank lines after it: WARC headers, then an HTTP response, which for a revisit has no body."""

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    size = F.col("size").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    time = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE).cast("timestamp")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refers = F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn("page_id"), F.lit(f"{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}WARC-Date: "), time,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF), F.when(revisit, refers).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block, F.lit(END),
    )


def _archives(archive_bytes: int):
    """Records to archives: a gzip member each, until an archive has archive_bytes."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for record in b.column("record"):
                held.append(zlib.compress(record.as_py(), wbits=GZIP))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([binary_array([b"".join(held)])], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([binary_array([b"".join(held)])], ["archive"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC 1.1 archives of the pages under path, one gzip member a record; an archive has archive_bytes and its last record at most.

    Spark's text writer makes a file of each archive. It ends what it writes with a separator, which
    is an empty gzip member here.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    responses, revisits = classify(pages, least_bytes)
    records = responses.unionByName(revisits).select(_record().cast("binary").alias("record"))
    archives = records.mapInArrow(_archives(archive_bytes), "archive binary").select(F.col("archive").cast("string").alias("value"))
    nothing = zlib.compress(b"", wbits=GZIP).decode("latin-1")
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", nothing).option("maxRecordsPerFile", 1).text(path)


def members(archive: bytes, step: int = 1 << 16):
    """(offset, length, content) of each gzip member of an archive, one in memory at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        member, parts, end = zlib.decompressobj(GZIP), [], at
        while not member.eof:
            if end == len(view):
                raise ValueError(f"the member at byte {at} is cut short")
            fed = view[end : end + step]
            parts.append(member.decompress(fed))
            end += len(fed)
        end -= len(member.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC headers and the block of a record, which must end where its length says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    parts = [line.decode("utf-8", "replace").partition(":") for line in lines]
    headers = {name: value.removeprefix(" ") for name, _, value in parts}
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('WARC-Record-ID')} doesn't end where its length says")
    return headers, rest[:size]


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, without scheme, port 80 or 443, user and fragment: com,example)/path?query."""
    rest = url.strip().split("#", 1)[0]
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:]
    name, _, port = host.partition(":")
    name = name.removeprefix("www.")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path or "/")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _captures(batches):
    """The captures of a task's archives, sorted: one run for each batch of archives."""
    from pyspark import TaskContext

    run = TaskContext.get().partitionId() << 24
    for b in batches:
        rows = []
        for archive, content in zip(b.column("archive").to_pylist(), b.column("content").to_pylist()):
            for offset, length, record in members(content):
                if not record:  # what ends an archive
                    continue
                headers, block = parse_record(record)
                http, _, body = block.partition(b"\r\n\r\n")
                kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(next(x.split(b": ", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else said
                url = headers["WARC-Target-URI"]
                rows.append((url_key(url), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), url, kind, _page(headers.get("WARC-Refers-To")), size if kind == "revisit" else len(body), digest, digest == said and (kind == "revisit" or size == len(body)), archive, offset, length))
        rows.sort(key=_order)
        names, kinds = zip(*(c.split() for c in CAPTURE.split(", ")))
        columns = [*(list(c) for c in zip(*rows)), [run] * len(rows), list(range(len(rows)))] if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, t in zip(columns, kinds)], list(names))
        run += 1


def _order(row) -> tuple:
    """By URL key as UTF-8, time, and id (a null id last); captures alike in these by their places in the archives."""
    return row[0].encode(), row[1], row[2] is None, row[2] or 0, row[9], row[10]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a new head is
    played against the losers on its way up only."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [next(r, None) for r in self.runs]
        self.n = len(self.runs)
        self.losers = [-1] * max(1, self.n)
        for i in range(self.n):
            self._play(i, fresh=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self.key(x), a) < (self.key(y), b)

    def _play(self, i: int, fresh: bool = False) -> None:
        winner, node = i, (i + self.n) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1 and fresh:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.n:
            best = self.losers[0]
            row = self.heads[best]
            if row is None:
                return
            yield row
            self.heads[best] = next(self.runs[best], None)
            self._play(best)


def _merge_runs(batches):
    """All of a range's pieces of runs, merged."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    runs: dict[int, list[tuple]] = {}
    for row in zip(*(table.column(c).to_pylist() for c in table.column_names)):
        runs.setdefault(row[-2], []).append(row)
    for rows in runs.values():  # a run comes in order, unless its pieces were fetched in another one
        if any(a[-1] > b[-1] for a, b in zip(rows, rows[1:])):
            rows.sort(key=lambda r: r[-1])
    merged = list(LoserTree(runs.values(), _order))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*merged), table.schema.types)], table.schema.names)


def capture_index(spark, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of the archives under path, in order of URL key and time over all partitions; archive is a file's name there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    runs = materialize(files.mapInArrow(_captures, CAPTURE), "runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    return runs.repartitionByRange(ranges, "urlkey", "capture_time", F.col("page_id").asc_nulls_last(), "archive", "record_offset").mapInArrow(_merge_runs, CAPTURE)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as archives, reads them back and returns the index: a row per page.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, capture_time,
    url, intact (digest and length agree with what was read), archive, record_offset, record_length
    (of the record's gzip member). A null html is an empty payload, a null url an empty one; line ends in a URL are percent-encoded. A null page_id stays null and
    refers to the smallest id of its payload, if any; rows that repeat a page are records each. An
    empty table gives no rows; other columns are ignored. A long page is a record of its own archive,
    and so is held whole by a task. Payloads are equal if their SHA-1 is. Hot digests are
    reduced by a partial aggregate and their join is split by AQE; a hot URL is cut by time and id, and
    repeated pages by their places in the archives.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes, archive_bytes)
    return capture_index(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "capture_time", "url", "intact", "archive", "record_offset", "record_length")
