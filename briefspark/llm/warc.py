"""WARC archives of captures and the external merge of their indexes.

Writing: captures with equal payloads (by SHA-1) become one ``response`` record and
``revisit`` records that refer to it; a record is an HTTP answer, whose payload a revisit
leaves out.  A record ends in two line ends, so Spark's text writer, with these as its line
separator, writes WARC files to any file system that Spark knows, each compressed as a whole.
Payloads are shuffled once, to meet the largest id of their digest (a narrow table); a hot
payload is a skewed join, which Spark splits, and makes small records.  An archive holds
ARCHIVE_RECORDS at most.

Reading: Spark's text reader streams every archive in pieces, cut at the same separator; a task
puts them together again to records by the lengths that their headers give, and holds one record
at a time, however many bytes an archive has.  Payloads are held against their digests.  An archive
yields a run: its captures sorted by (url key, time, id), cut at range borders into slices.  Borders
are percentiles of a sample of SAMPLE full keys per range, so captures of one hot url are
dealt out to several ranges.  The slices of a range, one from each archive,
are merged by a loser tree into the globally ordered capture history.  A slice is one row of
a few binary-free columns; payloads do not move.

Captures need a time; where the table has none, it is BEGIN plus id seconds, the id taken modulo
SPAN (of equal times, the smaller id comes first).

Defined cases: null html is an empty payload, a null url an empty one; a null id is written as
such, sorts first, and is never the response of others; rows of equal payload and equal,
largest id are all responses; payloads shorter than ``min_bytes`` are always responses; line
ends inside urls are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.common import kept, map_batches, partitions, shared_dir, table

BEGIN = "2020-01-01T00:00:00Z"
#: Times of captures without one lie within so many seconds (136 years) from BEGIN.
SPAN = 1 << 32
ARCHIVE_RECORDS = 4096
#: Keys per range, about, in the sample from which range borders are taken.
SAMPLE = 64
RECORD_END = "\r\n\r\n"


# -- writing ------------------------------------------------------------------


def base32_of(sha: Column) -> Column:
    """Upper-case base32 of a digest in 40 hex digits: 5 of these make 4 letters.

    ``sha`` is used 8 times: make it a column first, not the hash expression itself.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for group in range(8):
        number = F.conv(F.substring(sha, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(letters), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def records(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) -> (page_id, bytes, record): one WARC record without its end."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = captures.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha"),
    )
    newest = pages.groupBy("sha").agg(F.max("page_id").alias("newest"))
    marked = pages.join(newest, "sha")
    size = F.length("payload")
    revisit = (F.col("page_id") < F.col("newest")) | (F.col("page_id").isNull() & F.col("newest").isNotNull())
    revisit = revisit & (size >= min_bytes)
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\r\n"))
    time = F.date_format(
        F.timestamp_seconds(F.unix_timestamp(F.lit(BEGIN).cast("timestamp")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", size.cast("string")), F.lit("\r\n")
    ).cast("binary")
    block = F.concat(http, F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <", record_uri(F.col("page_id")), ">"),
        line("WARC-Date: ", time),
        line("WARC-Target-URI: ", uri),
        line("WARC-Payload-Digest: sha1:", base32_of(F.col("sha"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                line("WARC-Refers-To: <", record_uri(F.col("newest")), ">"),
            ),
        ).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.length(block).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")
    return marked.select("page_id", size.alias("bytes"), F.concat(head, block).alias("record"))


def write_archives(captures: DataFrame, folder: str, min_bytes: int = 0, archive_records: int = ARCHIVE_RECORDS) -> None:
    (
        records(captures, min_bytes)
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", archive_records)
        .option("compression", "gzip")
        .text(folder)
    )


# -- reading ------------------------------------------------------------------

HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
ENTRY = "url_key string, time string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: the order of capture indexes."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    path = quote(unquote(parts.path or "/"), safe="/%:@!$&'()*+,;=~-._").lower()
    return f"{labels}{port}){path}" + (f"?{parts.query.lower()}" if parts.query else "")


def _id_of(uri: bytes) -> int | None:
    text = uri.strip(b"<>").rsplit(b":", 1)[-1]
    return None if text == b"null" else int(text)


def read_record(name: str, at: int, record: bytes, end: int, fields: dict[bytes, bytes]) -> tuple:
    """One record as an index entry; its own header, up to ``end``, is in ``fields``."""
    http = record.index(RECORD_END.encode(), end) + 4
    payload = memoryview(record)[http:]
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response":
        length, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"{name}: payload at {at} does not match its digest")
    else:
        length = int(dict(HEADER.findall(record, end, http))[b"Content-Length"])
    url, refers = fields[b"WARC-Target-URI"].decode(), fields.get(b"WARC-Refers-To")
    page_id = _id_of(fields[b"WARC-Record-ID"])
    return url_key(url), fields[b"WARC-Date"].decode(), page_id, url, length, digest, kind, _id_of(refers) if refers else None, name, at


class Archive:
    """The records of one archive out of its pieces, one after the other.

    Where the separator also occurs inside a record, or a payload ends in a part of it, pieces are
    not records: only the lengths in the headers count.
    """

    def __init__(self, name: str) -> None:
        self.name, self.held, self.place, self.need, self.header = name, bytearray(), 0, 0, None
        self.entries: list[tuple] = []

    def add(self, piece: bytes) -> None:
        self.held += piece
        self.held += RECORD_END.encode()
        while len(self.held) > self.need:
            if self.header is None:
                end = self.held.find(RECORD_END.encode()) + 4
                if end < 4:  # the rest of a separator and the start of a header
                    return
                fields = dict(HEADER.findall(bytes(self.held[:end])))
                if not self.held.startswith(b"WARC/1.") or b"Content-Length" not in fields:
                    if not self.held.strip(b"\r\n"):
                        return
                    raise ValueError(f"{self.name}: no WARC record at {self.place}")
                self.header, self.need = (end, fields), end + int(fields[b"Content-Length"]) + 3
            else:
                size = self.need + 1
                self.entries.append(read_record(self.name, self.place, bytes(self.held[: size - 4]), *self.header))
                del self.held[:size]
                self.place, self.need, self.header = self.place + size, 0, None

    def run(self) -> list[tuple]:
        """The captures, sorted."""
        if self.header or self.held.strip(b"\r\n"):
            raise ValueError(f"{self.name}: the record at {self.place} is cut off")
        return sorted(self.entries, key=sort_key)


def sort_key(entry: tuple) -> tuple:
    return entry[0].encode(), entry[1], entry[2] is not None, entry[2] or 0


class LoserTree:
    """Merge k sorted runs: an inner node keeps the loser of its match, so the next entry
    costs one comparison per level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.keys = [self.key(n) for n in range(self.k)]
        self.losers = [-1] * self.k
        for n in range(self.k):
            self.play(n)

    def key(self, n: int) -> tuple:
        head = self.heads[n]
        return (1,) if head is None else (0, sort_key(head), n)

    def play(self, n: int) -> None:
        """Run n meets the losers on its way up; the first to come waits at an empty node."""
        node = (n + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = n
                return
            if self.keys[other] < self.keys[n]:
                self.losers[node], n = n, other
            node //= 2
        self.losers[0] = n

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            winner = self.losers[0]
            if self.heads[winner] is None:
                return
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self.keys[winner] = self.key(winner)
            self.play(winner)


def _names() -> list[str]:
    return [x.split()[0] for x in ENTRY.split(", ")]


def _types() -> list[pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return [kinds[x.split()[1]] for x in ENTRY.split(", ")]


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per capture, each archive's sorted: a run."""

    def entries(archive: Archive) -> pa.RecordBatch:
        columns = list(zip(*archive.run())) or [[]] * len(_names())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _types())], _names())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for path, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = path.rsplit("/", 1)[-1]
                if archive is None or archive.name != name:
                    if archive:
                        yield entries(archive)
                    archive = Archive(name)
                archive.add(piece.as_py())
        if archive:
            yield entries(archive)

    # compressed files are not split, so a task reads all pieces of an archive, in order
    archives = spark.read.option("lineSep", RECORD_END).option("pathGlobFilter", "part-*").text(folder)
    return map_batches(archives.select("_metadata.file_path", F.col("value").cast("binary")), run, ENTRY)


def merged_index(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Runs -> captures in global order: range, place in the range, and the entry.

    Ordered by (url_key, time, page_id): all of range r before all of range r + 1.
    """
    spark = runs.sparkSession
    ranges = ranges or partitions(spark)
    names = _names()

    share = min(1.0, SAMPLE * ranges / max(1, runs.count()))
    keys = [tuple(r) for r in runs.select(*names[:3]).sample(share, seed=1).collect()]
    keys.sort(key=sort_key)
    borders = [sort_key(keys[len(keys) * n // ranges]) for n in range(1, ranges)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run in slices: one row for each range that it reaches."""
        kind = pa.list_(pa.struct(list(zip(names, _types()))))
        for batch in batches:
            slices: dict[tuple, list] = {}
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                place = bisect_right(borders, sort_key(entry)), entry[names.index("archive")]
                slices.setdefault(place, []).append(dict(zip(names, entry)))
            numbers = pa.array([number for number, _ in slices], pa.int32())
            yield pa.record_batch([numbers, pa.array(list(slices.values()), kind)], ["range", "slice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list] | None = None

        def out() -> pa.RecordBatch:
            entries = list(LoserTree(held[1]))
            columns = [[held[0]] * len(entries), range(len(entries)), *zip(*entries)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), *_types()])], ["range", "position", *names])

        for batch in batches:
            for number, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                run = [tuple(e.values()) for e in entries.as_py()]
                if held and held[0] != number:
                    yield out()
                    held = None
                held = held or (number, [])
                held[1].append(run)
        if held:
            yield out()

    slice_type = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in ENTRY.split(", ")))
    slices = map_batches(runs, cut, f"range int, slice array<struct<{slice_type}>>")
    dealt = slices.repartition(ranges, "range").sortWithinPartitions("range")
    return map_batches(dealt, merge, f"range int, position long, {ENTRY}")


def capture_history(captures: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write archives (to a new folder in the shared one by default), read and merge them."""
    spark = captures.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures, folder, min_bytes)
    return merged_index(kept(read_runs(spark, folder)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, {5 * group + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1 AS INTEGER), 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, {_LETTERS} AS payload_digest,
  max(page_id) OVER (PARTITION BY sha) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM d
"""
