"""Exact repeats of word sequences, found by fixed-block anchors.

A window of WINDOW words is a repeat if the same words also start earlier: in a document of
a smaller doc_id, or earlier in a document of the same one.  All words that repeats cover go.

1. Anchors.  Every document is cut into blocks of BLOCK words side by side; their hashes are
   the index.  Every rolling window of BLOCK words probes it.  As WINDOW >= 2 * BLOCK - 1, each
   window holds a whole block of its document, and if the window is a repeat or has one, the
   same words are a rolling window elsewhere.  So the anchors hit by another place than
   their own mark all that can be repeats.
2. Extension.  Around each hit anchor, all windows that hold it get a hash of 128 bits, and the
   first place of each hash is its original; the other places are repeats.  Their union is the
   maximal exact repeats.
3. Documents drop the words that their repeats cover.

Shuffles.  Tasks take documents in chunks and send, to each bucket of hashes, one row per
chunk: probes need no place, so they are distinct, sorted and stored as gaps (2 to 3 bytes
each); an anchor that its chunk itself repeats is a hit at once and is not sent, nor are
windows that are not the first of their chunk.  So a passage that is in a third of all
documents is one entry per chunk and bucket.  Probe hashes are cut to 32 bits within a
bucket: a chance hit costs an extension that finds nothing.  Windows are told apart by 96 bits.
Answers go back as one row per bucket and range of documents and are merged to one row per
document.  The texts are dealt out by document once; both steps that need them read the same
exchange.

Defined cases: null text has no words; rows of one doc_id are parts of one document that are
ordered by start, and exact copies of a row do not repeat each other; a null doc_id comes before
all others; documents shorter than a window keep all words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefspark.llm.common import labels, map_batches, partitions, table

WINDOW, BLOCK = 20, 10
CHUNK_WORDS = 3 << 19
#: Different words whose hashes a worker remembers.
WORDS = 1 << 18
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bits of a probe's hash within its bucket.  Buckets hold some 10^6 probes at any size of input.
KEPT_BITS = 32
FIRST_ID = -(1 << 63)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: splits at ASCII white space only


def rolling(hashes: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Polynomial hash of every window of ``size`` hashes, by joining windows of powers of two."""
    out, done = None, 0
    part, length = hashes, 1
    while True:
        if size & length:
            if out is None:
                out, done = part, length
            else:
                ends = max(0, len(hashes) - done - length + 1)
                out = out[:ends] * np.uint64(pow(factor, length, 1 << 64)) + part[done : done + ends]
                done += length
        if done == size:
            return out[: max(0, len(hashes) - size + 1)]
        ends = max(0, len(hashes) - 2 * length + 1)
        part = part[:ends] * np.uint64(pow(factor, length, 1 << 64)) + part[length : length + ends]
        length *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def gaps(values: np.ndarray) -> bytes:
    """Sorted numbers of KEPT_BITS bits as gaps, byte planes apart (the high ones compress)."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].T).tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(KEPT_BITS // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : KEPT_BITS // 8] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``size`` words: (the row's other columns .., hashes of its words).

    The words themselves, several times as large, are held for one row at a time.
    """
    hashes = WordHashes()
    held, total = [], 0
    for batch in batches:
        for *row, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = hashes.of(words_of(text))
            held.append((*row, words))
            total += len(words)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _bounds(values: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(values, np.arange(n + 1))


def _by_document(at: np.ndarray, uid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``at`` dealt out to n buckets by document: what is decided already must not
    follow its hash, or a passage of many documents makes one heavy bucket."""
    to = uid[at].view(np.uint64) % np.uint64(n)
    order = np.argsort(to, kind="stable")
    return at[order], _bounds(to[order], n)


# -- 1: anchors ---------------------------------------------------------------

PROBES = "bucket int, once binary, often binary, anchors binary, owners binary, places binary, local_owners binary, local_places binary"
HITS = "uid long, places binary"


def probe_rows(documents: DataFrame, block: int, buckets: list[int], chunk_words: int) -> DataFrame:
    """(uid, text) -> per chunk and bucket: probes, anchors to look up, and hits found here."""
    n = len(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, chunk_words):
            uids = np.array([uid for uid, _ in rows], np.int64)
            found = [rolling(words, block, FACTORS[0]) if len(words) >= block else np.empty(0, np.uint64) for _, words in rows]
            rows.clear()
            size = np.array([len(h) for h in found])
            h = mixed(np.concatenate(found))
            del found
            owner = np.repeat(uids, size)
            start = (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            bucket = (h & np.uint64((1 << 24) - 1)) % np.uint64(n)
            h = bucket << np.uint64(KEPT_BITS) | h >> np.uint64(64 - KEPT_BITS)
            order = np.argsort(h)
            h, owner, start = h[order], owner[order], start[order]
            bucket, kept = h >> np.uint64(KEPT_BITS), h & np.uint64((1 << KEPT_BITS) - 1)
            new = np.ones(len(kept), bool)
            new[1:] = h[1:] != h[:-1]
            del h, order
            firsts = np.flatnonzero(new)
            count = np.diff(np.append(firsts, len(kept)))
            often = np.repeat(count > 1, count)
            anchor = start % block == 0
            local, sent = anchor & often, anchor & ~often
            once_cut, often_cut, sent_cut = (
                (at := np.flatnonzero(mask), _bounds(bucket[at], n)) for mask in (new & ~often, new & often, sent)
            )
            local_cut = _by_document(np.flatnonzero(local), owner, n)

            def part(cut, b, values):
                at, ends = cut
                return values[at[ends[b] : ends[b + 1]]]

            columns: list[list] = [[] for _ in range(8)]
            for b in range(n):
                row = (
                    buckets[b], gaps(part(once_cut, b, kept)), gaps(part(often_cut, b, kept)),
                    gaps(part(sent_cut, b, kept)), part(sent_cut, b, owner).tobytes(), part(sent_cut, b, start).tobytes(),
                    part(local_cut, b, owner).tobytes(), part(local_cut, b, start).tobytes(),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            names = [x.split()[0] for x in PROBES.split(", ")]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    return map_batches(documents.select("uid", "text"), run, PROBES)


ANSWERS = "bucket int, uids binary, counts binary, places binary"


def answers(uid: np.ndarray, place: np.ndarray, buckets: list[int]) -> pa.RecordBatch:
    """Places of documents, one row for each range of documents that has any."""
    to = uid.view(np.uint64) % np.uint64(len(buckets))
    order = np.lexsort((uid, to))
    uid, place, to = uid[order], place[order], to[order]
    ends = _bounds(to, len(buckets))
    columns: list[list] = [[] for _ in range(4)]
    for b in range(len(buckets)):
        own = uid[ends[b] : ends[b + 1]]
        if len(own):
            uids, counts = np.unique(own, return_counts=True)
            row = buckets[b], uids.tobytes(), counts.astype("<i4").tobytes(), place[ends[b] : ends[b + 1]].astype("<i4").tobytes()
            for column, value in zip(columns, row):
                column.append(value)
    return pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "uids", "counts", "places"])


def merged(rows: DataFrame, parts: int, runs: bool) -> DataFrame:
    """ANSWERS -> (uid, places), one row per document: places in order, or with ``runs``
    the first place and the length of each run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, places = [], []
        for batch in batches:
            for uid, count, place in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3))):
                uids.append(np.repeat(np.frombuffer(uid, np.int64), np.frombuffer(count, "<i4")))
                places.append(np.frombuffer(place, "<i4"))
        if not uids:
            return
        uid, place = np.concatenate(uids), np.concatenate(places)
        order = np.lexsort((place, uid))
        uid, place = uid[order], place[order]
        new = np.ones(len(uid), bool)
        new[1:] = uid[1:] != uid[:-1]
        if runs:
            first = new.copy()
            first[1:] |= place[1:] > place[:-1] + 1
            at = np.flatnonzero(first)
            last = np.append(at[1:], len(place)) - 1
            uid, new = uid[at], new[at]
            place = np.stack([place[at], place[last] - place[at] + 1], axis=1).astype("<i4")
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(uid))
        for part in range(0, len(begin), 4096):
            some = slice(part, part + 4096)
            lists = [place[a:b].tobytes() for a, b in zip(begin[some], end[some])]
            yield pa.record_batch([pa.array(uid[begin[some]]), pa.array(lists, pa.binary())], ["uid", "places"])

    return map_batches(rows.repartition(parts, "bucket"), run, HITS)


def hit_anchors(probes: DataFrame, parts: int, buckets: list[int]) -> DataFrame:
    """-> ANSWERS: starts of the blocks that another place repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        for batch in batches:
            for bucket, once, often, anchors, owners, places, *local in zip(*(c.to_pylist() for c in batch.columns)):
                lists = held.setdefault(bucket, [[] for _ in range(7)])
                own = (
                    from_gaps(once), from_gaps(often), from_gaps(anchors), np.frombuffer(owners, np.int64), np.frombuffer(places, np.int32),
                    np.frombuffer(local[0], np.int64), np.frombuffer(local[1], np.int32),
                )
                for kept, value in zip(lists, own):
                    kept.append(value)
        for bucket in list(held):
            once, often, anchors, owners, places, local_owners, local_places = map(np.concatenate, held.pop(bucket))
            every = np.concatenate([once, often, often])
            every.sort()
            repeated = every[1:][every[1:] == every[:-1]]
            hit = np.isin(anchors, repeated)
            yield answers(np.concatenate([owners[hit], local_owners]), np.concatenate([places[hit], local_places]), buckets)

    return map_batches(probes.repartition(parts, "bucket"), run, ANSWERS)


# -- 2: extension -------------------------------------------------------------

SPANS = (
    "bucket int, one binary, two binary, docs binary, starts binary, keys binary, uids binary, local_uids binary, local_starts binary"
)


def around(places: np.ndarray, n_words: int, block: int, window: int) -> np.ndarray:
    """Starts of the windows that hold a block at one of the places."""
    steps = np.arange(block - window, 1)
    starts = np.unique((places[:, None] + steps[None, :]).ravel())
    return starts[(starts >= 0) & (starts <= n_words - window)]


def window_rows(marked: DataFrame, block: int, window: int, buckets: list[int], chunk_words: int) -> DataFrame:
    """(k, uid, hits, text) -> per chunk and bucket: the first place of each window's hash
    in the chunk, and the later places, which are repeats already."""
    n = len(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, chunk_words):
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            for k, uid, hits, h in rows:
                if len(h) < window:
                    continue
                at = around(np.frombuffer(hits, "<i4"), len(h), block, window)
                own = (
                    rolling(h, window, FACTORS[0])[at], (mixed(rolling(h, window, FACTORS[1])[at]) >> np.uint64(32)).astype(np.uint32),
                    np.full(len(at), k, np.int64), np.full(len(at), uid, np.int64), at.astype(np.int32),
                )
                for held, value in zip(parts, own):
                    held.append(value)
            if not parts[0]:
                continue
            rows.clear()
            one, two, key, uid, start = map(np.concatenate, parts)
            parts.clear()
            one = mixed(one)
            bucket = one % np.uint64(n)
            order = np.lexsort((start, key, two, one, bucket))
            one, two, key, uid, start, bucket = (x[order] for x in (one, two, key, uid, start, bucket))
            new = np.ones(len(one), bool)
            new[1:] = (np.diff(one) != 0) | (np.diff(two) != 0)
            group = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            least = (key == key[firsts][group]) & (start == start[firsts][group])
            sent = np.flatnonzero(least)
            sent_ends = _bounds(bucket[sent], n)
            local, local_ends = _by_document(np.flatnonzero(~least), uid, n)
            columns: list[list] = [[] for _ in range(9)]
            for b in range(n):
                s, l = sent[sent_ends[b] : sent_ends[b + 1]], local[local_ends[b] : local_ends[b + 1]]
                uids, doc_at, doc = np.unique(uid[s], return_index=True, return_inverse=True)
                row = (
                    buckets[b], one[s].tobytes(), two[s].tobytes(), doc.astype(np.uint32).tobytes(), start[s].tobytes(),
                    key[s][doc_at].tobytes(), uids.tobytes(), uid[l].tobytes(), start[l].tobytes(),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            names = [x.split()[0] for x in SPANS.split(", ")]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    return map_batches(marked.select("k", "uid", "hits", "text"), run, SPANS)


def repeats(windows: DataFrame, parts: int, buckets: list[int]) -> DataFrame:
    """-> ANSWERS: starts of the windows that are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        for batch in batches:
            for bucket, one, two, doc, start, key, uid, *local in zip(*(c.to_pylist() for c in batch.columns)):
                doc = np.frombuffer(doc, np.uint32)
                own = (
                    np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint32), np.frombuffer(key, np.int64)[doc], np.frombuffer(uid, np.int64)[doc],
                    np.frombuffer(start, np.int32), np.frombuffer(local[0], np.int64), np.frombuffer(local[1], np.int32),
                )
                for kept, value in zip(held.setdefault(bucket, [[] for _ in own]), own):
                    kept.append(value)
        for bucket in list(held):
            one, two, key, uid, start, local_uid, local_start = map(np.concatenate, held.pop(bucket))
            order = np.lexsort((start, key, two, one))
            one, two, key, uid, start = (x[order] for x in (one, two, key, uid, start))
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            firsts, group = np.flatnonzero(new), np.cumsum(new) - 1
            later = (key != key[firsts][group]) | (start != start[firsts][group])
            yield answers(np.concatenate([uid[later], local_uid]), np.concatenate([start[later], local_start]), buckets)

    return map_batches(windows.repartition(parts, "bucket"), run, ANSWERS)


# -- 3: documents -------------------------------------------------------------


def kept_words(text: str | None, runs: bytes | None, window: int) -> tuple[int, list[bytes]]:
    """(number of words, the words that no repeat covers); runs: of starts of repeats."""
    words = words_of(text)
    if not runs:
        return len(words), words
    starts, lengths = np.frombuffer(runs, "<i4").reshape(-1, 2).T
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths - 1 + window, -1)
    covered = np.cumsum(edges)[:-1] > 0
    return len(words), [w for w, c in zip(words, covered) if not c]


def remove_repeats(documents: DataFrame, window: int = WINDOW, block: int = BLOCK, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, text, ..) -> (doc_id, n_words, n_removed, kept_sha256, kept, row).

    ``kept``: the text without its repeats: unchanged if there are none, else the words that
    stay, joined by one space.  ``row``: the other columns of the document, as a struct.
    """
    if window < 2 * block - 1:
        raise ValueError("a window has to hold a whole block: window >= 2 * block - 1")
    spark, parts = documents.sparkSession, partitions(documents.sparkSession)
    buckets = labels(spark, parts)
    doc_id = F.col("doc_id").cast("long")
    docs = documents.select(
        doc_id.alias("doc_id"),
        F.xxhash64(doc_id, "text").alias("uid"),
        "text",
        F.struct(F.lit(None).cast("int"), *[documents[c] for c in documents.columns if c not in ("doc_id", "text")]).alias("row"),
    )
    dealt = docs.repartition(parts, "uid")
    probes = probe_rows(docs.select("uid", "text"), block, buckets, chunk_words)
    hits = merged(hit_anchors(probes, parts, buckets), parts, runs=False).withColumnRenamed("places", "hits")
    # both joins read the same columns of ``dealt``, so that they share its exchange
    first = F.coalesce("doc_id", F.lit(FIRST_ID))
    marked = dealt.join(hits, "uid").select(first.alias("k"), "uid", "hits", "text")
    windows = window_rows(marked, block, window, buckets, chunk_words)
    found = merged(repeats(windows, parts, buckets), parts, runs=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for places, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n_words, left = kept_words(text, places, window)
                joined = b" ".join(left)
                row = n_words, n_words - len(left), hashlib.sha256(joined).hexdigest(), text if len(left) == n_words else joined.decode()
                for column, value in zip(out, row):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.record_batch([batch.column(0), *columns, batch.column(1)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "row"])

    whole = dealt.join(found, "uid", "left").select("doc_id", "row", "places", "text")
    schema = T.StructType(whole.schema.fields[:1])
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "string")):
        schema = schema.add(name, kind)
    return map_batches(whole, run, schema.add(whole.schema["row"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(documents).drop("kept", "row")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, s.start, array_to_string(words[s.start:s.start + 19], ' ') AS span
  FROM d, unnest(range(1, CAST(len(words) - 18 AS BIGINT))) AS s(start)),
r AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY span ORDER BY doc_id, start) AS place FROM w)
  WHERE place > 1),
gone AS (
  SELECT DISTINCT doc_id, start + step AS place FROM r, range(20) AS o(step)),
gone_list AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
k AS (
  SELECT doc_id, len(words) AS n_words,
    CASE WHEN places IS NULL THEN words
      ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END AS kept
  FROM d LEFT JOIN gone_list USING (doc_id))
SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
