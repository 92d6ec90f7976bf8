"""Importance resampling towards a target: hashed n-gram weights, then a distributed radix sort.

Features of a text are all runs of 1 to LONGEST consecutive words, each in one of BUCKETS
buckets by its CRC-32.  Two tables of BUCKETS counts, one of the corpus and one of the target,
give a gain per bucket; they and the gains are all that reaches the driver, whatever the size
of the corpus.  The gains go with the tasks as one array, and a document's weight is the sum
of the gains at its features' buckets, taken by array indexing.  Its score adds Gumbel noise
that a hash of doc_id tells, so that the highest scores are a draw without replacement.

Ranks come from a radix sort, least significant digit first, over the composite key

    (highest score - score, doc_id, n_features)

written as one bit string of as many bits as each part spans, and cut into digits of at most
DIGIT bits.  Rows have a place from 0 on, and a block of consecutive places is a partition.  A pass

1. sorts every block by the digit, stably and by counting, in one task per block, which also
   tells each row its number among the equal digits of the block;
2. adds up the counts of (digit, block): a row's destination is the number of rows of lower
   digits, of the same digit in earlier blocks, and of the same digit before it in the block;
3. sends the rows to the blocks of their destinations.

The prefix sums run over digits (at most 2 ** DIGIT rows) and, for each digit, over blocks.  Every
pass ends in a checkpoint in the shared folder, so a lost executor costs one pass at most.  A
row is some 60 bytes and moves twice a pass: once to meet its offset, once to its destination
(where Spark broadcasts the offsets, only once).

The least significant digits order rows of the same score and doc_id (which have the same weight),
so the result does not depend on the order in which rows are read.

Defined cases: null text has no words and weight 0; documents with fewer than LEAST_WORDS words
have no rank; nothing to draw: all ranks are null; an empty corpus gives no rows, an empty target
gives t = T = 0; repeated rows are documents of their own, and rows that tie in all parts of the
key are alike, so their ranks are interchangeable; a null doc_id hashes as an empty id and comes
before all others in a tie; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.common import kept, map_batches, partitions, table

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Bits of a digit; rows of a block at least.
DIGIT, BLOCK_ROWS = 12, 4096

#: In UTF-8 a byte from 0x80 on is part of a character from U+0080 on.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


# -- weights --------------------------------------------------------------------


def hashed_features(text: bytes, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """(number of words, CRC-32 of every feature) of a text in UTF-8."""
    words = WORD.findall(text.lower())  # lowers ASCII only
    further = [b" " + w for w in words]
    found = [list(map(crc32, words))]
    for n in range(1, min(longest, len(words))):
        found.append(list(map(crc32, further[n:], found[-1])))  # a checksum goes on from that of the run's start
    return len(words), np.fromiter((c for part in found for c in part), np.int64, sum(map(len, found)))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features all texts have in each bucket: at most ``buckets`` rows come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                total += np.bincount(hashed_features(text or b"", longest)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = map_batches(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    big, small, size = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = ((t + 1.0) * (big + size) / ((s + 1.0) * (small + size)) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_features, weight)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch):
                words, found = hashed_features(text or b"", longest)
                rows.append((words, len(found), int(gain[found % buckets].sum())))
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [(), (), ()])]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    narrow = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"])
    return map_batches(narrow, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel variate) that the hash of ``seed:doc_id`` tells."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform))).cast("long")


# -- radix sort -----------------------------------------------------------------


def digit_plan(spans: list[int], digit: int) -> list[list[tuple[int, int, int, int]]]:
    """For each digit, least significant first: (part, shift down, bits, shift up) of its pieces.

    ``spans`` are the greatest values of the key's parts, the most significant part first.
    """
    plan: list[list[tuple[int, int, int, int]]] = []
    room = 0
    for part in reversed(range(len(spans))):
        done, bits = 0, spans[part].bit_length()
        while done < bits:
            if not room:
                plan.append([])
                room = digit
            take = min(room, bits - done)
            plan[-1].append((part, done, take, digit - room))
            done, room = done + take, room - take
    return plan


def digits(parts: list[np.ndarray], pieces: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.int64)
    for part, down, bits, up in pieces:
        low = (parts[part] >> np.uint64(down)) & np.uint64((1 << bits) - 1)
        out |= low.astype(np.int64) << up
    return out


def counting_sort(keys: np.ndarray, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): a stable order by small keys, and the number of each of the ordered rows
    among those of its key."""
    counts = np.bincount(keys, minlength=1 << digit)
    starts = np.cumsum(counts) - counts
    order = np.argsort(keys.astype(np.uint16 if digit <= 16 else np.int64), kind="stable")  # radix sort in numpy too
    return order, np.arange(len(keys)) - starts[keys[order]]


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows by blocks of ``size`` places, in the order of places."""
    block = F.expr(f"place div {size}").cast("int")
    return rows.repartitionById(n, block).sortWithinPartitions("place")


def radix_sorted(rows: DataFrame, key: list[str], digit: int = DIGIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows plus ``place``: 0, 1, 2... in the order of the ``key`` columns.

    The columns of the key are non-null longs; they are compared as the differences to their least
    values.  ``rows`` should be a table or a checkpoint, as it is read several times.
    """
    names = rows.columns
    edges = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{w}_{c}") for c in key for w, f in (("lo", F.min), ("hi", F.max))]).first()
    total = edges["n"]
    low = [edges[f"lo_{c}"] or 0 for c in key]
    plan = digit_plan([(edges[f"hi_{c}"] or 0) - a for c, a in zip(key, low)], digit)
    n = partitions(rows.sparkSession)
    size = max(1, block_rows, -(-total // n))
    n = max(1, -(-total // size))
    # any first places will do, as the whole key is sorted by: block x and number in it
    first = rows.withColumn("block", F.spark_partition_id().cast("long"))
    placed = first.withColumn("digit", F.lit(0))

    def sort_block(pieces: list[tuple[int, int, int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held or not sum(b.num_rows for b in held):
                return
            block = pa.Table.from_batches(held).combine_chunks()
            # differences as unsigned numbers, which also holds for spans beyond 63 bits
            parts = [block[c].to_numpy().view(np.uint64) - np.uint64(a & (2**64 - 1)) for c, a in zip(key, low)]
            found = digits(parts, pieces)
            order, number = counting_sort(found, digit)
            out = block.select(names).take(pa.array(order))
            out = out.append_column("digit", pa.array(found[order].astype(np.int32)))
            out = out.append_column("number", pa.array(number))
            out = out.append_column("block", block["block"].take(pa.array(order)))
            yield from out.to_batches()

        return run

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{kinds}, digit int, number long, block long"
    for pieces in plan or [[]]:
        ordered = kept(map_batches(placed.select(*names, "block"), sort_block(pieces), schema))
        counts = ordered.groupBy("digit", "block").agg(F.count("*").alias("rows"))
        before = lambda w: F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
        lower = counts.groupBy("digit").agg(F.sum("rows").alias("rows"))
        lower = lower.select("digit", F.coalesce(before(Window.orderBy("digit")), F.lit(0)).alias("lower"))
        earlier = F.coalesce(before(Window.partitionBy("digit").orderBy("block")), F.lit(0))
        offsets = counts.select("digit", "block", earlier.alias("earlier")).join(lower, "digit")
        offsets = kept(offsets.select("digit", "block", (F.col("lower") + F.col("earlier")).alias("offset")))
        sent = ordered.join(offsets, ["digit", "block"]).withColumn("place", F.col("offset") + F.col("number"))
        placed = kept(_blocks(sent.select(*names, "place"), size, n)).withColumn("block", F.expr(f"place div {size}"))
    return placed.select(*names, "place")


# -- the draw -------------------------------------------------------------------


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text), (text) -> (doc_id, n_words, n_features, weight, score, rank) of every document.

    ``rank`` numbers the drawn documents: ``percent`` of those with ``least_words`` words.
    """
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scored = kept(weighted(documents, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    worthy = F.col("n_words") >= least_words
    size = scored.filter(worthy).count()
    missing = F.col("doc_id").isNull()
    keyed = scored.filter(worthy).select(
        "*",
        (-F.col("score")).alias("from_top"),
        (~missing).cast("long").alias("has_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
    )
    if not size:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    placed = radix_sorted(keyed, ["from_top", "has_id", "id", "n_features"])
    place = F.when(F.col("place") < percent * size // 100, F.col("place") + 1)
    ranked = placed.select(*scored.columns, place.alias("rank"))
    return ranked.union(scored.filter(~worthy).withColumn("rank", F.lit(None).cast("long")))


#: CRC-32 by a table of 256 entries, over the hexadecimal digits of the UTF-8 bytes.
SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), read AS (
  SELECT 'd' AS side, row_number() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM read
), runs AS (
  SELECT side, n, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words
), often AS (SELECT side, n, f, count(*) AS k FROM runs GROUP BY ALL
), hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM often)
), bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2),
      lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab
), featured AS (SELECT side, n, bucket, sum(k)::BIGINT AS k FROM often JOIN bucketed USING (f) GROUP BY ALL
), counts AS (
  SELECT bucket, coalesce(sum(k) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 'b'), 0)::DOUBLE AS t FROM featured GROUP BY bucket
), totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM counts, totals
), weighed AS (
  SELECT n, sum(k)::BIGINT AS n_features, sum(k * g)::BIGINT AS weight FROM featured JOIN gain USING (bucket) WHERE side = 'd' GROUP BY n
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (n) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS r, count(*) OVER () AS size FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * size // 100 THEN r END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
