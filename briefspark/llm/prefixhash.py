"""Document fingerprints from modular prefix arrays.

For code points c of a text, S[i] = sum of c[j] * B^j for j < i, modulo two primes of 31
bits.  With the inverse powers of B, (S[b] - S[a]) * B^-a is the hash of the span a..b,
whatever its place: two spans are equal if their hashes are, up to one in 2^62.

* ``common_prefix`` finds the longest common extension of two texts at two places by binary
  search over the prefix arrays.
* A fingerprint holds the length, the hash of the whole text and the smallest SKETCH distinct
  mixed hashes of all spans of SPAN code points (of the whole text if it is shorter).
* ``likeness`` reads two fingerprints only: the share of spans that both have among the
  smallest of either (J), as 2 J / (1 + J), which is the common share of two texts of equal
  length; 1 for equal fingerprints, 0 if one text is empty and the other is not.
* The hashes of an edited text (the front of one text and the front of another) come from
  the arrays of the two: only the spans across the joint are hashed anew.

The next document: documents are dealt out by ranges of doc_id, whose borders are
approximate percentiles, and each range also gets a copy of the first document of the next
one.  A range is read as a sorted stream.  Only borders and first ids (one per partition)
are known to the driver.

Defined cases: null text is empty; documents of equal doc_id are ordered by text; a null
doc_id comes first; a single document is its own next one; repeated rows stay; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.common import map_batches, partitions, table

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_117_465_807, 873_250_933)
SPAN = 16
SKETCH = 64
FIRST_ID = -(1 << 63)


class Powers:
    """B^i and B^-i for every place, grown when a longer text comes."""

    def __init__(self) -> None:
        self.size = 0
        self.up: list[np.ndarray] = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down: list[np.ndarray] = [np.ones(1, np.uint64) for _ in PRIMES]

    def to(self, size: int) -> Powers:
        if size >= self.size:
            self.size = max(4096, 2 * size)
            for n, (p, b) in enumerate(zip(PRIMES, BASES)):
                self.up[n], self.down[n] = self.of(b, p), self.of(pow(b, -1, p), p)
        return self

    def of(self, base: int, prime: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) <= self.size:  # doubling: the second half is the first times B^len
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        return out


POWERS = Powers()


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.size = len(codes)
        self.powers = POWERS.to(self.size + SPAN)
        self.sums = []
        for n, p in enumerate(PRIMES):
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(codes * self.powers.up[n][: self.size] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))
        self._spans: np.ndarray | None = None

    def prefix(self, i: int) -> tuple[int, int]:
        return int(self.sums[0][i]), int(self.sums[1][i])

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The hash of code points a..b, independent of the place."""
        return tuple(
            (int(s[b]) - int(s[a])) * int(self.powers.down[n][a]) % PRIMES[n] for n, s in enumerate(self.sums)
        )

    def spans(self) -> np.ndarray:
        """Mixed hashes of all spans of SPAN code points, by start."""
        if self._spans is None:
            starts = max(0, self.size - SPAN + 1)
            pair = []
            for n, p in enumerate(PRIMES):
                s, prime = self.sums[n], np.uint64(p)
                part = s[SPAN:] + prime - s[:starts] if starts else s[:0]
                pair.append(part % prime * self.powers.down[n][:starts] % prime)
            self._spans = mixed(*pair)
        return self._spans


class Spliced:
    """The text first[:cut] + second[:more], from the arrays of both."""

    def __init__(self, first: PrefixHashes, cut: int, second: PrefixHashes, more: int):
        self.first, self.cut, self.second, self.more = first, cut, second, more
        self.size = cut + more

    def prefix(self, i: int) -> tuple[int, int]:
        if i <= self.cut:
            return self.first.prefix(i)
        return tuple(
            (a + b * int(self.first.powers.up[n][self.cut])) % PRIMES[n]
            for n, (a, b) in enumerate(zip(self.first.prefix(self.cut), self.second.prefix(i - self.cut)))
        )

    def spans(self) -> np.ndarray:
        own = self.first.spans()[: max(0, self.cut - SPAN + 1)]
        other = self.second.spans()[: max(0, self.more - SPAN + 1)]
        starts = range(max(0, self.cut - SPAN + 1), max(0, min(self.cut, self.size - SPAN + 1)))
        across = []
        for a in starts:
            left, right = self.first.span(a, self.cut), self.second.prefix(a + SPAN - self.cut)
            across.append([(x + y * int(self.first.powers.up[n][self.cut - a])) % PRIMES[n] for n, (x, y) in enumerate(zip(left, right))])
        joint = mixed(*np.array(across, np.uint64).reshape(-1, 2).T)
        return np.concatenate([own, joint, other])


def mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """62 bits of hash -> 32 well mixed bits (so that the smallest are a fair sample)."""
    x = one << np.uint64(31) ^ two
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def smallest(values: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct values."""
    few = 8 * SKETCH
    if len(values) > few:
        found = np.unique(np.partition(values, few)[:few])
        if len(found) >= SKETCH:
            return found[:SKETCH]
    return np.unique(values)[:SKETCH]


def fingerprint(text: PrefixHashes | Spliced) -> str:
    whole = text.prefix(text.size)
    spans = text.spans()
    if not len(spans) and text.size:
        spans = mixed(*(np.array([w], np.uint64) for w in whole))
    sketch = base64.b64encode(smallest(spans).astype("<u4").tobytes()).decode()
    return f"{text.size:x}.{whole[0]:08x}{whole[1]:08x}.{sketch}"


def likeness(one: str, two: str) -> float:
    if one == two:
        return 1.0
    a, b = (np.frombuffer(base64.b64decode(x.rsplit(".", 1)[1]), "<u4") for x in (one, two))
    if not len(a) or not len(b):
        return 0.0
    known = min(int(x[-1]) if len(x) == SKETCH else 1 << 32 for x in (a, b))
    a, b = a[a <= known], b[b <= known]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 2 * both / (len(a) + len(b))


def common_prefix(one: PrefixHashes | Spliced, two: PrefixHashes | Spliced, a: int = 0, b: int = 0) -> int:
    """Length of the longest common extension of one[a:] and two[b:]."""
    low, high = 0, min(one.size - a, two.size - b)
    start = one.prefix(a), two.prefix(b)
    while low < high:
        middle = (low + high + 1) // 2
        end = one.prefix(a + middle), two.prefix(b + middle)
        same = all(
            (end[0][n] - start[0][n]) * pow(BASES[n], b, p) % p == (end[1][n] - start[1][n]) * pow(BASES[n], a, p) % p
            for n, p in enumerate(PRIMES)
        )
        low, high = (middle, high) if same else (low, middle - 1)
    return low


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_common_prefix long, next_common_prefix long"
)


def range_of(borders: Column, k: Column, count: int) -> Column:
    """How many of ``count`` sorted borders lie below k, by binary search."""
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(count.bit_length()))])
    below = lambda found, step: F.get(borders, found + step - 1) < k  # noqa: E731 - null beyond the last
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(below(found, step), found + step).otherwise(found))


def with_next(documents: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt out by ranges of doc_id and sorted; each range ends with a borrowed
    copy of the first document of the next range (the last range: of the first)."""
    spark, parts = documents.sparkSession, partitions(documents.sparkSession)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("k"),
    )
    shares = [n / parts for n in range(1, parts)] or [0.5]
    borders = docs.agg(F.percentile_approx("k", shares, 100 * parts)).first()[0] or []
    borders = sorted(set(borders))
    table_of = lambda values, kind: F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>")
    docs = docs.withColumn("range", range_of(table_of(borders, "long"), F.col("k"), len(borders)) if borders else F.lit(0))
    heads = sorted((r["range"], r["k"]) for r in docs.groupBy("range").agg(F.min("k").alias("k")).collect())
    first: list[int | None] = [None] * (len(borders) + 1)
    before: list[int | None] = [None] * (len(borders) + 1)
    for n, (number, k) in enumerate(heads):
        first[number], before[number] = k, heads[n - 1][0]
    is_head = F.get(table_of(first, "long"), F.col("range")) == F.col("k")
    to = F.when(is_head, F.get(table_of(before, "int"), F.col("range")))
    places = F.array(
        F.struct(F.col("range").alias("at"), F.lit(False).alias("borrowed")),
        F.struct(to.alias("at"), F.lit(True).alias("borrowed")),
    )
    dealt = (
        docs.select("doc_id", "text", "k", F.explode(places).alias("p"))
        .filter(F.col("p.at").isNotNull())
        .select(F.col("p.at").alias("at"), F.col("p.borrowed").alias("borrowed"), "k", "doc_id", "text")
    )
    return dealt.repartition(parts, "at").sortWithinPartitions("at", "borrowed", "k", "text"), parts


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> fingerprints of the text and of its edited text, and likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, hashes, fingerprint) of a document of this range
        for batch in batches:
            out: list[tuple] = []
            for at, borrowed, doc_id, text in zip(*(batch.column(n).to_pylist() for n in (0, 1, 3, 4))):
                follows = held is not None and held[0] == at
                if not follows and borrowed:
                    held = None
                    continue  # a second copy of a first document that repeats
                hashes = PrefixHashes(text)
                own = fingerprint(hashes)
                if follows:
                    out.append(compare(held, text, hashes, own))
                held = None if borrowed else (at, doc_id, text, hashes, own)
            columns = list(zip(*out)) if out else [[]] * 9
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")]
            )

    dealt, _ = with_next(documents)
    return map_batches(dealt, run, SCHEMA)


def compare(held: tuple, next_text: str, next_hashes: PrefixHashes, next_fingerprint: str) -> tuple:
    _, doc_id, text, hashes, own = held
    replaced = len(text) // 2
    cut, more = len(text) - replaced, min(replaced, len(next_text))
    edited = Spliced(hashes, cut, next_hashes, more)
    edited_fingerprint = fingerprint(edited)
    sha = hashlib.sha256((text[:cut] + next_text[:more]).encode()).hexdigest()
    return (
        doc_id, len(text), sha, own, edited_fingerprint, likeness(own, edited_fingerprint),
        likeness(own, next_fingerprint), common_prefix(hashes, edited), common_prefix(hashes, next_hashes),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
