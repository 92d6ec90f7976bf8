"""SimHash fingerprints and near-duplicates by pivot distance tables.

Fingerprint: of the XXH64 hashes (seed 42) of all word shingles, each bit by majority.

Links: for every fingerprint the Hamming distances to many reference fingerprints are
computed, its row of the pivot table.  By the triangle inequality two fingerprints within
``radius`` bits differ by at most ``radius`` in every coordinate.

* Candidates: the first 65 references form a chain, each with one more bit than the one
  before.  A step of the distances along the chain shows which way that bit lies, so two
  fingerprints that agree on a stretch of bits make equal steps there.  The 64 steps are cut
  into 6 stretches; two differing bits touch two at most, so a pair agrees on some 4 of
  them: 15 keys of 42 bits or more, by which fingerprints are dealt out.
* Pairs of a bucket are discarded by their largest coordinate difference over the chain and
  the scattered references, and survivors are verified bit by bit.
* A bucket gives links to the least member of each of its components, never all its pairs.
  Distinct fingerprints share a key of 42 bits, so a bucket has 2^22 members at most; one
  beyond PAIRWISE is cut again in the same way by the bits that are still free, which ends
  at 2^8 members, so no candidate is dropped.

``components_of`` works on distinct fingerprints: copies are aggregated before, and rejoined
after; a hot fingerprint is one row in all that lies between.

``near_duplicates`` finds documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  At that similarity whole fingerprints differ by some 10 bits, so
candidates come from VIEWS small fingerprints, each the SimHash of 4 shingles that the document
samples by smallest hashes: a pair at 0.8 shares a given one with probability 0.41, at
least one of 20 in all but 3 of 100,000 cases.  First a bucket offers each member its most connected
member and one at random, since copies are closer to their original than to each other.  Pairs are discarded by the pivot distances of the whole fingerprints and verified
by exact Jaccard similarity.  Then all members of buckets that still hold several components
meet at shared shingles, rarest first (``prefix_pairs``): that finds every pair of theirs
at 0.8, so no pair of a bucket is left out unless it is in one component already.
Documents of equal words are one representative throughout.

Defined cases: null text has no words; no words: fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence; repeated rows and null ids are documents of
their own (a component of null ids only has a null id); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.llm.common import map_batches, partitions, saved, scratch, table
from briefspark.llm.components import components

SEED = 42
RADIUS = 2
STRETCHES = 6
PAIRWISE = 1024
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16
VIEWS, SAMPLED = 20, 4
#: Documents of a shared shingle that meet in one piece; more are dealt out in blocks.
BLOCK = 1024
#: Row numbers that may go to all tasks: 8 MB of them.
FEW = 1 << 20
#: Bits by which whole fingerprints of documents at 0.8 may differ (0.151 x 64 expected).
FAR = 28


# -- fingerprints -------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included, in order."""
    found = text.encode().lower().split()  # bytes: splits at and lowers ASCII only
    if not found:
        return np.empty(0, np.uint64)
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts, width = (ends - sizes).tolist(), min(words, len(found))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNT_ROWS):
        part = hashes[start : start + COUNT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t or "", words)) for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), fp], ["doc_id", "fp"])

    narrow = documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text")
    return map_batches(narrow, run, "doc_id long, fp long")


# -- pivot table --------------------------------------------------------------

CHAIN = np.array([(1 << n) - 1 for n in range(65)], np.uint64)
SCATTERED = np.array([xxhash.xxh64_intdigest(b"reference %d" % n, SEED) for n in range(31)], np.uint64)
REFERENCES = np.concatenate([CHAIN, SCATTERED])


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)


def chain_steps(rows: np.ndarray) -> np.ndarray:
    """The steps of the distances along the chain, -1 as 1 and +1 as 0."""
    return (np.diff(rows[:, : len(CHAIN)], axis=1) < 0).astype(np.uint64)


def stretches(places: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(places), min(parts, len(places)))]


def keys(steps: np.ndarray, places: list[int], parts: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(free places, key) for every choice of stretches that RADIUS bits leave untouched."""
    cut = stretches(places, parts)
    for touched in combinations(range(len(cut)), min(RADIUS, len(cut) - 1)):
        fixed = [p for n, part in enumerate(cut) if n not in touched for p in part]
        free = [p for n in touched for p in cut[n]]
        weights = np.uint64(1) << np.arange(len(fixed), dtype=np.uint64)
        yield free, (steps[:, fixed] * weights).sum(1, dtype=np.uint64)


def close_pairs(fps: np.ndarray, rows: np.ndarray, one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are within ``radius`` bits."""
    out = np.zeros(len(one), bool)
    for start in range(0, len(one), COUNT_ROWS):
        a, b = one[start : start + COUNT_ROWS], two[start : start + COUNT_ROWS]
        near = np.flatnonzero(np.abs(rows[a] - rows[b]).max(1) <= radius)
        out[start + near] = np.bitwise_count(fps[a[near]] ^ fps[b[near]]) <= radius
    return out


def bucket_links(fps: np.ndarray, free: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (member, least member of its component) among distinct fingerprints that differ
    in the ``free`` places only."""
    if len(fps) > PAIRWISE and len(free) > 8:
        found = []
        for still_free, key in keys(chain_steps(pivot_table(fps)), free, 4):
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    found += bucket_links(fps[group], still_free)
        return found
    rows = pivot_table(fps)
    one, two = np.triu_indices(len(fps), 1)
    near = close_pairs(fps, rows, one, two, RADIUS)
    one, two = one[near], two[near]
    least = np.arange(len(fps))
    while len(one):
        low = np.minimum(least[one], least[two])
        after = least.copy()
        np.minimum.at(after, one, low)
        np.minimum.at(after, two, low)
        after = after[after]
        if np.array_equal(after, least):
            break
        least = after
    moved = np.flatnonzero(least != np.arange(len(fps)))
    return [(fps[moved], fps[least[moved]])] if len(moved) else []


def links(fps: DataFrame) -> DataFrame:
    """(fp), distinct -> (a, b): links that connect whatever lies within RADIUS bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for n, (_, key) in enumerate(keys(chain_steps(pivot_table(values)), list(range(64)), STRETCHES)):
                number = pa.array(np.full(len(values), n, np.int32))
                yield pa.record_batch([number, pa.array(key.view(np.int64)), batch.column(0)], ["choice", "key", "fp"])

    every = np.arange(64).tolist()
    free_of = [free for free, _ in keys(np.zeros((1, 64), np.uint64), every, STRETCHES)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last bucket so far

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            found = []
            cuts = np.flatnonzero((np.diff(rows["choice"]) != 0) | (np.diff(rows["key"]) != 0)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(rows))
            for a, b in zip(starts, ends):
                if b - a > 1:
                    found += bucket_links(rows["fp"][a:b].view(np.uint64), free_of[rows["choice"][a]])
            pairs = [np.concatenate(x).view(np.int64) if found else np.empty(0, np.int64) for x in (list(zip(*found)) or [(), ()])]
            return pa.record_batch([pa.array(x) for x in pairs], ["a", "b"])

        for batch in batches:
            rows = np.empty(batch.num_rows, [("choice", np.int32), ("key", np.int64), ("fp", np.int64)])
            for name, column in zip(rows.dtype.names, batch.columns):
                rows[name] = column.to_numpy()
            if not len(rows):
                continue
            last = (rows["choice"] == rows["choice"][-1]) & (rows["key"] == rows["key"][-1])
            begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if held and (begin or rows[0][["choice", "key"]] != held[-1][-1][["choice", "key"]]):
                yield linked(np.concatenate([*held, rows[:begin]]))
                held = []
            elif begin:
                yield linked(rows[:begin])
            held.append(rows[begin:])
        if held:
            yield linked(np.concatenate(held))

    dealt = map_batches(fps.select("fp"), deal, "choice int, key long, fp long")
    parts = partitions(fps.sparkSession)
    sorted_rows = dealt.repartition(parts, "choice", "key").sortWithinPartitions("choice", "key")
    return map_batches(sorted_rows, meet, "a long, b long")


def components_of(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id)."""
    docs = saved(fingerprints(documents, words), stays=True)
    with scratch(documents.sparkSession):
        by_fp = _components_of_fingerprints(docs)
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _components_of_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id)."""
    first = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(first)).select(F.col("node").alias("fp"), "root")
    rooted = first.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # saved, like other small sides of joins below: the join then has an exchange on either side,
    # and only so can Spark split a hot key
    ids = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return saved(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), stays=True)


# -- near-duplicates of 0.8 and more -------------------------------------------

FEATURES = "uid long, doc_id long, digest binary, fp long, size int, views array<long>"


def sampling(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n orders of the 64-bit numbers."""
    numbers = [xxhash.xxh64_intdigest(b"order %d" % i, SEED) for i in range(2 * n)]
    return np.array(numbers[:n], np.uint64) | np.uint64(1), np.array(numbers[n:], np.uint64)


FACTORS, OFFSETS = sampling(VIEWS * SAMPLED)


def view_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of the SAMPLED shingles that come first in each view's orders."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    chosen = np.zeros(len(FACTORS), np.uint64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        order = (part[None, :] ^ OFFSETS[:, None]) * FACTORS[:, None]
        at = order.argmin(1)
        low = order[np.arange(len(at)), at]
        chosen = np.where(low < least, part[at], chosen)
        least = np.minimum(least, low)
    bits = np.unpackbits(chosen.astype("<u8").view(np.uint8).reshape(VIEWS, SAMPLED, 8), axis=2, bitorder="little")
    views = np.packbits(2 * bits.sum(1, dtype=np.int64) > SAMPLED, axis=1, bitorder="little").view("<u8").ravel()
    return views ^ OFFSETS[:VIEWS]  # so that the keys of different views do not meet


def features(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) -> a row of FEATURES each; uid is a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps, sizes, views = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = np.unique(shingle_hashes(text or "", words))
                spoken = b" ".join((text or "").encode().lower().split())
                digests.append(xxhash.xxh3_128_digest(spoken))
                fps.append(majority(hashes))
                sizes.append(len(hashes))
                views.append(view_fingerprints(hashes).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(views, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["uid", "doc_id", "digest", "fp", "size", "views"])

    return map_batches(documents.select("uid", "doc_id", "text"), run, FEATURES)


def buckets(rows: DataFrame) -> DataFrame:
    """(uid, fp, size, views) -> (key, uid, fp, size, weight): the members of every bucket of equal
    view fingerprints; size: shingles; weight: how many members the buckets of a document have."""
    views = rows.select("uid", "fp", "size", F.explode("views").alias("key"))
    shared = saved(views.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = views.join(shared, "key")
    weight = members.groupBy("uid").agg(F.sum("n").alias("weight"))
    return saved(members.join(weight, "uid").select("key", "uid", "fp", "size", "weight"))


def candidates(members: DataFrame, similarity: float, radius: int = FAR) -> DataFrame:
    """Buckets -> distinct (a, b), a < b, that pass the pivot table and whose numbers of shingles
    allow that similarity.

    In every bucket, members meet the one that shares most buckets with others (the likely
    original) and one at random; ``unsettled`` has the members that this does not settle.
    """
    centres = saved(
        members.groupBy("key").agg(
            F.max(F.struct("weight", "uid", "fp", "size")).alias("most"),
            F.min(F.struct(F.xxhash64("uid", "key").alias("h"), "uid", "fp", "size")).alias("any"),
        )
    )
    both = F.array(*[F.struct(f"{c}.uid", f"{c}.fp", f"{c}.size") for c in ("most", "any")])
    met = (
        members.join(centres, "key")
        .select("uid", "fp", "size", F.explode(both).alias("c"))
        .filter(F.col("uid") != F.col("c.uid"))
        .filter(F.least("size", "c.size") >= similarity * F.greatest("size", "c.size") - 1e-6)
    )
    own, other = F.struct("uid", "fp"), F.struct("c.uid", "c.fp")
    pairs = met.select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b")).distinct()

    def discard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.concatenate([batch.column(n).to_numpy() for n in (2, 3)]).view(np.uint64)
            one = np.arange(batch.num_rows)
            near = close_pairs(fps, pivot_table(fps), one, one + batch.num_rows, radius)
            yield batch.select([0, 1]).filter(pa.array(near))

    flat = pairs.select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b"), F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb"))
    return map_batches(flat, discard, "a long, b long")


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(uid, root) of the members of all buckets of three and more that links have not made
    one component."""
    rooted = saved(members.select("key", "uid").join(roots, "uid", "left").select("key", "uid", F.coalesce("root", "uid").alias("root")))
    spread = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = saved(spread.filter("n > 2 and lo <> hi").select("key"))
    return saved(rooted.join(several, "key").select("uid", "root").distinct())


def shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """(uid, text) -> (uid, shingles): 32 bits of every distinct shingle's hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                np.unique((shingle_hashes(t or "", words) >> np.uint64(32)).astype("<u4")).tobytes()
                for t in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["uid", "shingles"])

    return map_batches(documents.select("uid", "text"), run, "uid long, shingles binary")


def meeting_pairs(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(lesser uid, greater uid) of the rows of equal (token, i, j), next to each other, whose
    roots differ and that can be similar if they share nothing before that token."""
    new = np.zeros(len(rows), bool)
    for name in ("token", "i", "j"):
        new[1:] |= rows[name][1:] != rows[name][:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts, len(rows))[np.searchsorted(starts, np.arange(len(rows)), "right")]
    left, size = rows["size"] - rows["place"], rows["size"]
    ones, twos, step, at = [], [], 1, np.arange(len(rows))
    while len(at := at[at + step < ends[at]]):
        to = at + step
        can = np.minimum(left[at], left[to]) * (1 + similarity) >= similarity * (size[at] + size[to]) - 1e-6
        can &= rows["root"][at] != rows["root"][to]
        ones.append(rows["uid"][at[can]])
        twos.append(rows["uid"][to[can]])
        step += 1
    one, two = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ones, twos))
    return np.minimum(one, two), np.maximum(one, two)


def prefix_pairs(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(uid, shingles), (uid, root) -> distinct (a, b), a < b: a superset of the pairs of that
    Jaccard similarity whose roots differ.

    The shingles of a document are ordered by the number of documents that have them, rare
    ones first; similar documents share one within the first 1 - similarity of either, and
    at the first that they share enough must be left on both sides.  What a template gives
    to all its documents comes last and is mostly not reached.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
            uids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            every = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.record_batch([pa.array(every, pa.int32()), pa.array(uids, pa.int64())], ["token", "uid"])

    spelt = map_batches(sets, tokens, "token int, uid long")
    shared = saved(spelt.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    lists = spelt.join(shared, "token").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("found"))
    sizes = sets.select("uid", (F.octet_length("shingles") / 4).cast("int").alias("size"))
    weights = saved(roots.groupBy("root").agg(F.count("*").alias("weight")))
    known = roots.join(weights, "root").join(sizes, "uid")
    alone = F.col("size") - F.size("found")  # shingles of no other document come first
    reached = F.floor(F.col("size") * (1 - similarity) + 1e-6) + 1 - alone
    prefixes = saved(
        lists.join(known, "uid")
        .filter(reached > 0)
        .select("uid", "root", "weight", "size", alone.alias("alone"), F.posexplode(F.slice("found", F.lit(1), reached.cast("int"))).alias("at", "f"))
        .select(F.col("f.token").alias("token"), "uid", "root", "weight", "size", (F.col("alone") + F.col("at")).alias("place"))
    )
    # the greatest component of a shingle's documents meets the others, never itself
    greatest = prefixes.groupBy("token").agg(
        F.max(F.struct("weight", "root")).alias("g"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    greatest = saved(greatest.filter("lo <> hi").select("token", F.col("g.root").alias("most")))
    in_most = F.col("root") == F.col("most")
    here = saved(prefixes.join(greatest, "token").select("token", "uid", "root", "size", "place", in_most.alias("in_most")))
    blocks = lambda of: F.ceil(F.sum(of.cast("int")) / BLOCK).cast("int")
    counts = saved(here.groupBy("token").agg(blocks(F.col("in_most")).alias("of_most"), blocks(~F.col("in_most")).alias("of_rest")))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    tile = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    most_tiles = F.transform(upto("of_rest"), lambda b: tile(b, -1 - own("of_most")))
    rest_tiles = F.concat(
        F.transform(upto("of_most"), lambda b: tile(own("of_rest"), -1 - b)),
        F.transform(upto("of_rest"), lambda b: tile(F.least(b, own("of_rest")), F.greatest(b, own("of_rest")))),
    )
    dealt = (
        here.join(counts, "token")
        .withColumn("t", F.explode(F.when(F.col("in_most"), most_tiles).otherwise(rest_tiles)))
        .select("token", "t.i", "t.j", "uid", "root", "size", "place")
    )
    names = [("token", np.int32), ("i", np.int32), ("j", np.int32), ("uid", np.int64), ("root", np.int64), ("size", np.int64), ("place", np.int64)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def met(rows: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x) for x in meeting_pairs(rows, similarity)], ["a", "b"])

        for batch in batches:
            rows = np.empty(batch.num_rows, names)
            for name, column in zip(rows.dtype.names, batch.columns):
                rows[name] = column.to_numpy()
            held.append(rows)
            waiting += len(rows)
            if waiting < COUNT_ROWS:
                continue
            rows = np.concatenate(held)
            differ = np.flatnonzero((rows["token"] != rows["token"][-1]) | (rows["i"] != rows["i"][-1]) | (rows["j"] != rows["j"][-1]))
            begin = int(differ[-1]) + 1 if len(differ) else 0
            if begin:
                yield met(rows[:begin])
            held, waiting = [rows[begin:]], len(rows) - begin
        if waiting:
            yield met(np.concatenate(held))

    by = ["token", "i", "j"]
    sorted_rows = dealt.repartition(partitions(sets.sparkSession), *by).sortWithinPartitions(*by)
    return map_batches(sorted_rows, meet, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(one, "<u4"), np.frombuffer(two, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    of = lambda end: sets.select(F.col("uid").alias(end), F.col("shingles").alias(f"{end}_set"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set")
    return map_batches(joined, run, "a long, b long")


def with_uid(documents: DataFrame) -> DataFrame:
    return documents.withColumn("uid", F.xxhash64(F.col("doc_id").cast("long"), "text"))


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text) -> (uid, doc_id, group_id, n_links, stays) for every document.

    group_id: the smallest doc_id of the group; n_links: verified links of the document's
    text to other texts; stays: true for the one document that stands for the group (rows
    that repeat both doc_id and text share their uid, and so all of this).
    """
    with scratch(documents.sparkSession):
        rows, by_text = _near_groups(documents, words, similarity)
    return rows.join(by_text, "digest").select(
        "uid",
        "doc_id",
        F.col("stands.doc_id").alias("group_id"),
        "n_links",
        (F.col("uid") == F.col("stands.uid")).alias("stays"),
    )


def _near_groups(documents: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, digest) of every document, (digest, stands, n_links) of every text."""
    docs = with_uid(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = saved(features(docs, words))
    rows = saved(found.select("uid", "doc_id", "digest"), stays=True)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    first = rows.groupBy("digest").agg(F.min(order).alias("first"))
    texts = saved(first.select("digest", "first", F.col("first.uid").alias("uid")))
    members = buckets(found.select("uid", "fp", "size", "views").join(texts.select("uid"), "uid"))
    # the texts of those that share a bucket with another move, once; few of these go to all tasks
    in_buckets = saved(members.select("uid").distinct())
    if in_buckets.count() <= FEW:
        in_buckets = F.broadcast(in_buckets)
    sets = saved(shingle_sets(docs.join(in_buckets, "uid").dropDuplicates(["uid"]), words))
    near = saved(verified(saved(candidates(members, similarity)), sets, similarity))
    roots = saved(components(near).select(F.col("node").alias("uid"), "root"))
    rest = unsettled(members, roots)
    rest_sets = saved(sets.join(rest.select("uid"), "uid", "left_semi"))
    more = saved(verified(prefix_pairs(rest_sets, rest, similarity), rest_sets, similarity))
    if not more.isEmpty():  # no links, no new components
        near = saved(near.union(more).distinct())
        roots = components(near).select(F.col("node").alias("uid"), "root")
    rooted = texts.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    groups = saved(rooted.groupBy("root").agg(F.min("first").alias("stands")))
    degree = (
        near.select(F.col("a").alias("uid"))
        .union(near.select(F.col("b").alias("uid")))
        .groupBy("uid")
        .agg(F.count("*").alias("n_links"))
    )
    by_text = rooted.join(groups, "root").join(degree, "uid", "left")
    return rows, saved(by_text.select("digest", "stands", F.coalesce("n_links", F.lit(0)).alias("n_links")), stays=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
