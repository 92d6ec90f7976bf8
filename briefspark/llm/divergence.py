"""How the sources of a language differ in their terms: an audit by pointer sort.

Counting.  A task takes its documents in slices of some SLICE_BYTES.  The Arrow buffer of a slice
is lower-cased (ASCII only), and a pointer is set at every place where a term starts.  A
multikey quicksort puts the pointers in the order of the terms that they point to, 8 bytes of a
term being one character: a slice of pointers is split into those below, at and above a pivot;
what is equal goes on with the next 8 bytes.  Small slices are finished by sorting, character
by character.  Splitting keeps the order of equal terms, so a run of equal pointers holds their
documents one after the other, and its length, its number of different documents and its
occurrences per source are read off.  Runs are dealt out once, by (language, term), and added up
by Spark; what a term has in all sources of its language is summed where its rows are.

Shares.  Each language keeps the V terms that at least LEAST_DOCS of its documents hold.  A
group, (lang, source) or a whole language, gives a term that occurs n times there the share
p = 1 + floor(SCALE (n + 1) / (N + V)), where N is the sum of its n; the divergence of share p
from share q is floor((p - q)^2 / q).

Pairs of sources.  The sum over all V terms comes without a row for every term and pair: most
terms occur in neither, one or both sources.  Start from "in neither" for all V terms, correct
for the terms of either source by its histogram of n, and for terms that both have by what tasks
add up over runs of (lang, term), pair by pair in arrays; a task sends one row per pair.  Only
the result itself has a row for each pair of sources.

All arithmetic is exact: products that may pass 63 bits are decimals of 38 digits.

Defined cases: null text, lang and source are ''; a group without terms has n = 0 throughout; V = 0
makes all pairs 0; a language of one source has no pairs; repeated rows are documents of
their own; ties go to the item that comes first in UTF-8; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.common import kept, map_batches, partitions, saved, scratch, table

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Text of a slice, slices of pointers that are sorted directly, rows of (lang, term) taken at once.
SLICE_BYTES, SMALL, ROWS = 8 << 20, 4096, 1 << 16
#: Pairs of sources that a task adds up before it sends them.
PAIRS = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


# -- pointers -------------------------------------------------------------------


def term_pointers(line: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, document) of every term in lower-cased texts that lie one after the other."""
    if not len(line):
        return (np.empty(0, np.int64),) * 3
    letter = LETTER[line]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    filled = offsets[:-1] < offsets[1:]  # a term does not go on into the next document
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first], ends[last] = letter[first], letter[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


class Pointers:
    """Pointers to the terms of a line of bytes, to be sorted."""

    def __init__(self, line: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.line = np.append(line, np.zeros(8, np.uint8))
        self.starts, self.stops = starts, stops
        self.order = np.arange(len(starts))
        #: where a term begins that differs from the one before
        self.new = np.zeros(len(starts), bool)

    def characters(self, chosen: np.ndarray, depth: int) -> np.ndarray:
        """The 8 bytes from ``depth`` on as numbers, zeros after the end of a term."""
        at, left = self.starts[chosen] + depth, self.stops[chosen] - self.starts[chosen] - depth
        places = np.arange(8)
        found = self.line[np.minimum(at[:, None] + places, len(self.line) - 1)]
        found[places >= left[:, None]] = 0
        return found.view(">u8").ravel().astype(np.uint64)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, new): pointers by term, equal ones in their old order; starts of runs."""
        waiting = [(0, len(self.order), 0, None)] if len(self.order) else []
        while waiting:
            low, high, depth, keys = waiting.pop()
            chosen = self.order[low:high]
            if keys is None:
                keys = self.characters(chosen, depth)
            if high - low <= SMALL:
                self.finish(low, high, depth, keys)
                continue
            pivot = np.sort(keys[:: max(1, (high - low) // 9)][:9])[4]
            below, equal = keys < pivot, keys == pivot
            above = ~(below | equal)
            one = low + int(below.sum())
            two = one + int(equal.sum())
            self.order[low:high] = np.concatenate([chosen[below], chosen[equal], chosen[above]])
            if low < one:
                waiting.append((low, one, depth, keys[below]))
            if two < high:
                waiting.append((two, high, depth, keys[above]))
            if int(pivot) & 0xFF:  # the terms go on
                waiting.append((one, two, depth + 8, None))
            else:
                self.new[one] = True
        return self.order, self.new

    def finish(self, low: int, high: int, depth: int, keys: np.ndarray) -> None:
        """Sort a small slice: runs of equal characters go on, side by side, with the next ones."""
        order, new = self.order[low:high], self.new[low:high]
        by_key = np.argsort(keys, kind="stable")
        order[:], keys = order[by_key], keys[by_key]
        new[0] = True
        new[1:] |= keys[1:] != keys[:-1]
        at = np.flatnonzero(keys & np.uint64(0xFF))
        while len(at):
            depth += 8
            run = np.cumsum(new)[at]
            keys = self.characters(order[at], depth)
            by_run = np.lexsort((keys, run))
            order[at], keys = order[at][by_run], keys[by_run]
            new[at[1:]] |= (run[1:] == run[:-1]) & (keys[1:] != keys[:-1])
            at = at[(keys & np.uint64(0xFF)) != 0]


def counted_runs(texts: pa.Array, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms), (term, group, occurrences, documents): what the runs of a slice tell.

    ``texts`` is a large binary array without nulls, ``groups`` has the group of each text.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    line = LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.uint8)
    starts, stops, docs = term_pointers(line, offsets - offsets[0])
    order, new = Pointers(line, starts, stops).sort()
    first = order[new]
    whole = line.tobytes()
    terms = [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]
    run, doc = np.cumsum(new) - 1, docs[order]
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]  # the first of a document in a run
    at = np.flatnonzero(once)
    times = np.diff(np.append(at, len(order)))
    size = int(groups.max()) + 1 if len(groups) else 1
    pair, where = np.unique(run[at] * size + groups[doc[at]], return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, where, times)
    return terms, pair // size, pair % size, n, np.bincount(where, minlength=len(pair))


def term_counts(documents: DataFrame) -> DataFrame:
    """(text, lang, source) -> (lang, source, term, n, docs): occurrences and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def slice_of() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = whole["text"].chunk(0) if whole.num_rows else pa.array([], pa.large_binary())
            number: dict[tuple[str, str], int] = {}
            names = zip(whole["lang"].to_pylist(), whole["source"].to_pylist())
            groups = np.array([number.setdefault(x, len(number)) for x in names], np.int64)
            terms, term, group, n, docs = counted_runs(texts, groups)
            langs, sources = (pa.array([x[k] for x in number], pa.string()) for k in (0, 1))
            spelt = pa.array(terms, pa.binary()).cast(pa.string())
            columns = [langs.take(pa.array(group)), sources.take(pa.array(group)), spelt.take(pa.array(term)), pa.array(n), pa.array(docs.astype(np.int64))]
            return pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            text, lang, source = (pc.fill_null(c, "") for c in batch.columns)
            held.append(pa.record_batch([text.cast(pa.large_string()).cast(pa.large_binary()), lang, source], ["text", "lang", "source"]))
            size += batch.column(0).nbytes
            if size >= SLICE_BYTES:
                yield slice_of()
                held, size = [], 0
        if held:
            yield slice_of()

    found = map_batches(documents.select("text", "lang", "source"), run, "lang string, source string, term string, n long, docs long")
    # dealt out by (lang, term), which also serves all sums over a term's sources
    dealt = found.repartition(partitions(documents.sparkSession), "lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- shares ---------------------------------------------------------------------


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)").cast("decimal(19,0)")
    return F.call_function("div", (wide(n) + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms)) + F.lit(1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares stay below 2^30.5, so nothing overflows."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, other group, correction) for every two rows of equal (lang, term), added up.

    What the sum over terms "in neither" plus the corrections for either source lack.
    """
    ends = np.append(np.flatnonzero(np.diff(rows["run"])) + 1, len(rows))
    end = ends[np.searchsorted(ends, np.arange(len(rows)), "right")]
    size = int(rows["group"].max()) + 1
    f = lambda p, q: (p - q) ** 2 // q
    keys, sums, at, step = [], [], np.arange(len(rows)), 1
    while len(at := at[at + step < end[at]]):
        for one, two in ((at, at + step), (at + step, at)):
            a, b = rows[one], rows[two]
            lacking = f(a["p"], b["p"]) - f(a["p"], b["p0"]) - f(a["p0"], b["p"]) + f(a["p0"], b["p0"])
            key, where = np.unique(a["group"] * size + b["group"], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, lacking)
            keys.append(key)
            sums.append(total)
        step += 1
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    return key // size, key % size, np.concatenate(sums) if sums else key


def both_sides(cells: DataFrame) -> DataFrame:
    """(lang, source, term, p, p0) -> (lang, source, item, value): corrections for the terms that
    both of two sources have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, str], int] = {}

        def sent() -> pa.RecordBatch:
            parts = list(zip(*total)) or [(), (), ()]
            columns = [pa.array(c, pa.string()) for c in parts] + [pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.record_batch(columns, ["lang", "source", "item", "value"])

        def add(found: pa.Table) -> None:
            names, rows = {}, np.empty(found.num_rows, [("run", np.int64), ("group", np.int64), ("p", np.int64), ("p0", np.int64)])
            langs = found["lang"].to_pylist()
            rows["group"] = [names.setdefault(x, len(names)) for x in zip(langs, found["source"].to_pylist())]
            runs: dict[tuple[str, str], int] = {}
            rows["run"] = [runs.setdefault(x, len(runs)) for x in zip(langs, found["term"].to_pylist())]
            rows["p"], rows["p0"] = found["p"].to_numpy(), found["p0"].to_numpy()
            spelt = list(names)
            for a, b, value in zip(*(x.tolist() for x in shared_terms(rows))):
                key = (*spelt[a], spelt[b][1])
                total[key] = total.get(key, 0) + value

        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting < ROWS:
                continue
            found = pa.Table.from_batches(held)
            last = pc.and_(pc.equal(found["lang"], found["lang"][-1]), pc.equal(found["term"], found["term"][-1]))
            begin = found.num_rows - pc.sum(last).as_py()  # the last term may go on in the next batch
            if begin:
                add(found.slice(0, begin))
            held, waiting = found.slice(begin).to_batches(), found.num_rows - begin
            if len(total) >= PAIRS:
                yield sent()
        if waiting:
            add(pa.Table.from_batches(held))
        yield sent()

    by = ["lang", "term"]
    dealt = cells.select("lang", "source", "term", "p", "p0").repartition(partitions(cells.sparkSession), *by).sortWithinPartitions(*by)
    return map_batches(dealt, run, "lang string, source string, item string, value long")


def divergences(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(text, lang, source) -> (lang, source, part, item, value, rank); see the module."""
    docs = documents.select("text", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")])
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns(
        {"n_lang": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "head": F.min("source").over(of_term) == F.col("source")}
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    with scratch(documents.sparkSession):
        cells = saved(counts.filter(F.col("docs") >= least_docs).drop("docs"))
        # one row of each term is its head
        langs = cells.filter("head").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
        totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", zero("total"), zero("terms"), zero("total_lang"))
        # a group without kept terms has no share; 1 stands for it, which makes all its pairs 0
        none = share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))
        groups = kept(groups.withColumn("p0", F.when(F.col("terms") > 0, none).otherwise(F.lit(1))))
        shares = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
        q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q")
        shares = saved(shares.select("lang", "source", "term", "n", "p", "p0", q), stays=True)

    # pairs: all V terms as if in neither source, then corrections
    end = lambda source, p0: groups.select("lang", F.col("source").alias(source), F.col("p0").alias(p0), "terms")
    pairs = end("source", "p0").join(end("item", "q0").drop("terms"), "lang").filter("source <> item")
    neither = apart(F.col("p0"), F.col("q0"))
    pairs = kept(pairs.withColumn("neither", neither))
    often = kept(shares.groupBy("lang", "source", "n").agg(F.count("*").alias("often"), F.first("p").alias("p")))
    wide = lambda c: c.cast("decimal(38,0)")
    change = lambda f: wide(F.col("often")) * (f - F.col("neither"))
    own = pairs.join(often, ["lang", "source"]).select("lang", "source", "item", change(apart(F.col("p"), F.col("q0"))).alias("value"))
    others = pairs.join(often.withColumnRenamed("source", "item"), ["lang", "item"])
    others = others.select("lang", "source", "item", change(apart(F.col("p0"), F.col("p"))).alias("value"))
    start = pairs.select("lang", "source", "item", (wide(F.col("terms")) * F.col("neither")).alias("value"))
    both = both_sides(shares).select("lang", "source", "item", wide(F.col("value")).alias("value"))
    every = start.union(own).union(others).union(both)
    of_pair = every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    of_terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(of_pair, "pair").union(ranked(of_terms, "term").filter(F.col("rank") <= top))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), spelt AS (SELECT id, lang, source, unnest(w) AS term FROM docs
), terms AS (
  SELECT lang, term, count(*)::HUGEINT AS n_lang FROM spelt GROUP BY ALL HAVING count(DISTINCT id) >= 3
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total_lang FROM terms GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM spelt JOIN terms USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(total, 0) + v) AS p,
    1 + 1000000000 * (n_lang + 1) // (total_lang + v) AS q
  FROM groups g JOIN terms t ON g.lang = t.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND t.term = c.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), audit AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cells WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM audit
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))
