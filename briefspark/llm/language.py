"""Language identification by rank-order n-gram profiles.

A profile is the list of the PROFILE most frequent n-grams of 1 to LONGEST characters of
words (runs of letters, lower case, a blank at either end), most frequent first.  The distance
of a document to a language is the sum, over the n-grams of the document's profile, of how far
each is out of place in the language's profile; an n-gram that is not in it counts PROFILE.
The nearest language wins.

The score is 1 minus the distance to the nearest language over the greatest possible one.

Learning: the n-grams of all documents with a language that are not held out.  Tasks count those of
some SLICE_CHARS characters of a language at a time, Spark adds them up per (language, n-gram); only
the profiles, PROFILE n-grams for each language, reach the driver and go back with the tasks.

Limits (``limits``): what scores and leads tell is learned from all labelled documents that
are held out and nearest to the language of their label.  A text is in no learned
language if its score lies more than SPREADS standard deviations below their mean; scores that
lie as far out themselves (junk) do not count.  A label is wrong if another language leads
it by more than half of what the right one leads the others by on average.  Texts of fewer than
JUDGED n-grams (two short words) are too short to judge, in whatever script, and stay; longer ones in
a script that was not learned score 0 and go.  Fewer than LEAST_DOCS documents set no limit.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything if
there is nothing to learn from; a text of which no n-gram is in any profile is equally far from
all languages and has score 0; equal counts rank by the n-gram's number; equal distances go to the
language that comes first;
repeated rows and null ids stay (a null id is not held out); columns other than doc_id, text
and lang are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefspark.llm.common import map_batches, table

PROFILE, LONGEST = 300, 3
#: Text of a language whose n-grams are counted at once.
SLICE_CHARS = 1 << 20
UNDECIDED = "und"
#: See limits; a word of n letters has 3 n + 1 n-grams.
SPREADS, JUDGED, LEAST_DOCS = 5, 24, 30
#: Bits of a character in the number of an n-gram; 1 stands for the blank.
BITS, BLANK = 21, 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams_of(text: str) -> np.ndarray:
    """The n-grams of all words of a text as numbers: characters in BITS bits each."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[codes]
    if not known.any():
        return np.empty(0, np.int64)
    line = np.full(len(codes) + 2, BLANK, np.int64)
    line[1:-1] = np.where(known, codes.astype(np.int64) + BLANK + 1, BLANK)
    line = line[np.append(True, (line[1:] != BLANK) | (line[:-1] != BLANK))]  # one blank between words
    found = [line[line != BLANK]]
    for n in range(2, LONGEST + 1):
        gram = line[: len(line) - n + 1].copy()
        inside = np.ones(len(gram), bool)  # a blank only at the ends
        for k in range(1, n):
            part = line[k : len(line) - n + 1 + k]
            gram = gram << BITS | part
            if k < n - 1:
                inside &= part != BLANK
        found.append(gram[inside])
    return np.concatenate(found)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ngrams_of(text), return_counts=True)


def profile_of(text: str) -> np.ndarray:
    """The PROFILE most frequent n-grams of a whole text, equal counts by number."""
    ngrams, counts = counts_of(text)
    if len(counts) > PROFILE:
        often = counts >= np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        ngrams, counts = ngrams[often], counts[often]
    return ngrams[np.lexsort((ngrams, -counts))[:PROFILE]]


class Profiles:
    """The places of n-grams in the profiles of all languages."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.ngrams = np.array(sorted({g for profile in ranked.values() for g in profile}), np.int64)
        self.places = np.full((len(self.ngrams), len(ranked)), -1, np.int64)
        for n, language in enumerate(self.languages):
            rows = np.searchsorted(self.ngrams, ranked[language])
            self.places[rows, n] = np.arange(len(rows))

    def scores(self, profile: np.ndarray) -> np.ndarray | None:
        """The score of every language; none without a letter, or if nothing was learned."""
        if not len(profile) or not len(self.ngrams):
            return None
        rows = np.minimum(np.searchsorted(self.ngrams, profile), len(self.ngrams) - 1)
        known = self.ngrams[rows] == profile
        places = np.where(known[:, None], self.places[rows], -1)
        apart = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(rows))[:, None])).sum(0)
        return 1 - apart / (PROFILE * len(profile))

    def nearest(self, profile: np.ndarray) -> tuple[str, float]:
        scores = self.scores(profile)
        if scores is None:
            return UNDECIDED, 0.0
        return self.languages[int(scores.argmax())], float(scores.max())


def learn(labelled: DataFrame) -> Profiles:
    """(doc_id, text, lang) with a language each -> profiles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        sizes: Counter = Counter()

        def slice_of(lang: str) -> pa.RecordBatch:
            # no n-gram goes over a blank
            ngrams, counts = counts_of(" ".join(held.pop(lang)))
            sizes.pop(lang)
            columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(ngrams), np.int64))), pa.array(ngrams), pa.array(counts.astype(np.int64))]
            return pa.record_batch(columns, ["lang", "ngram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text or "")
                sizes[lang] += len(text or "") + 1
                if sizes[lang] >= SLICE_CHARS:
                    yield slice_of(lang)
                elif sizes.total() >= 4 * SLICE_CHARS:  # very many languages
                    yield slice_of(max(sizes, key=sizes.get))
        for lang in list(held):
            yield slice_of(lang)

    totals = map_batches(labelled.select("lang", "text"), count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    # tasks rank what they hold before they send it: none sorts a whole language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    best = totals.withColumn("place", place).filter(F.col("place") <= PROFILE).orderBy("lang", "place").collect()
    ranked: dict[str, list[int]] = {}
    for r in best:
        ranked.setdefault(r["lang"], []).append(r["ngram"])
    return Profiles(ranked)


def predict(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """documents plus lang_pred and score (columns of these names are replaced)."""
    documents = documents.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(profile_of(t or "")) for t in batch.column("text").to_pylist()]
            names, scores = zip(*found) if found else ((), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(documents, run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned_from(documents: DataFrame) -> Profiles:
    """Profiles from the documents that have a language and are not held out."""
    train = documents.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))
    return learn(train.filter(F.col("lang").isNotNull()))


class Limits(NamedTuple):
    """The least score of a learned language, and the greatest lead over a right label."""

    score: float = 0.0
    lead: float = 1.0


def limits(documents: DataFrame, profiles: Profiles) -> Limits:
    """Limits from the labelled documents that are held out; counts of rounded scores and a
    sum of leads reach the driver."""
    labelled = documents.select("doc_id", "text", "lang").filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                profile = profile_of(text or "")
                scores = profiles.scores(profile) if len(profile) >= JUDGED else None
                if scores is None or lang not in profiles.languages:
                    continue
                own = profiles.languages.index(lang)
                if own != scores.argmax():
                    continue
                others = np.delete(scores, own)
                found.append((round(float(scores[own]), 3), float(scores[own] - others.max()) if len(others) else 1.0))
            columns = [pa.array(x, pa.float64()) for x in (list(zip(*found)) or [(), ()])]
            yield pa.record_batch(columns, ["score", "lead"])

    measured = map_batches(labelled.select("lang", "text"), measure, "score double, lead double")
    table = measured.groupBy("score").agg(F.count("*").alias("n"), F.sum("lead").alias("lead")).collect()
    score, n, lead = (np.array([r[c] for r in table], float) for c in ("score", "n", "lead"))
    if n.sum() < LEAST_DOCS:
        return Limits()
    least, within = -np.inf, np.ones(len(n), bool)
    while True:
        mean = np.average(score[within], weights=n[within])
        bound = mean - SPREADS * np.sqrt(np.average((score[within] - mean) ** 2, weights=n[within]))
        if bound <= least:
            break
        least, within = bound, score >= bound - 1e-9
    return Limits(max(0.0, float(least)), max(0.0, float(lead[within].sum() / n[within].sum())) / 2)


def identify(documents: DataFrame, profiles: Profiles, limit: Limits) -> DataFrame:
    """The documents in a learned language, with ``lang`` filled in or put right."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay, langs = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                profile = profile_of(text or "")
                scores = profiles.scores(profile)
                if scores is None or len(profile) >= JUDGED and scores.max() < limit.score:
                    stay.append(False)
                    continue
                stay.append(True)
                best = int(scores.argmax())
                if lang in profiles.languages and len(profile) >= JUDGED:
                    wrong = scores[best] - scores[profiles.languages.index(lang)] > limit.lead
                    lang = profiles.languages[best] if wrong else lang
                langs.append(profiles.languages[best] if lang is None else lang)
            rows = batch.filter(pa.array(stay, pa.bool_()))
            columns = [pa.array(langs, pa.string()) if name == "lang" else rows.column(name) for name in names]
            yield pa.record_batch(columns, names)

    return map_batches(documents, run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents.select("doc_id", "text"), learned_from(documents)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
