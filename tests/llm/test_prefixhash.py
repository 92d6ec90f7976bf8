import bisect
import hashlib
import os

from pyspark.sql import functions as F

from briefspark.llm import prefixhash as p
from tests.llm.cases import documents, edge_texts, prose


def test_against_the_texts_themselves(spark):
    got = sorted(map(tuple, p.fingerprints(documents(spark).repartition(5)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "edited_common_prefix", "next_common_prefix").collect()), key=str)
    rows = sorted(edge_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prefix = lambda a, b: len(os.path.commonprefix([a, b]))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), p.fingerprint(p.PrefixHashes(text)), p.fingerprint(p.PrefixHashes(edited)), prefix(text, edited), prefix(text, after)))
    assert got == sorted(want, key=str)


def test_spans_and_extensions():
    one, two = p.PrefixHashes("xxabcdefgh"), p.PrefixHashes("yabcdefghz")
    assert one.span(2, 9) == two.span(1, 8) != two.span(2, 9)
    assert p.common_prefix(one, two, 2, 1) == 8 and p.common_prefix(one, two) == 0
    assert p.common_prefix(one, two, 10, 3) == 0


def test_likeness_is_about_the_common_share():
    a, b = prose(1, 2000), prose(2, 2000)[::-1]  # few words, but read backwards
    mixed = a[: len(a) // 2] + b[: len(a) // 2]
    f = lambda t: p.fingerprint(p.PrefixHashes(t))
    assert p.likeness(f(a), f(a)) == 1 and p.likeness(f(a), f(b)) < 0.1
    assert 0.3 < p.likeness(f(a), f(mixed)) < 0.7
    assert p.likeness(f(""), f("")) == 1 and p.likeness(f(""), f("x")) == 0


def test_range_by_binary_search(spark):
    for count in (1, 2, 3, 4, 7, 8, 9, 100):
        borders = [7 * n - 40 for n in range(count)]
        rows = spark.range(-60, 720, 3).select(F.col("id").alias("k"))
        found = rows.select("k", p.range_of(F.array(*map(F.lit, borders)).cast("array<long>"), F.col("k"), count).alias("n"))
        assert all(r["n"] == bisect.bisect_left(borders, r["k"]) for r in found.collect())


def test_one_document_and_none(spark):
    row = p.fingerprints(documents(spark, [(5, "alone")])).first()
    assert row["near_next"] == 1 and row["next_common_prefix"] == 5
    assert p.fingerprints(documents(spark, [])).count() == 0
