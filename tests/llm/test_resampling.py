import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefspark.llm import resampling
from tests.llm.cases import CLASHING, documents, edge_texts, prose


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[a : a + n]).encode()) % 10_000 for n in (1, 2, 3) for a in range(len(w) - n + 1)]


def brute(rows, target):
    """(doc_id, n_features, weight, score, rank) of all rows, in the operator's order of ties."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in features_of(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10_000.0) / ((a + 1.0) * (sum(t) + 10_000.0)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        found = features_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words_of(text)) >= 20])
    drawn = sorted((r for r in out if r[-1]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for n, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_against_brute_force(spark):
    rows = edge_texts() + [(n // 2, prose(n // 3, 5 + n % 40) + " ÀÉ Ünï") for n in range(300)]
    target = ["lorem ipsum dolor", None, prose(1, 50)]
    bench = spark.createDataFrame([(t,) for t in target], "text string").withColumns({c: F.lit(1) for c in CLASHING})
    got = collected(resampling.resample(documents(spark, rows), bench))
    assert got == brute(rows, target) and sum(r[4] is not None for r in got) >= 10


def test_more_than_one_block_and_digit(spark, monkeypatch):
    monkeypatch.setattr(resampling.radix_sorted, "__defaults__", (4, 16))
    rows = [(n % 90, prose(n % 70, 25 + n % 7)) for n in range(400)]
    assert collected(resampling.resample(documents(spark, rows), documents(spark, rows[:9]))) == brute(rows, [t for _, t in rows[:9]])


@pytest.mark.parametrize("digit", [1, 5, 12])
def test_radix_sort_of_extreme_keys(spark, digit):
    rng = random.Random(digit)
    edge = [-(2**63), 2**63 - 1, 0, -1, 1]
    rows = [(rng.choice(edge), rng.randrange(3), n) for n in range(200)] if digit == 12 else [(rng.randrange(-9, 9), rng.randrange(3), n) for n in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    got = resampling.radix_sorted(df, ["a", "b", "c"], digit, 16).collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["place"])] == sorted(rows)
    assert sorted(r["place"] for r in got) == list(range(200))


def test_digit_plan_covers_every_bit_once():
    rng = random.Random(7)
    for _ in range(50):
        spans = [rng.choice([0, 1, 5, 2**40 + 3, 2**64 - 1]) for _ in range(3)]
        values = [rng.randrange(x + 1) for x in spans]
        parts = [np.array([v], np.uint64) for v in values]
        whole = 0
        for n, pieces in enumerate(resampling.digit_plan(spans, 11)):
            whole |= int(resampling.digits(parts, pieces)[0]) << 11 * n
        want = 0
        for v, x in zip(values, spans):
            want = want << x.bit_length() | v
        assert whole == want


def test_nothing_to_draw(spark):
    none = documents(spark, [])
    assert resampling.resample(none, none).count() == 0
    short = documents(spark, [(1, "few words"), (2, None)])
    got = resampling.resample(short, none).collect()
    assert [r["rank"] for r in got] == [None, None] and {r["weight"] for r in got if r["doc_id"] == 2} == {0}
    eighteen = documents(spark, [(n, prose(n, 30)) for n in range(18)])
    assert resampling.resample(eighteen, none).filter("rank is not null").count() == 0
