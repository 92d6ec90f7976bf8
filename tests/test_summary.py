from __future__ import annotations

import random
from bisect import bisect_left, bisect_right

from briefspark.operators import evaluate as V

CARD = "id long, full_chars long, brief_chars long, reduction double"


def cards(spark, n: int, seed: int = 1):
    rng = random.Random(seed)
    rows = [(k, 100, 10, rng.choice([0.5, rng.random() ** 3, rng.gauss(0, 2)])) for k in range(n)]
    platforms = spark.createDataFrame([(k, "abc"[k % 7 % 3]) for k in range(n)], "conv_key long, platform string")
    return rows, spark.createDataFrame(rows, CARD), platforms


def test_quantiles_keep_their_error_over_batches(spark):
    rows, card, platforms = cards(spark, 30_000)
    k, ranks = 200, (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    batches = [V.summary_parts(card.filter(f"id % 9 = {n}"), platforms, k) for n in range(9)]
    parts = batches[0]
    for more in batches[1:]:
        parts = parts.union(more)
    full = {r["platform"]: r for r in V.summed_parts(V.summary_parts(card, platforms, k), k, ranks).collect()}
    rolled = {r["platform"]: r for r in V.summed_parts(parts, k, ranks).collect()}
    assert set(full) == set(rolled) == {None, "a", "b", "c"}
    for name, got in rolled.items():
        values = sorted(x[3] for x in rows if name in (None, "abc"[x[0] % 7 % 3]))
        assert got["conversations"] == full[name]["conversations"] == len(values) and got["full_chars"] == 100 * len(values)
        for found in (got, full[name]):
            assert found["rank_error"] == V.rank_error(k) < 0.014
            for rank, value in zip(ranks, found["quantiles"]):
                low, high = bisect_left(values, value) / len(values), bisect_right(values, value) / len(values)
                # the bound holds for 99 of 100; twice of it leaves the test steady
                assert low - 2 * V.rank_error(k) <= rank <= high + 2 * V.rank_error(k)


def test_small_parts_are_exact_and_nulls_do_not_count(spark):
    card = spark.createDataFrame([(1, 5, 1, 0.5), (2, 5, 1, None), (3, 5, 1, 0.1), (4, 5, 1, 0.9), (5, 5, 1, None)], CARD)
    platforms = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b")], "conv_key long, platform string")
    got = {r["platform"]: (r["conversations"], r["quantiles"]) for r in V.summed_parts(V.summary_parts(card, platforms)).collect()}
    assert got == {"a": (4, [0.1, 0.5, 0.9]), "b": (1, None), None: (5, [0.1, 0.5, 0.9])}
    none = V.summed_parts(V.summary_parts(card.limit(0), platforms)).collect()
    assert [r["platform"] for r in none] in ([], [None])
