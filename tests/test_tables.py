from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from briefspark.operators import reconcile as R

ITEMS = "conv_key string, src int, ordinal bigint, pos int, kind string, label string, value string, language string"


def items(rows):
    return [(c, 1, at, 0, kind, "t", value, None) for c, at, kind, value in rows]


def cases(seed: int, chats: int, n: int) -> tuple[list, list]:
    """(model, extracted): tables of shared and own words, copies, parts of others, empty ones."""
    rng, model, found = random.Random(seed), [], []
    for c in range(chats):
        bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] for _ in range(6)]
        for at in range(n):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            if rng.random() < 0.3:
                words = words[: rng.randrange(len(words) + 1)] + ["more"] * rng.randrange(2)
            row = (f"c{c}", at, "table" if rng.random() < 0.9 else "code", " | ".join(words))
            (model if rng.random() < 0.1 else found).append(row)
    return items(model), items(found)


def both_ways(spark, model, found, threshold, rounds):
    m, f = spark.createDataFrame(model, ITEMS), spark.createDataFrame(found, ITEMS)
    stream = R.guarantee_tables(m, f, threshold)
    sides = R.guarantee_tables(m, f, threshold, in_rounds=True, rounds=rounds)
    return sorted(map(tuple, stream.collect()), key=str), sorted(map(tuple, sides.collect()), key=str)


@pytest.mark.parametrize("threshold,rounds", [(0.8, R.ROUNDS), (0.8, 1), (0.55, 2), (1.0, 3)])
def test_rounds_add_the_tables_of_the_stream(spark, threshold, rounds):
    model, found = cases(int(threshold * 100) + rounds, 5, 70)
    stream, sides = both_ways(spark, model, found, threshold, rounds)
    assert sides == stream and len(model) < len(sides) < len(model) + len(found)


@pytest.mark.parametrize("rounds", [0, 2, R.ROUNDS])
def test_a_chain_of_tables_alternates(spark, rounds):
    """Each table overlaps with its neighbours only: every other one is added."""
    chain = [("hot", n, "table", " ".join(f"x{k}" for k in range(n * 2, n * 2 + 10))) for n in range(41)]
    stream, sides = both_ways(spark, [], items(chain), 0.8, rounds)
    assert sides == stream and [r[2] for r in sorted(sides, key=lambda r: r[2])] == list(range(0, 41, 2))


def test_no_tables_and_no_tokens(spark):
    stream, sides = both_ways(spark, [], [], 0.8, 3)
    assert sides == stream == []
    blank = items([("a", 0, "table", "| - |"), ("a", 1, "table", "| - |"), ("b", 0, "table", "x"), ("b", 1, "table", "X !")])
    stream, sides = both_ways(spark, items([("a", 9, "table", "|"), ("b", 9, "code", "x")]), blank, 0.8, 3)
    assert sides == stream and len(sides) == 2 + 3


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    sets = {(c, f"{n:04d}"): frozenset(rng.sample(range(25), rng.randrange(1, 12))) for c in "ab" for n in range(60)}
    distinct = {(c, s): n for (c, n), s in reversed(sets.items())}
    rows = [(c, n, sorted(s)) for (c, s), n in distinct.items()]
    for threshold in (0.55, 0.7, 0.8):
        want = {
            (c, min(a, b), max(a, b))
            for c, a, x in rows
            for d, b, y in rows
            if c == d and a != b and len(set(x) & set(y)) / min(len(x), len(y)) >= threshold
        }
        got = R.overlapping_sets(spark.createDataFrame(rows, "conv_key string, node string, tokens array<int>"), threshold)
        assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_one_hot_chat_is_settled_in_several_tasks(spark):
    """20,000 tables of one chat, four that overlap at a time: their pairs lie in many partitions."""
    words = F.concat_ws(" ", *[F.format_string(f"k%dx{n}", F.floor(F.col("id") / 4)) for n in range(9)], F.format_string("own%d", "id"))
    found = spark.range(20_000).select(
        F.lit("hot").alias("conv_key"), F.lit(1).alias("src"), F.col("id").alias("ordinal"), F.lit(0).alias("pos"), F.lit("table").alias("kind"),
        F.lit("t").alias("label"), words.alias("value"), F.lit(None).cast("string").alias("language"),
    )
    none = found.limit(0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokens = F.transform(F.split("value", " "), lambda t: F.xxhash64(t))
    sets = found.select("conv_key", F.lpad(F.col("ordinal").cast("string"), 6, "0").alias("node"), tokens.alias("tokens"))
    parts = R.overlapping_sets(sets, 0.8).groupBy(F.spark_partition_id()).count().collect()
    added = {r["ordinal"] for r in R.guarantee_tables(none, found, in_rounds=True).select("ordinal").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert added == set(range(0, 20_000, 4))
    assert sum(r["count"] for r in parts) == 5_000 * 6 and len(parts) > 4 and max(r["count"] for r in parts) < 0.4 * 30_000
