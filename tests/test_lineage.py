from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from briefspark.operators import lineage as D
from briefspark.operators.ordered import fold_sorted


def drafts(seed: int, chats: int, n: int, families: int) -> list[tuple]:
    """Drafts of some documents each, changed little by little, with copies and unrelated ones."""
    rng, rows = random.Random(seed), []
    for c in range(chats):
        texts = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 30))] for _ in range(families)]
        for at in range(n):
            text = texts[rng.randrange(families)]
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
            rows.append((f"c{c}", at * 3, " ".join(text)))
    return rows


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.9])
def test_groups_give_the_rows_of_the_stream(spark, threshold):
    df = spark.createDataFrame(drafts(int(threshold * 10), 6, 80, 5), "conv_key string, ordinal int, content string")
    stream = D.collapse_lineage(df, threshold).select("conv_key", "slot", "ordinal", "content")
    groups = D.collapse_lineage(df, threshold, by_groups=True).select("conv_key", "slot", "ordinal", "content")
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, stream.collect()))
    assert stream.count() < df.count()


def test_groups_are_connected_parts(spark):
    rng = random.Random(8)
    pairs = [("a", k, k + 1) for k in range(0, 60)] + [("b", *sorted(rng.sample(range(200), 2))) for _ in range(90)]
    root = {}
    for c, a, b in pairs:
        root.setdefault((c, a), a), root.setdefault((c, b), b)
    for _ in pairs:
        for c, a, b in pairs:
            root[c, a] = root[c, b] = min(root[c, a], root[c, b])
    got = D.connected_groups(spark.createDataFrame(pairs, "conv_key string, a int, b int")).collect()
    assert {(r["conv_key"], r["node"]): r["root"] for r in got} == root and len(got) == len(root)
    none = spark.createDataFrame([], "conv_key string, a int, b int")
    assert D.connected_groups(none).count() == 0


def test_one_hot_chat_is_dealt_to_several_tasks(spark, monkeypatch):
    rows = [("hot", n, " ".join(f"f{n % 500}x{k}" for k in range(8)) + f" v{n}") for n in range(5000)]
    df = spark.createDataFrame(rows, "conv_key string, ordinal int, content string")
    parts = []

    def fold(rows, keys, *rest):
        dealt = rows.repartition(*keys).select(F.spark_partition_id().alias("p"))
        parts.extend(r["count"] for r in dealt.groupBy("p").count().collect())
        return fold_sorted(rows, keys, *rest)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(D, "fold_sorted", fold)
    got = D.collapse_lineage(df, 0.6, by_groups=True).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["slot"], r["ordinal"]) for r in got) == [(n, 4500 + n) for n in range(500)]
    assert len(parts) > 4 and max(parts) < 0.4 * sum(parts)
