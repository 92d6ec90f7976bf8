from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from briefspark.operators import parity as P
from briefspark.operators.ordered import BLOCK_BITS

NAMES = ["a", "b", "c", "d", "e"]
ENTRIES = "platform string, conv_key string, ordinal long, kind string, pos int, role string, text string"


def by_hand(rows):
    """The first differences, over all entries and without digests."""
    has = {}
    for name, c, ordinal, kind, pos, role, text in rows:
        has.setdefault((c, ordinal, kind, pos), {})[name] = (role, text)
    first = {}
    for (c, ordinal, kind, pos), here in sorted(has.items()):
        best, n = min(Counter(here.values()).items(), key=lambda x: (-x[1], x[0]))
        usual = best if n >= len(NAMES) - len(here) else None
        for name in NAMES:
            mine = here.get(name)
            if mine == usual:
                continue
            what = "missing" if mine is None else "extra" if usual is None else "role" if mine[0] != usual[0] else "text"
            first.setdefault((c, name, kind), (c, name, kind, ordinal, pos, what))
    return set(first.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_descent_finds_what_a_full_comparison_finds(spark, seed):
    rng, rows = random.Random(seed), []
    for c in range(30):
        for ordinal in rng.sample(range(3 << BLOCK_BITS), 40):
            for name in NAMES:
                if c % 3 and rng.random() < 0.01:
                    continue
                odd = c % 3 and rng.random() < 0.02
                role = "human" if odd and rng.random() < 0.5 else "assistant"
                rows.append((name, f"k/{c}", ordinal, rng.choice(["message"] * 30 + ["table"]) if odd else "message", 0, role, f"t{ordinal}" + "!" * bool(odd)))
    entries = spark.createDataFrame(rows, ENTRIES)
    got = P.first_differences(entries, NAMES).collect()
    assert {tuple(r) for r in got} == by_hand(rows) and len(got) == len(by_hand(rows)) > 10
    opened = P.open_blocks(entries.withColumn("block", entries.ordinal), len(NAMES))
    chats = {r["conv_key"] for r in opened.collect()}
    assert chats == {c for c, *_ in by_hand(rows)} and not any(c == f"k/{n}" for c in chats for n in range(0, 30, 3))


TABLE = "| item | price |\n|---|---|\n| tea | 3 |\n| milk | 2 |"
CODE = "```python\nprint(1)\nprint(2)\n```"


def chat(spark, key, *texts):
    rows = [(key, n * 2, "human" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_key string, ordinal long, role string, text string")


def test_tables_and_code_of_messages(spark):
    texts = ["Show it", f"Here\n\n{TABLE}\n\nand\n\n{CODE}\n", "Thanks"]
    good = chat(spark, "x", *texts)
    bad = chat(spark, "x", texts[0], texts[1].replace("| 2 |", "| 5 |"), texts[2])
    lost = chat(spark, "x", texts[0], f"Here\n\n{TABLE}\n", texts[2])
    got = {tuple(r) for r in P.parity_differences({"good": good, "fine": good, "bad": bad, "lost": lost, "also": good}).collect()}
    assert got == {
        ("x", "bad", "message", 1, 0, "text"),
        ("x", "lost", "message", 1, 0, "text"),
        ("x", "lost", "code", 1, 0, "missing"),
        ("x", "bad", "table", 1, 0, "text"),
    }
    assert P.parity_differences({"one": good, "two": good}).count() == 0


def test_nulls_missing_chats_and_nothing(spark):
    good, none = chat(spark, "x", "a", None, "c"), chat(spark, "x")
    got = {tuple(r) for r in P.parity_differences({"p": good, "q": good, "r": none, "s": chat(spark, "x", "a", "", "c", "more")}).collect()}
    assert got == {("x", "r", "message", 0, 0, "missing"), ("x", "s", "message", 1, 0, "text")}
    assert P.parity_differences({"p": none, "q": none}).count() == 0


def test_messages_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def tell(x):
        made.add(1)
        return x

    told = F.udf(tell, "string").asNondeterministic()
    chat = [("x", n, "user", f"text {n}") for n in range(20)]
    good = spark.createDataFrame(chat, "conv_key string, ordinal long, role string, text string")
    found = P.parity_differences({"p": good.withColumn("text", told("text")), "q": good, "r": good.filter("ordinal < 15")}, facts=False)
    assert [tuple(r) for r in found.collect()] == [("x", "r", "message", 15, 0, "missing")]
    assert made.value == 20
