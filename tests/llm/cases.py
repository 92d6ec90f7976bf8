"""Small tables with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import random

#: Names that operators use inside; the awkward tables have columns of these names.
CLASHING = "uid fp key k row places hits bucket uids score lang_pred digest size range at borrowed turns example block shard".split()

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "é"]) for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None]]:
    long = prose(1, 30_000)
    shared = prose(2, 60)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "a b c"), (5, "a b c"), (5, "other text of one id"),
        (None, "null id"), (None, None), (6, long), (7, "aaaa" * 20_000), (8, shared), (9, "front " + shared),
        (10, shared + " back"), (11, " nbsp wide　x\x1cy\x85z"), (12, "\U0001f600 漢字 ё ١٢٣"),
        (13, "<|endoftext|> and <|im_end|> \\s \\p"), (-4, shared.upper()), (14, "12 34 %%%"),
    ]


def documents(spark, rows=None, extra: bool = True):
    rows = edge_texts() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit("clash") for name in CLASHING})
    return df


def least_reachable(n: int, linked) -> list[int]:
    """The least index that each index reaches."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]
