"""Transcript text and its cut into chunks for a model.

Chunking is greedy: a unit opens a new chunk when it no longer fits.  That is an
ordered fold over a whole conversation, but all a stretch of units needs to know
about what came before is how full the open chunk is.  So a conversation is cut
into blocks of ``BLOCK_CHUNKS`` budgets of text, each block is summarised as a
short table "entry fill -> (chunks opened, exit fill)", the summaries are chained
per conversation, and the blocks then number their units in parallel.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.operators.lineage import collapse_lineage
from briefspark.operators.ordered import Rule, assemble, block_of, fold_sorted, running

BLOCK_CHUNKS = 1024
UNIT_ORDER = ["src", "ordinal"]


def message_unit(role: Column, text: Column) -> Column:
    who = F.when(role == "assistant", F.lit("Assistant")).otherwise(F.lit("User"))
    return F.concat(F.lit("### "), who, F.lit("\n"), text)


def artifact_unit(name: Column, language: Column, content: Column) -> Column:
    lang = F.coalesce(F.concat(F.lit(" ("), F.nullif(language, F.lit("")), F.lit(")")), F.lit(""))
    return F.concat(F.lit("### Artifact: "), name, lang, F.lit("\n```\n"), content, F.lit("\n```"))


def transcript_units(
    messages: DataFrame, artifacts: DataFrame | None = None, collapsed: bool = False
) -> DataFrame:
    """Ordered text units (conv_key, src, ordinal, text): messages, then artifacts."""
    units = messages.filter(F.length("text") > 0).select(
        "conv_key",
        F.lit(0).alias("src"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        message_unit(F.col("role"), F.col("text")).alias("text"),
    )
    if artifacts is None:
        return units
    final = artifacts if collapsed else collapse_lineage(artifacts)
    return units.unionByName(
        final.select(
            "conv_key",
            F.lit(1).alias("src"),
            F.col("slot").cast("bigint").alias("ordinal"),
            artifact_unit(
                F.coalesce("filename", "title", "artifact_id"), F.col("language"), F.col("content")
            ).alias("text"),
        )
    )


RULES = {0: Rule(sep="\n\n"), 1: Rule(sep="\n\n", lead="\n\n")}


def render_transcript(units: DataFrame) -> DataFrame:
    """Units joined by a blank line -> (conv_key, part, text)."""
    coded = units.select("conv_key", F.col("src").alias("code"), "src", "ordinal", F.lit(0).alias("pos"), "text")
    return assemble(coded, RULES).drop("last")


def transcript_chars(units: DataFrame) -> DataFrame:
    """Length of the rendered transcript without building it."""
    return units.groupBy("conv_key").agg(
        (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).cast("bigint").alias("full_chars")
    )


# -- the greedy cut -----------------------------------------------------------------


def fill(costs, budget: int, load: int) -> tuple[list[int], int]:
    """Chunk number of each unit (relative to the open chunk) and the exit fill."""
    numbers, n = [], 0
    for cost in costs:
        if load + cost > budget and load > 0:
            n, load = n + 1, 0
        load += cost
        numbers.append(n)
    return numbers, load


def transfer(costs, budget: int) -> list[tuple[int, int, int, bool]]:
    """Pieces (entry fill from, chunks opened, exit, adds entry) of a block.

    Up to a certain entry fill the whole block still fits and the exit is entry
    plus block.  Above it, the first unit that does not fit depends on the entry,
    and everything after that unit no longer does.
    """
    costs = [int(c) for c in costs]
    ends = [0, *accumulate(costs)]
    n = len(costs)
    after: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for p in range(n - 1, -1, -1):  # a chunk opened by unit p
        q = max(bisect_right(ends, ends[p] + budget) - 1, p + 1)
        after[p] = (1, ends[n] - ends[p]) if q >= n else (after[q][0] + 1, after[q][1])
    # an empty open chunk only occurs before the first block: unit 0 fills it
    pieces = [(0, after[0][0] - 1, after[0][1], False), (1, 0, ends[n], True)]
    for p in range(n - 1, -1, -1):
        lowest = max(budget - ends[p + 1] + 1, 1)
        if ends[p] >= budget + 1:
            continue
        opened, exit_fill = after[p]
        if pieces[-1][0] == lowest:
            pieces[-1] = (lowest, opened, exit_fill, False)
        elif not pieces[-1][3] and pieces[-1][1:3] == (opened, exit_fill):
            continue
        else:
            pieces.append((lowest, opened, exit_fill, False))
    return pieces


class _Chain:
    """What each block of one conversation is entered with: the fill, and the chunks before."""

    def __init__(self) -> None:
        self.load = self.base = 0
        self.entered: list[tuple[int, int, int]] = []  # (block, load, base)

    def add(self, block, pieces) -> None:
        self.entered.append((block, self.load, self.base))
        hit = [p for p in pieces if p["entry"] <= self.load][-1]
        self.load = self.load + hit["exit"] if hit["adds"] else hit["exit"]
        self.base += hit["opened"]

    def rows(self) -> list[tuple]:
        return self.entered


_PIECES = "array<struct<entry:bigint,opened:bigint,exit:bigint,adds:boolean>>"


def chunk_numbers(units: DataFrame, max_chars: int = K.CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(conv_key, src, ordinal, chunk_ord): which chunk each unit belongs to."""
    key_type = dict(units.dtypes)["conv_key"]
    cost = (F.length("text") + 2).cast("bigint")
    sized = units.select("conv_key", *UNIT_ORDER, cost.alias("cost")).withColumn(
        "__cut", block_of("ordinal")
    )
    placed = running(sized, ["conv_key"], ["src", "__cut"], ["ordinal"], sums={"__end": F.col("cost")})
    blocks = (
        placed.withColumn(
            "block", F.floor((F.col("__end") - F.col("cost")) / (max_chars * block_chunks)).cast("bigint")
        )
        .groupBy("conv_key", "block")
        .agg(F.array_sort(F.collect_list(F.struct(*UNIT_ORDER, "cost"))).alias("u"))
    )

    @F.pandas_udf(_PIECES)
    def summary(costs: pd.Series) -> pd.Series:
        return costs.map(
            lambda c: [
                {"entry": e, "opened": o, "exit": x, "adds": a} for e, o, x, a in transfer(c, max_chars)
            ]
        )

    @F.pandas_udf("array<bigint>")
    def numbering(costs: pd.Series, load: pd.Series) -> pd.Series:
        return pd.Series([fill([int(x) for x in c], max_chars, int(l))[0] for c, l in zip(costs, load)])

    # a conversation of one block, block 0, enters it with nothing: only longer ones are chained
    several = (
        blocks.select("conv_key", "block", F.transform("u", lambda x: x["cost"]).alias("costs"))
        .withColumn("__last", F.max("block").over(Window.partitionBy("conv_key")))
        .filter("__last > 0")
        .select("conv_key", "block", summary("costs").alias("pieces"))
    )
    schema = f"conv_key {key_type}, block bigint, load bigint, base bigint"
    entries = fold_sorted(several, ["conv_key"], ["block"], schema, _Chain)
    numbered = (
        blocks.join(entries, ["conv_key", "block"], "left")
        .withColumn("load", F.coalesce("load", F.lit(0)))
        .withColumn("base", F.coalesce("base", F.lit(0)))
        .select(
            "conv_key",
            "base",
            F.arrays_zip(
                F.col("u"), numbering(F.transform("u", lambda x: x["cost"]), F.col("load")).alias("n")
            ).alias("z"),
        )
        .select("conv_key", "base", F.explode("z").alias("z"))
    )
    return numbered.select(
        "conv_key",
        F.col("z.u.src").alias("src"),
        F.col("z.u.ordinal").alias("ordinal"),
        (F.col("base") + F.col("z.n")).alias("chunk_ord"),
    )


def chunk_transcript(units: DataFrame, max_chars: int = K.CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(conv_key, chunk_ord, text); a unit is never cut, an oversized one stays whole."""
    piece = F.struct(*UNIT_ORDER, "text")
    return (
        units.join(chunk_numbers(units, max_chars, block_chunks), ["conv_key", *UNIT_ORDER])
        .groupBy("conv_key", "chunk_ord")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(piece)), lambda u: u["text"]), "\n\n"
            ).alias("text")
        )
    )
