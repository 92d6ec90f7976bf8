"""Order-aware building blocks that never bring a whole conversation together.

A conversation can be any share of the table, so a window or a collected list
over the conversation key alone would put that share into one task.  Everything
here works in two levels instead: rows are spread over blocks of bounded size
(``block_of`` cuts the message ordinal every ``BLOCK`` messages), each block is
scanned on its own, and only one small row per block is combined per
conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.functions.text import js_rtrim

BLOCK_BITS = 10
#: Characters at which a block of texts is closed before its ``BLOCK`` units are full.
BLOCK_CHARS = 1 << 22
PART_CHARS = 1 << 22


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The checkpoint directory of the session: the one that the configuration names, or
    the one that was set on the context."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def hold(df: DataFrame) -> DataFrame:
    """A result that several steps read: checkpointed where there is a folder for it, else cached."""
    return df.checkpoint() if checkpoint_folder(df.sparkSession) else df.persist()


def block_of(ordinal: str | Column) -> Column:
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.shiftright(col.cast("bigint"), BLOCK_BITS)


def first_wins(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """One row per key: the first one by ``order``.

    A plain ``min`` over a struct, so copies of a key are reduced before the
    shuffle and a key with very many copies costs one row per map task.
    """
    return _pick(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last one by ``order``."""
    return _pick(df, keys, order, F.max)


def _pick(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    picked = df.groupBy(*keys).agg(pick(row).alias("__row"))
    return picked.select(
        *[
            F.col(c) if c in keys else F.col("__row")[c].alias(c)
            for c in df.columns
        ]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima over the whole key, in two levels.

    ``blocks`` are columns that cut the key into bounded, ordered pieces:
    sorting by ``blocks`` then ``order`` must be the order of the key.
    """
    sums, maxima = sums or {}, maxima or {}
    names = {**{n: (F.sum, c) for n, c in sums.items()}, **{n: (F.max, c) for n, c in maxima.items()}}
    inner = (
        Window.partitionBy(*keys, *blocks)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(*blocks)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.select("*", *[f(c).over(inner).alias(f"__in_{n}") for n, (f, c) in names.items()])
    totals = df.groupBy(*keys, *blocks).agg(
        *[f(c).alias(f"__all_{n}") for n, (f, c) in names.items()]
    )
    offsets = totals.select(
        *keys,
        *blocks,
        *[f(f"__all_{n}").over(before).alias(f"__off_{n}") for n, (f, _) in names.items()],
    )
    out = local.join(offsets, [*keys, *blocks], "left")
    final = [
        (F.col(f"__in_{n}") + F.coalesce(F.col(f"__off_{n}"), F.lit(0))).alias(n) for n in sums
    ] + [F.greatest(f"__in_{n}", f"__off_{n}").alias(n) for n in maxima]
    return out.select(*df.columns, *final)


def previous(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Add ``prev``: the row before within the key, as a struct of its columns.

    The input is read twice, for the rows and for the last row of each block; give
    narrow rows.
    """
    row = F.struct(ordinal, *[c for c in df.columns if c not in (*keys, ordinal)])
    cut = df.withColumn("__block", block_of(ordinal)).repartition(*keys, "__block")
    inner = Window.partitionBy(*keys, "__block").orderBy(ordinal)
    across = Window.partitionBy(*keys).orderBy("__block")
    local = cut.withColumn("__prev", F.lag(row).over(inner))
    tails = cut.groupBy(*keys, "__block").agg(F.max(row).alias("__tail"))
    heads = tails.select(*keys, "__block", F.lag("__tail").over(across).alias("__before"))
    return (
        local.join(heads, [*keys, "__block"], "left")
        .withColumn("prev", F.coalesce("__prev", "__before"))
        .drop("__block", "__prev", "__before")
    )


def dense_ordinal(df: DataFrame, keys: Sequence[str], ordinal: str, name: str) -> DataFrame:
    """Number the rows of a key from 0 without gaps, by a unique ordinal."""
    cut = df.withColumn("__block", block_of(ordinal))
    numbered = running(cut, keys, ["__block"], [ordinal], sums={"__n": F.lit(1).cast("bigint")})
    return numbered.select(*df.columns, (F.col("__n") - 1).alias(name))


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str,
    make: Callable[[], Any],
) -> DataFrame:
    """An ordered fold per key, for rules that depend on everything before.

    ``make()`` gives a state with ``add(*other columns)`` and ``rows()``, a list of
    tuples that follow the keys in ``schema``.  Rows of a partition are read sorted
    and as a stream, many keys per batch; only the state of one key is in memory.
    """
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    names = [part.split()[0] for part in schema.split(",")]
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for pdf in batches:
            for row in zip(*(pdf[c] for c in columns)):
                if key != row[:width]:
                    if state is not None:
                        out.extend(key + r for r in state.rows())
                    key, state = row[:width], make()
                state.add(*row[width:])
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if state is not None:
            out.extend(key + r for r in state.rows())
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    arranged = df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.mapInPandas(run, schema)


@dataclass(frozen=True)
class Rule:
    """How the units of one code are put together.

    ``sep`` goes between units, ``lead`` before the first unit of the code unless a
    new group opens there, ``close`` after its last unit.  A group is a run of codes
    under one ``heading``; ``end`` closes it and trims the blanks before.
    """

    group: int = 0
    sep: str = ""
    lead: str = ""
    close: str = ""
    heading: str = ""
    end: str = ""


UNIT = ["code", "src", "ordinal", "pos"]


def text_blocks(units: DataFrame, rules: dict[int, Rule], gap: str = "") -> DataFrame:
    """units(conv_key, code, src, ordinal, pos, text) -> joined blocks of them: at most
    ``BLOCK`` units, and less than ``BLOCK_CHARS`` characters, separators aside, before the last of them.

    (conv_key, code, src, block, text, lead, tail, chars, start): the texts of a
    block joined, what goes before and after it, its length with both, and where
    it (``start``) and the last block (``last_start``) start in the whole text of the
    conversation.  Only one narrow row per block takes part in the windows over a
    conversation.
    """

    def of(field: str) -> Column:
        pairs = [F.lit(x) for code, rule in rules.items() for x in (code, getattr(rule, field))]
        return F.create_map(*pairs)[F.col("code")]

    piece = F.struct("ordinal", "pos", "text")
    size = F.length("text").cast("bigint")
    # a block of long texts is several: units are dealt by where they start in it
    before = Window.partitionBy("conv_key", "code", "src", "block").orderBy("ordinal", "pos", "text")
    starts = F.sum(size).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    blocks = (
        units.filter(F.length("text") > 0)
        .withColumn("block", block_of("ordinal"))
        .withColumn("block", F.struct("block", F.floor(starts / BLOCK_CHARS).alias("part")))
        .groupBy("conv_key", "code", "src", "block")
        .agg(F.array_sort(F.collect_list(piece)).alias("__p"))
        .select(
            "conv_key",
            "code",
            "src",
            "block",
            F.call_function("array_join", F.transform("__p", lambda p: p["text"]), of("sep")).alias("text"),
        )
    )
    place = Window.partitionBy("conv_key").orderBy("code", "src", "block")
    before, after = F.lag("code").over(place), F.lead("code").over(place)
    group_before, group_after = F.lag("group").over(place), F.lead("group").over(place)
    opens = group_before.isNull() | (group_before != F.col("group"))
    ends = group_after.isNull() | (group_after != F.col("group"))
    code_ends = after.isNull() | (after != F.col("code"))
    lead = (
        F.when(group_before.isNull(), of("heading"))
        .when(opens, F.concat(F.lit(gap), of("heading")))
        .when(before != F.col("code"), of("lead"))
        .otherwise(of("sep"))
    )
    tail = F.concat(
        F.when(code_ends, of("close")).otherwise(F.lit("")), F.when(ends, of("end")).otherwise(F.lit(""))
    )
    trims = ends & (of("end") != "") & (of("close") == "")
    narrow = blocks.select(
        "conv_key",
        "code",
        "src",
        "block",
        of("group").alias("group"),
        F.length("text").alias("__full"),
        F.length(js_rtrim(F.col("text"))).alias("__cut"),
    ).select(
        "conv_key", "code", "src", "block", "__full", "__cut", lead.alias("lead"), tail.alias("tail"), trims.alias("__trims")
    )
    narrow = narrow.withColumn(
        "chars",
        (
            F.length("lead") + F.when(F.col("__trims"), F.col("__cut")).otherwise(F.col("__full")) + F.length("tail")
        ).cast("bigint"),
    )
    placed = narrow.select(
        "conv_key",
        "code",
        "src",
        "block",
        "lead",
        "tail",
        "chars",
        F.col("__trims").alias("trims"),
        (F.sum("chars").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chars")).alias("start"),
    )
    placed = placed.withColumn("last_start", F.max("start").over(Window.partitionBy("conv_key")))
    return blocks.join(placed, ["conv_key", "code", "src", "block"])


def assemble(
    units: DataFrame, rules: dict[int, Rule], gap: str = "", part_chars: int = PART_CHARS
) -> DataFrame:
    """Units in order as one text per conversation -> (conv_key, part, text, last).

    A conversation whose text stays under ``part_chars`` gives exactly one row,
    part 0.  A longer one is cut between blocks into parts that read on from each
    other, so no row and no task holds an unbounded text and nothing is dropped.
    ``last`` is the number of the conversation's last part.
    """
    blocks = text_blocks(units, rules, gap)
    body = F.when(F.col("trims"), js_rtrim(F.col("text"))).otherwise(F.col("text"))
    whole = F.struct("code", "src", "block", F.concat("lead", body, "tail").alias("text"))
    part = lambda start: F.floor(F.col(start) / part_chars).cast("bigint")
    return (
        blocks.select("conv_key", part("start").alias("part"), part("last_start").alias("last"), whole.alias("__p"))
        .groupBy("conv_key", "part")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("__p")), lambda p: p["text"]), "").alias("text"),
            F.max("last").alias("last"),
        )
    )


def total_chars(units: DataFrame, rules: dict[int, Rule], gap: str = "") -> DataFrame:
    """(conv_key, chars): length of what ``assemble`` would give, without building it."""
    return text_blocks(units, rules, gap).groupBy("conv_key").agg(F.sum("chars").alias("chars"))
