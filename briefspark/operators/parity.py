"""Where the same conversations, taken from several platforms, first differ.

An entry is a message, or a table or code block found in one.  Digests form a tree over the entries of a
conversation on a platform: entries, blocks of messages, the conversation.  Digests of equal
conversations are compared at the top and go no further; of the others, the blocks that are not
equal on all platforms are opened, and only their entries are shuffled with texts.

In an opened block each place (ordinal, kind, pos) has the entry that most platforms have there, or
none if more of them have none; of equally frequent ones the least by role and text.  A platform
differs where it has another.

Defined cases: messages are numbered again without gaps, so that a platform's own numbering does
not matter (their ordinals are unique, as normalizers give them); a conversation that a platform lacks is
missing from its first entry on; of entries that repeat a place the least counts; null roles and texts
are values of their own.  Of equal tables or code blocks of a conversation the first is an entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.operators import extract as X
from briefspark.operators.ordered import block_of, dense_ordinal, hold

PLACE = ["conv_key", "ordinal", "kind", "pos"]


def parity_entries(sources: dict[str, DataFrame], facts: bool = True) -> DataFrame:
    """messages(conv_key, ordinal, role, text) by platform -> (platform, conv_key, ordinal, kind, pos,
    role, text): the messages, and with ``facts`` their tables and code (whose role is their language)."""
    key = F.concat(F.col("platform"), F.lit("/"), F.col("conv_key").cast("string"))
    tagged = [
        m.withColumn("platform", F.lit(name)).select(key.alias("conv_key"), "ordinal", "role", "text") for name, m in sources.items()
    ]
    # numbering, digests and opened blocks all read the messages, whose making may be dear
    numbered = dense_ordinal(hold(reduce(DataFrame.unionByName, tagged)), ["conv_key"], "ordinal", "place")
    messages = numbered.select("conv_key", F.col("place").cast("bigint").alias("ordinal"), "role", "text")
    entries = messages.select("conv_key", "ordinal", F.lit("message").alias("kind"), F.lit(0).alias("pos"), "role", "text")
    if facts:
        messages = hold(messages)
        for found in (X.tables_verbatim(messages), X.fenced_code(messages)):
            entries = entries.unionByName(
                found.select("conv_key", "ordinal", "kind", "pos", F.col("language").alias("role"), F.col("value").alias("text"))
            )
    slash = F.instr("conv_key", "/")
    return entries.select(
        F.substring_index("conv_key", "/", 1).alias("platform"),
        F.col("conv_key").substr(slash + 1, F.length("conv_key")).alias("conv_key"),
        *PLACE[1:],
        "role",
        "text",
    )


def _unequal(digests: DataFrame, keys: list[str], platforms: int) -> DataFrame:
    """The keys whose digests are not there and equal on all platforms."""
    seen = digests.groupBy(*keys).agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return seen.filter((F.col("n") < platforms) | (F.col("low") != F.col("high"))).select(*keys)


def _digest(h: Column) -> Column:
    return F.struct(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y")).alias("digest")


def open_blocks(entries: DataFrame, platforms: int) -> DataFrame:
    """(conv_key, block) of the blocks that differ, by descent from whole conversations."""
    # a null is told from an empty text
    leaf = F.xxhash64(*PLACE[1:], F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    blocks = hold(entries.groupBy("conv_key", "platform", block_of("ordinal").alias("block")).agg(_digest(leaf)))
    chats = blocks.groupBy("conv_key", "platform").agg(_digest(F.xxhash64("block", "digest")))
    inside = blocks.join(_unequal(chats, ["conv_key"], platforms), "conv_key", "left_semi")
    return _unequal(inside, ["conv_key", "block"], platforms)


def first_differences(entries: DataFrame, platforms: list[str]) -> DataFrame:
    """entries as of ``parity_entries`` -> (conv_key, platform, kind, ordinal, pos, what).

    One row for each conversation, platform and kind of entry that differs: its first place, and
    what is different there: missing, extra, role or text.
    """
    entries = entries.withColumn("block", block_of("ordinal"))
    opened = entries.join(open_blocks(entries, len(platforms)), ["conv_key", "block"], "left_semi")
    has = opened.groupBy(*PLACE, "platform").agg(F.min(F.struct("role", "text")).alias("has"))
    has = hold(has)
    votes = has.groupBy(*PLACE, "has").agg(F.count("*").alias("n"))
    best = votes.groupBy(*PLACE).agg(F.min(F.struct((-F.col("n")).alias("less"), "has")).alias("best"), F.sum("n").alias("present"))
    usual = best.select(
        *PLACE,
        F.when(-F.col("best.less") >= len(platforms) - F.col("present"), F.col("best.has")).alias("usual"),
        F.explode(F.array(*map(F.lit, platforms))).alias("platform"),
    )
    here, there = F.col("has"), F.col("usual")
    what = (
        F.when(here.isNull() & there.isNotNull(), "missing")
        .when(here.isNotNull() & there.isNull(), "extra")
        .when(~here["role"].eqNullSafe(there["role"]), "role")
        .when(~here["text"].eqNullSafe(there["text"]), "text")
    )
    found = usual.join(has, [*PLACE, "platform"], "left").withColumn("what", what).filter("what IS NOT NULL")
    first = found.groupBy("conv_key", "platform", "kind").agg(F.min(F.struct("ordinal", "pos", "what")).alias("first"))
    return first.select("conv_key", "platform", "kind", "first.*")


def parity_differences(sources: dict[str, DataFrame], facts: bool = True) -> DataFrame:
    """messages by platform -> the first differences of each conversation and platform."""
    return first_differences(parity_entries(sources, facts), sorted(sources))
