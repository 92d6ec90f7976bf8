"""Which capture counts, and the store of finished briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.functions import text as T


def prefer_data_layer(data: DataFrame, screen: DataFrame) -> DataFrame:
    """Rows of the data capture, and of the screen capture where there is none.

    Adds ``source``: "data layer" or "screen".
    """
    have = data.select("conv_key").distinct()
    return data.withColumn("source", F.lit("data layer")).unionByName(
        screen.join(have, "conv_key", "left_anti").withColumn("source", F.lit("screen"))
    )


def remaining_errors(data_errors: DataFrame, screen_errors: DataFrame, chosen: DataFrame) -> DataFrame:
    """Errors of conversations that neither capture could read: the data one first."""
    first = data_errors.withColumn("rank", F.lit(0)).unionByName(screen_errors.withColumn("rank", F.lit(1)))
    one = first.groupBy("conv_key").agg(F.min_by("error", "rank").alias("error"))
    return one.join(chosen.select("conv_key").distinct(), "conv_key", "left_anti")


def store_key(url) -> F.Column:
    """Host and path of an address: query and fragment do not name a conversation."""
    return F.concat(F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH")))


def upsert_briefs(store: DataFrame, new: DataFrame, key: str = "store_key") -> DataFrame:
    """One brief per key, the latest ``saved_at`` wins (the new one on a tie)."""
    both = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in store.columns if c != key]
    row = F.struct(*rest)
    latest = both.groupBy(key).agg(F.max_by(row, F.struct("saved_at", "__new")).alias("r"))
    return latest.select(*[F.col(c) if c == key else F.col("r")[c].alias(c) for c in store.columns])


def content_hash(messages: DataFrame) -> DataFrame:
    """(conv_key, content_hash): an order-aware digest of a conversation.

    Every message is hashed with its ordinal and the hashes are combined by an
    associative aggregate, so nothing is collected.
    """
    h = F.xxhash64("ordinal", "role", "text")
    return messages.groupBy("conv_key").agg(
        F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(h)), F.hex(F.bit_xor(F.xxhash64(h, F.lit(1))))).alias(
            "content_hash"
        )
    )


def stale(store: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations whose stored brief is missing or was made from other content."""
    hashes = content_hash(messages)
    return hashes.join(store.select("conv_key", "content_hash"), ["conv_key", "content_hash"], "left_anti")


def brief_slug(briefs: DataFrame, title: str = "title") -> DataFrame:
    return briefs.withColumn("slug", T.slug(F.col(title)))
