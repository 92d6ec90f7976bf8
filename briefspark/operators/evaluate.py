"""Scorecard: how much smaller a brief is, and how often it leads to the same move."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.operators.chunk import transcript_chars
from briefspark.operators.render import Brief, brief_chars


def brief_metrics(units: DataFrame, brief: Brief, brand: str = "briefspark") -> DataFrame:
    """One row per conversation: sizes, reduction, integrity, section counts.

    Lengths are summed over text units; neither text is built.
    """
    full = transcript_chars(units)
    short = brief_chars(brief, brand)
    tables = {"decided": brief.decided, "open": brief.open, "rejected": brief.rejected, "verbatim": brief.verbatim, "files": brief.files}
    marks = reduce(
        DataFrame.unionByName,
        [df.select("conv_key", F.lit(name).alias("section")) for name, df in tables.items()],
    )
    counts = marks.groupBy("conv_key").agg(
        *[F.count_if(F.col("section") == name).alias(name) for name in tables]
    )
    joined = brief.meta.select("conv_key", F.col("complete").alias("integrity_complete")).join(
        full, "conv_key", "left"
    ).join(short, "conv_key", "left").join(counts, "conv_key", "left").fillna(
        0, ["full_chars", "brief_chars", *tables]
    )
    ratio = F.col("brief_chars") / F.when(F.col("full_chars") > 0, F.col("full_chars"))
    return joined.select(
        F.col("conv_key").alias("id"),
        "full_chars",
        "brief_chars",
        F.coalesce(1 - ratio, F.lit(0.0)).alias("reduction"),
        "integrity_complete",
        *tables,
    )


def corpus_summary(scorecard: DataFrame, platforms: DataFrame) -> DataFrame:
    """Per platform and in total: conversations, sizes, median reduction."""
    joined = scorecard.join(platforms.select(F.col("conv_key").alias("id"), "platform"), "id")
    return joined.rollup("platform").agg(
        F.count("*").alias("conversations"),
        F.sum("full_chars").alias("full_chars"),
        F.sum("brief_chars").alias("brief_chars"),
        F.percentile_approx("reduction", 0.5).alias("median_reduction"),
    )


#: Size of the quantile sketches of a summary: exact up to about so many conversations.
SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """Bound of a sketch's error in rank, as a share of all values, that holds with 99 % probability
    (the fit that the sketch's authors publish; merging does not add to it)."""
    return 2.296 / k**0.9723


def summary_parts(scorecard: DataFrame, platforms: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(platform, conversations, full_chars, brief_chars, reductions) of one batch of conversations.

    ``reductions`` is a mergeable quantile sketch, so parts can be stored, batch by batch, and
    summed up later without reading a conversation again.  Values without reduction count as
    conversations but not in the sketch.
    """
    joined = scorecard.join(platforms.select(F.col("conv_key").alias("id"), "platform"), "id")
    return joined.groupBy("platform").agg(
        F.count("*").alias("conversations"),
        F.sum("full_chars").alias("full_chars"),
        F.sum("brief_chars").alias("brief_chars"),
        F.kll_sketch_agg_double(F.col("reduction").cast("double"), k).alias("reductions"),
    )


def summed_parts(parts: DataFrame, k: int = SKETCH_K, ranks: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Parts of any number of batches -> per platform and in total: sizes, quantiles of the reduction.

    ``quantiles`` are those at ``ranks``, each the least value that at least this share of all is
    no greater than, but for an error in rank of ``rank_error``.
    """
    total = parts.rollup("platform").agg(
        F.sum("conversations").alias("conversations"),
        F.sum("full_chars").alias("full_chars"),
        F.sum("brief_chars").alias("brief_chars"),
        F.kll_merge_agg_double("reductions", k).alias("reductions"),
    )
    some = F.kll_sketch_get_n_double("reductions") > 0
    found = F.kll_sketch_get_quantile_double("reductions", F.array(*map(F.lit, ranks)))
    return total.select(
        "platform",
        "conversations",
        "full_chars",
        "brief_chars",
        F.when(some, found).alias("quantiles"),
        F.lit(rank_error(k)).alias("rank_error"),
    )


def _js_string(v: Column) -> Column:
    return F.coalesce(T.variant_text(v), F.to_json(v))


def parse_verdict(outputs: DataFrame, output: str = "output") -> DataFrame:
    """Judge output -> + same_move, reasoning; a bad one counts as a miss."""
    text = F.coalesce(F.col(output), F.lit(""))
    v = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    shaped = outputs.withColumn("__v", v)
    readable = F.schema_of_variant(F.col("__v")).startswith("OBJECT")
    return (
        shaped.withColumn("same_move", F.coalesce(readable & T.variant_truthy(F.col("__v"), "$.sameMove"), F.lit(False)))
        .withColumn(
            "reasoning",
            F.when(readable, F.coalesce(_js_string(T.variant_field(F.col("__v"), "$.reasoning")), F.lit(""))).otherwise(
                F.concat(F.lit("judge output did not parse: "), F.substring(text, 1, K.VERDICT_NOTE_CHARS))
            ),
        )
        .drop("__v")
    )


def pass_rate(verdicts: DataFrame) -> DataFrame:
    """(n, passed, rate) over all verdicts."""
    return verdicts.agg(
        F.count("*").alias("n"),
        F.count_if("same_move").alias("passed"),
        F.avg(F.col("same_move").cast("int")).alias("rate"),
    )


def conversation_digest(messages: DataFrame) -> DataFrame:
    """(conv_key, n, digest) of roles and texts in order, by associative aggregates."""
    h = F.xxhash64("ordinal", "role", "text")
    return messages.groupBy("conv_key").agg(
        F.count("*").alias("n"), F.bit_xor(h).alias("digest"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("digest2")
    )


def parity_report(sources: dict[str, DataFrame]) -> DataFrame:
    """messages per platform, keyed by content -> (conv_key, platforms, equal)."""
    digests = reduce(
        DataFrame.unionByName,
        [conversation_digest(m).withColumn("platform", F.lit(name)) for name, m in sources.items()],
    )
    return digests.groupBy("conv_key").agg(
        F.count("*").alias("platforms"),
        (
            (F.count("*") == len(sources))
            & (F.min(F.struct("n", "digest", "digest2")) == F.max(F.struct("n", "digest", "digest2")))
        ).alias("equal"),
    )
