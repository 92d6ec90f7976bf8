"""Reading exported chats and routing them by their address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.sources.arrays import read_arrays
from briefspark.sources.platforms.chatgpt import normalize_chatgpt
from briefspark.sources.platforms.claude import normalize_claude
from briefspark.sources.platforms.gemini import normalize_gemini
from briefspark.sources.platforms.simple import (
    normalize_deepseek,
    normalize_grok,
    normalize_hf,
    normalize_perplexity,
)
from briefspark.sources.transcript import Transcript

NORMALIZERS = {
    "claude": normalize_claude,
    "chatgpt": normalize_chatgpt,
    "gemini": normalize_gemini,
    "perplexity": normalize_perplexity,
    "grok": normalize_grok,
    "deepseek": normalize_deepseek,
    "huggingface": normalize_hf,
}


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def route_platform(url: Column) -> Column:
    """Platform of an address, by host or host suffix; the first rule wins."""
    host = host_of(url)
    routed = F.lit(None).cast("string")
    for name, hosts, suffix, _ in reversed(K.PLATFORMS):
        rule = host.isin(*hosts)
        if suffix:
            rule = rule | host.endswith(suffix)
        routed = F.when(rule, F.lit(name)).otherwise(routed)
    return F.coalesce(routed, F.lit(K.GENERIC_PLATFORM))


def conversation_id_from_url(platform: Column, url: Column) -> Column:
    """Conversation id in an address, NULL when the platform has none there."""
    found = F.lit(None).cast("string")
    for name, _, _, pattern in K.PLATFORMS:
        found = F.when(platform == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(found)
    return found


def with_routes(payloads: DataFrame) -> DataFrame:
    """Fill platform and conv_key of payloads(url, payload, ..) where missing."""
    have = payloads.columns
    platform = route_platform(F.col("url"))
    if "platform" in have:
        platform = F.coalesce("platform", platform)
    out = payloads.withColumn("platform", platform)
    key = F.concat_ws(
        ":", "platform", F.coalesce(conversation_id_from_url(F.col("platform"), F.col("url")), F.sha2(F.coalesce("payload", F.lit("")), 256))
    )
    if "conv_key" in have:
        key = F.coalesce("conv_key", key)
    return out.withColumn("conv_key", key)


def read_payloads(
    spark: SparkSession, path: str, fmt: str = "lines", platform: str | None = None, captured_at: str | None = None
) -> DataFrame:
    """Exported chats -> payloads(conv_key, platform, url, captured_at, payload).

    ``lines``: one JSON document per line; ``files``: one document per file (any
    framed text); ``array``: files of one JSON array of documents each, which many
    tasks read together (see arrays); ``parquet`` / ``json`` / ``orc``: a table with a payload column
    and optional url, platform, captured_at, conv_key columns.  Nothing is dropped
    here: a bad document becomes an error row of its normalizer.
    """
    if fmt in ("lines", "files"):
        raw = spark.read.text(path, wholetext=fmt == "files").select(
            F.col("value").alias("payload"), F.col("_metadata.file_path").alias("url")
        )
    elif fmt == "array":
        raw = read_arrays(spark, path)
    else:
        raw = spark.read.format(fmt).load(path)
    for name, value in (("url", None), ("platform", platform), ("captured_at", captured_at), ("conv_key", None)):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(value).cast("string"))
    return with_routes(raw).select("conv_key", "platform", "url", "captured_at", "payload")


def by_platform(payloads: DataFrame, path: str) -> DataFrame:
    """Payloads as a table at ``path``, partitioned by platform.

    A normalizer asks for the payloads of its platform only: from this table it reads
    those files and no others, so a mixed table is read once and not once for each
    platform.
    """
    payloads.write.partitionBy("platform").parquet(path)
    columns = "conv_key", "platform", "url", "captured_at", "payload"
    return payloads.sparkSession.read.schema(payloads.select(*columns).schema).parquet(path).select(*columns)


def normalize(payloads: DataFrame) -> Transcript:
    """Every payload through the normalizer of its platform, as one transcript.

    Each platform reads the payloads with a filter on ``platform``; give a table that
    is partitioned by it (``by_platform``) where payloads are many and mixed.
    """
    return Transcript.union(
        [f(payloads.filter(F.col("platform") == name)) for name, f in NORMALIZERS.items()]
    )


def normalize_many(payloads: DataFrame) -> dict[str, Transcript]:
    return {n: f(payloads.filter(F.col("platform") == n)) for n, f in NORMALIZERS.items()}
