"""The bundle of tables that a normalizer returns.

A payload is one row, so a normalizer is a projection: it computes arrays inside
the row and every table below explodes one of them.  No table needs a shuffle,
and asking for one table prunes the work of the others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T

NO_ARTIFACTS = (
    "ordinal bigint, artifact_id string, title string, filename string, language string, content string,"
    " format string, msg_uuid string, binary boolean, presented boolean"
)
MESSAGE = "array<struct<msg_uuid:string,role:string,text:string,images:array<string>,created_at:string>>"
ARTIFACT = (
    "array<struct<title:string,filename:string,language:string,content:string,format:string,"
    "msg_uuid:string,binary:boolean,presented:boolean>>"
)


class Transcript:
    """meta(conv_key, conversation_id, title, captured_at), messages, artifacts,
    uploads, integrity, unknown, errors: all keyed by conv_key.

    A table may be given as a function that makes it; it is then made when it is
    first asked for.
    """

    TABLES = ("meta", "messages", "artifacts", "uploads", "integrity", "unknown", "errors")

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        if set(tables) != set(self.TABLES):
            raise TypeError(f"a transcript consists of {', '.join(self.TABLES)}")
        self._makers = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.TABLES:
            raise AttributeError(name)
        made = self._makers[name]
        table = made if isinstance(made, DataFrame) else made()
        setattr(self, name, table)
        return table

    @staticmethod
    def union(parts: list["Transcript"]) -> "Transcript":
        def one(name: str) -> Callable[[], DataFrame]:
            return lambda: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])

        return Transcript(**{name: one(name) for name in Transcript.TABLES})


def explode_messages(df: DataFrame, messages: Column) -> DataFrame:
    return df.select("conv_key", F.posexplode_outer(messages.cast(MESSAGE)).alias("ordinal", "m")).filter(
        F.col("m").isNotNull()
    ).select(
        "conv_key",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "m.msg_uuid",
        "m.role",
        "m.text",
        "m.images",
        "m.created_at",
    )


def explode_artifacts(df: DataFrame, artifacts: Column) -> DataFrame:
    return df.select("conv_key", F.posexplode_outer(artifacts.cast(ARTIFACT)).alias("ordinal", "a")).filter(
        F.col("a").isNotNull()
    ).select(
        "conv_key",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.concat(F.lit("artifact-"), (F.col("ordinal") + 1).cast("string")).alias("artifact_id"),
        "a.title",
        "a.filename",
        "a.language",
        "a.content",
        "a.format",
        "a.msg_uuid",
        "a.binary",
        "a.presented",
    )


def message(uuid: Column, role: Column, text: Column, images=None, created_at=None) -> Column:
    return F.struct(
        uuid.alias("msg_uuid"),
        role.alias("role"),
        text.alias("text"),
        (F.lit(None).cast("array<string>") if images is None else images).alias("images"),
        (F.lit(None).cast("string") if created_at is None else created_at).alias("created_at"),
    )


def artifact(filename, content, language=None, title=None, fmt="tool_use", msg_uuid=None, binary=None, presented=None):
    none = F.lit(None)
    return F.struct(
        (none if title is None else title).cast("string").alias("title"),
        filename.cast("string").alias("filename"),
        (none if language is None else language).cast("string").alias("language"),
        content.alias("content"),
        F.lit(fmt).alias("format"),
        (none.cast("string") if msg_uuid is None else msg_uuid).alias("msg_uuid"),
        (F.lit(False) if binary is None else binary).alias("binary"),
        (F.lit(False) if presented is None else presented).alias("presented"),
    )


def renumber(messages: Column, prefix: str) -> Column:
    """Set the synthetic message ids ``prefix``-0, -1, .. of an array in order."""
    return F.transform(
        messages,
        lambda m, i: message(
            F.concat(F.lit(f"{prefix}-"), i.cast("string")), m["role"], m["text"], m["images"], m["created_at"]
        ),
    )


def title_or(title: Column, default: str) -> Column:
    return F.coalesce(F.nullif(T.js_trim(title), F.lit("")), F.lit(default))


def bundle(
    parsed: DataFrame,
    *,
    messages: Column,
    conversation_id: Column,
    title: Column,
    artifacts: DataFrame | Callable[[], DataFrame] | None = None,
    artifact_count: Column | None = None,
    uploads: DataFrame | None = None,
    integrity: DataFrame | Callable[[], DataFrame] | None = None,
    unknown: DataFrame | None = None,
) -> Transcript:
    """A transcript from a parsed payload table (conv_key, captured_at, payload, ok)."""
    count = F.coalesce(F.size(messages), F.lit(0))
    total = (count + (F.lit(0) if artifact_count is None else artifact_count)).cast("bigint")
    spark = parsed.sparkSession
    key = dict(parsed.dtypes)["conv_key"]
    empty = lambda ddl: spark.createDataFrame([], f"conv_key {key}, {ddl}")
    return Transcript(
        meta=lambda: parsed.filter("ok").select(
            "conv_key",
            conversation_id.alias("conversation_id"),
            title.alias("title"),
            F.col("captured_at"),
        ),
        messages=lambda: explode_messages(parsed.filter("ok"), messages),
        artifacts=(lambda: empty(NO_ARTIFACTS))
        if artifacts is None
        else artifacts,
        uploads=(lambda: empty("ordinal bigint, name string, type string")) if uploads is None else uploads,
        integrity=(lambda: parsed.filter("ok").select(
            "conv_key",
            total.alias("total_blocks"),
            total.alias("classified_blocks"),
            F.lit(True).alias("complete"),
        ))
        if integrity is None
        else integrity,
        unknown=(lambda: empty("msg_ord bigint, block_ord bigint, msg_uuid string, hint string, preview string"))
        if unknown is None
        else unknown,
        errors=lambda: parsed.select(
            "conv_key",
            F.when(F.col("payload").isNull(), F.lit("no payload"))
            .when(~F.col("ok"), F.lit("payload is not valid JSON"))
            .when(count == 0, F.lit("no messages parsed"))
            .alias("error"),
        ).filter(F.col("error").isNotNull()),
    )


def normalize_simple(messages: DataFrame, meta: DataFrame | None = None) -> Transcript:
    """messages(conv_key, ordinal, role, text) -> transcript.

    Blank messages are dropped, texts trimmed, and the rest numbered from 0.
    """
    from briefspark.operators.ordered import dense_ordinal

    kept = messages.filter(T.has_text(F.col("text"))).select("conv_key", "ordinal", "role", "text")
    numbered = dense_ordinal(kept, ["conv_key"], "ordinal", "n").select(
        "conv_key",
        F.col("n").alias("ordinal"),
        F.concat(F.lit("dom-"), F.col("n").cast("string")).alias("msg_uuid"),
        "role",
        T.js_trim(F.col("text")).alias("text"),
        F.lit(None).cast("array<string>").alias("images"),
        F.lit(None).cast("string").alias("created_at"),
    )
    counted = messages.groupBy("conv_key").agg(
        F.count_if(T.has_text(F.col("text"))).alias("total_blocks")
    )
    if meta is None:
        meta = counted.select(
            "conv_key",
            F.col("conv_key").cast("string").alias("conversation_id"),
            F.lit("").alias("title"),
            F.lit(None).cast("string").alias("captured_at"),
        )
    spark = messages.sparkSession
    key = dict(messages.dtypes)["conv_key"]
    empty = lambda ddl: spark.createDataFrame([], f"conv_key {key}, {ddl}")
    return Transcript(
        meta=meta.withColumn("title", title_or(F.col("title"), K.UNTITLED)),
        messages=numbered,
        artifacts=lambda: empty(NO_ARTIFACTS),
        uploads=lambda: empty("ordinal bigint, name string, type string"),
        integrity=counted.select(
            "conv_key",
            "total_blocks",
            F.col("total_blocks").alias("classified_blocks"),
            F.lit(True).alias("complete"),
        ),
        unknown=lambda: empty("msg_ord bigint, block_ord bigint, msg_uuid string, hint string, preview string"),
        errors=counted.filter("total_blocks = 0").select("conv_key", F.lit("no messages parsed").alias("error")),
    )
