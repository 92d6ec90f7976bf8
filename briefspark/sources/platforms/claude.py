"""Claude: a tree of messages whose content is a list of typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.operators import blocks as B
from briefspark.operators.branch import walk
from briefspark.operators.replay import with_sandbox_state
from briefspark.sources.transcript import (
    ARTIFACT,
    Transcript,
    artifact,
    explode_artifacts,
    title_or,
)

SCHEMA = (
    "uuid string, name variant, current_leaf_message_uuid string, chat_messages array<struct<uuid:string,"
    "parent_message_uuid:string, sender:string, text:variant, content:string, created_at:string,"
    "attachments:array<struct<file_name:string, file_type:string>>>>"
)
STATE = "array<struct<path:string,content:string,place:bigint,write_ord:bigint,manifest_ord:bigint>>"


def _branch(payloads: DataFrame) -> DataFrame:
    """One row per payload with ``on``: the messages of the active branch."""
    parsed = payloads.select(
        "conv_key",
        "captured_at",
        "payload",
        F.from_json("payload", SCHEMA).alias("p"),
        F.try_parse_json("payload").isNotNull().alias("ok"),
    ).withColumn("all", F.coalesce("p.chat_messages", F.array().cast(_messages_type())))
    places = walk(
        F.transform("all", lambda m: m["uuid"]),
        F.transform("all", lambda m: m["parent_message_uuid"]),
        F.nullif(F.col("p.current_leaf_message_uuid"), F.lit("")),
    )
    walked = T.let(F.col("all"), lambda every: F.transform(places, lambda i: F.get(every, i)))
    return parsed.withColumn("on", F.coalesce(walked, F.col("all")))


def _messages_type() -> str:
    return SCHEMA[SCHEMA.index("chat_messages ") + len("chat_messages ") :]


def _blocks(content: Column) -> Column:
    """array<struct(raw, v)> of a content list; NULL when it is no list or empty."""
    return T.let(
        F.from_json(F.when(content.startswith("["), content), "array<string>"),
        lambda raws: F.when(
            F.size(raws) > 0,
            F.transform(raws, lambda r: F.struct(r.alias("raw"), F.try_parse_json(r).alias("v"))),
        ),
    )


def _joined_text(blocks: Column, flat: Column) -> Column:
    texts = F.transform(
        F.filter(blocks, lambda b: B.block_type(b["v"]) == "text"),
        lambda b: F.coalesce(T.variant_text(b["v"], "$.text"), F.lit("")),
    )
    return F.coalesce(F.when(blocks.isNotNull(), F.array_join(texts, "\n\n")).otherwise(T.variant_text(flat)), F.lit(""))


def _artifacts_of(m: Column) -> Column:
    return T.let(_blocks(m["content"]), lambda blocks: _artifacts_in(m, blocks))


def _artifacts_in(m: Column, blocks: Column) -> Column:
    shown = F.filter(
        F.transform(blocks, lambda b: B.display_artifact(b["raw"], b["v"])), lambda a: a.isNotNull()
    )
    tagged = T.let(
        _joined_text(blocks, m["text"]),
        lambda text: F.when(F.contains(text, F.lit("<antArtifact")), B.tag_artifacts(text)),
    )

    def full(fmt):
        return lambda a: artifact(
            a["filename"], a["content"], language=a["language"], title=a["title"], fmt=fmt, msg_uuid=m["uuid"]
        )

    empty = F.array().cast(ARTIFACT)
    return F.concat(
        F.coalesce(F.transform(shown, full("tool_use")).cast(ARTIFACT), empty),
        F.coalesce(F.transform(tagged, full("antartifact")).cast(ARTIFACT), empty),
    )


def deliverables_of(state: Column) -> Column:
    """Sandbox state of one payload -> array of delivered artifacts."""
    files = F.filter(state, lambda f: f["place"].isNotNull())
    listed = F.transform(F.filter(state, lambda f: f["manifest_ord"].isNotNull()), lambda f: f["path"])
    outputs = F.transform(
        F.filter(files, lambda f: f["path"].startswith(K.OUTPUTS_DIR)), lambda f: f["path"]
    )
    formal = F.array_distinct(F.concat(listed, outputs))
    paths = F.when(F.size(formal) > 0, formal).otherwise(F.transform(files, lambda f: f["path"]))
    last = F.array_max(F.transform(files, lambda f: F.struct(f["write_ord"], f["content"])))["content"]

    def deliver(p: Column) -> Column:
        own = F.get(F.filter(files, lambda f: f["path"] == p), F.lit(0))["content"]
        binary = T.is_binary_file(p)
        content = F.when(binary, F.lit("")).otherwise(
            F.coalesce(F.nullif(own, F.lit("")), last, F.lit(""))
        )
        name = F.coalesce(F.nullif(F.regexp_replace(p, "(?s)^.*/", ""), F.lit("")), p)
        return artifact(
            name,
            content,
            msg_uuid=F.lit("reconstructed"),
            binary=binary,
            presented=F.array_contains(listed, p),
        )

    return F.transform(paths, deliver)


def claude_blocks(payloads: DataFrame) -> DataFrame:
    """blocks(conv_key, msg_ord, msg_uuid, block_ord, raw) on the active branch."""
    return (
        _branch(payloads)
        .select("conv_key", F.posexplode_outer("on").alias("msg_ord", "m"))
        .select(
            "conv_key",
            F.col("msg_ord").cast("bigint").alias("msg_ord"),
            F.col("m.uuid").alias("msg_uuid"),
            F.posexplode_outer(_blocks(F.col("m.content"))).alias("block_ord", "b"),
        )
        .filter(F.col("b").isNotNull())
        .select("conv_key", "msg_ord", "msg_uuid", F.col("block_ord").cast("bigint").alias("block_ord"), "b.raw")
    )


def claude_attachments(payloads: DataFrame) -> DataFrame:
    branch = _branch(payloads).select(
        "conv_key",
        F.flatten(
            F.transform(
                "on",
                lambda m: F.coalesce(
                    m["attachments"], F.array().cast("array<struct<file_name:string,file_type:string>>")
                ),
            )
        ).alias("files"),
    )
    return branch.select("conv_key", F.posexplode("files").alias("ordinal", "f")).select(
        "conv_key", F.col("ordinal").cast("bigint").alias("ordinal"), "f.file_name", "f.file_type"
    )


def claude_tool_events(payloads: DataFrame) -> DataFrame:
    """events(conv_key, ord, name, input): the tool calls of the active branch."""
    b = claude_blocks(payloads).filter(F.contains(F.col("raw"), F.lit("tool_use"))).withColumn(
        "v", F.try_parse_json("raw")
    )
    return b.filter(B.block_kind(F.col("v")) == "tool").select(
        "conv_key",
        (F.col("msg_ord") * (1 << 20) + F.col("block_ord")).alias("ord"),
        F.coalesce(T.variant_text(F.col("v"), "$.name"), F.lit("")).alias("name"),
        F.get_json_object("raw", "$.input").alias("input"),
    )


def _messages(branch: DataFrame) -> DataFrame:
    rows = (
        branch.filter("ok")
        .select("conv_key", F.posexplode_outer("on").alias("ordinal", "m"))
        .filter(F.col("m").isNotNull())
        .withColumn("blocks", _blocks(F.col("m.content")))
        .withColumn("kinds", F.transform("blocks", lambda b: B.block_type(b["v"])))
        .withColumn("joined", _joined_text(F.col("blocks"), F.col("m.text")))
        .withColumn(
            "found",
            B.search_finds(B.search_input(F.transform("blocks", lambda b: b["raw"]), F.col("kinds"))),
        )
    )
    none = F.array().cast(B.PAIR)
    strings = F.array().cast("array<string>")

    def pairs(b: Column, i: Column) -> Column:
        mined = F.transform(
            F.filter("found", lambda f: (f["at"] == i) & (f["kind"] == "source")),
            lambda f: F.struct(f["title"].alias("title"), f["url"].alias("url")),
        )
        return F.concat(F.coalesce(mined, none), B.block_citations(b["v"]))

    def labels(b: Column, i: Column) -> Column:
        mined = F.transform(
            F.filter("found", lambda f: (f["at"] == i) & (f["kind"] == "image")), lambda f: f["title"]
        )
        own = F.filter(F.array(B.image_label(b["v"])), lambda x: x.isNotNull())
        return F.concat(F.coalesce(mined, strings), own)

    rows = rows.withColumn("labels", F.flatten(F.transform("blocks", labels))).withColumn(
        "sources", T.first_per_url(F.flatten(F.transform("blocks", pairs)))
    )
    searched = F.coalesce(F.exists("found", lambda f: f["kind"] == "image"), F.lit(False))
    shown = F.size(
        F.filter("blocks", lambda b: (B.block_kind(b["v"]) == "artifact"))
    )
    tagged = F.when(
        F.contains(F.col("joined"), F.lit("<antArtifact")), F.size(T.find_all(F.col("joined"), K.ARTIFACT_TAG))
    )
    return (
        rows.select(
            "conv_key",
            F.col("ordinal").cast("bigint").alias("ordinal"),
            F.col("m.uuid").alias("msg_uuid"),
            F.when(F.col("m.sender") == "assistant", F.lit("assistant")).otherwise(F.lit("human")).alias("role"),
            T.js_trim(F.concat(B.strip_tags(F.col("joined")), T.source_lines(F.col("sources")))).alias("text"),
            F.when(
                F.size("labels") > 0, F.array(T.image_subject(F.col("labels"), searched))
            ).alias("images"),
            F.nullif(F.col("m.created_at"), F.lit("")).alias("created_at"),
            (F.coalesce(shown, F.lit(0)) + F.coalesce(tagged, F.lit(0))).alias("n_artifacts"),
        )
        .filter((F.col("text") != "") | (F.col("n_artifacts") > 0) | F.col("images").isNotNull())
        .drop("n_artifacts")
    )


def _integrity(branch: DataFrame) -> DataFrame:
    counted = branch.filter("ok").select(
        "conv_key", F.transform(_every_block(), lambda b: B.block_kind(b["v"])).alias("kinds")
    )
    return counted.select(
        "conv_key",
        F.coalesce(F.size("kinds"), F.lit(0)).cast("bigint").alias("total_blocks"),
        F.coalesce(F.size(F.filter("kinds", lambda k: k != "unknown")), F.lit(0)).cast("bigint").alias("classified_blocks"),
    ).withColumn("complete", F.col("total_blocks") == F.col("classified_blocks"))


def _every_block() -> Column:
    """All blocks of the branch; a flat text counts as one text block."""
    flat = F.struct(F.lit("{}").alias("raw"), F.try_parse_json(F.lit('{"type":"text"}')).alias("v"))
    return F.flatten(
        F.transform(
            "on",
            lambda m: F.coalesce(
                _blocks(m["content"]),
                F.when(T.variant_text(m["text"]).isNotNull(), F.array(flat)),
                F.array().cast("array<struct<raw:string,v:variant>>"),
            ),
        )
    )


def _artifacts(branch: DataFrame) -> DataFrame:
    events = F.transform(
        F.filter(_every_block(), lambda b: B.block_kind(b["v"]) == "tool"),
        lambda b: F.struct(
            F.coalesce(T.variant_text(b["v"], "$.name"), F.lit("")).alias("name"),
            F.get_json_object(b["raw"], "$.input").alias("input"),
        ),
    )
    with_artifacts = branch.filter("ok").filter(
        F.contains(F.col("payload"), F.lit("tool_use")) | F.contains(F.col("payload"), F.lit("<antArtifact"))
    )
    made = (
        with_artifacts.select(
            "conv_key",
            F.to_json(F.flatten(F.transform("on", _artifacts_of))).alias("inline"),
            F.to_json(events).alias("events"),
        )
    )
    made = with_sandbox_state(made, "events", "state").select(
        "conv_key",
        F.concat(
            F.from_json("inline", ARTIFACT),
            T.let(F.from_json("state", STATE), deliverables_of).cast(ARTIFACT),
        ).alias("arts"),
    )
    return explode_artifacts(made, F.col("arts"))


def normalize_claude(payloads: DataFrame) -> Transcript:
    branch = _branch(payloads)
    return Transcript(
        meta=lambda: branch.filter("ok").select(
            "conv_key",
            F.col("p.uuid").alias("conversation_id"),
            title_or(T.variant_text(F.col("p.name")), K.UNTITLED).alias("title"),
            "captured_at",
        ),
        messages=lambda: _messages(branch),
        artifacts=lambda: _artifacts(branch),
        uploads=lambda: B.uploads(claude_attachments(payloads)),
        integrity=lambda: _integrity(branch),
        unknown=lambda: B.classify_blocks(claude_blocks(payloads))
        .filter(F.col("kind") == "unknown")
        .select("conv_key", "msg_ord", "block_ord", "msg_uuid", "hint", "preview"),
        errors=lambda: branch.select(
            "conv_key",
            F.when(F.col("payload").isNull(), F.lit("no payload"))
            .when(~F.col("ok"), F.lit("payload is not valid JSON"))
            .when(F.size("on") == 0, F.lit("no messages parsed"))
            .alias("error"),
        ).filter(F.col("error").isNotNull()),
    )
