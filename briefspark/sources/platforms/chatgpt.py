"""ChatGPT: a map of nodes, one branch of it visible, canvas edits on the side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import text as T
from briefspark.operators.branch import walk
from briefspark.operators.replay import with_canvas_docs
from briefspark.sources.transcript import (
    Transcript,
    artifact,
    bundle,
    explode_artifacts,
    message,
    title_or,
)

SCHEMA = (
    "title variant, conversation_id variant, current_node string, mapping map<string, struct<id:string,"
    "parent:string, message:struct<id:string, author:struct<role:string>, recipient:string,"
    "create_time:double, content:struct<content_type:string, parts:variant, text:variant>,"
    "metadata:variant>>>"
)
DOCS = "array<struct<doc_id:string,name:string,type:string,content:string>>"


def _text(content: Column) -> Column:
    strings = F.filter(F.transform(T.variant_list(content["parts"]), lambda p: T.variant_text(p)), lambda p: p.isNotNull())
    kind = content["content_type"]
    return F.coalesce(
        F.when(kind.isin("text", "multimodal_text"), T.js_trim(F.array_join(strings, "\n"))),
        F.when(kind == "text", T.js_trim(T.variant_text(content["text"]))),
        F.lit(""),
    )


def _sources(meta: Column) -> Column:
    none = F.expr("cast(array() as array<variant>)")
    items = F.flatten(
        F.transform(
            F.coalesce(T.variant_list(meta, "$.content_references"), none),
            lambda r: F.coalesce(T.variant_list(r, "$.items"), none),
        )
    )
    cited = F.transform(
        F.coalesce(T.variant_list(meta, "$.citations"), none),
        lambda c: F.try_variant_get(c, "$.metadata", "variant"),
    )

    def pair(x: Column) -> Column:
        return T.let(
            F.nullif(T.variant_text(x, "$.url"), F.lit("")),
            lambda url: F.struct(F.coalesce(T.variant_text(x, "$.title"), url).alias("title"), url.alias("url")),
        )

    pairs = F.filter(F.transform(F.concat(items, cited), pair), lambda p: p["url"].isNotNull())
    return T.source_lines(T.last_title_per_url(pairs))


def normalize_chatgpt(payloads: DataFrame) -> Transcript:
    parsed = payloads.select(
        "conv_key",
        "captured_at",
        "payload",
        F.from_json("payload", SCHEMA).alias("p"),
        F.try_parse_json("payload").isNotNull().alias("ok"),
    ).withColumn("nodes", F.map_entries("p.mapping"))
    places = walk(
        F.transform("nodes", lambda n: n["key"]),
        F.transform("nodes", lambda n: n["value"]["parent"]),
        F.col("p.current_node"),
    )
    by_time = F.transform(
        F.array_sort(
            F.filter(
                F.transform(
                    "nodes",
                    lambda n, i: F.struct(
                        F.coalesce(n["value"]["message"]["create_time"], F.lit(0.0)).alias("at"),
                        i.alias("i"),
                        n["value"]["message"].isNotNull().alias("has"),
                    ),
                ),
                lambda x: x["has"],
            )
        ),
        lambda x: x["i"],
    )
    branched = parsed.withColumn("at", F.coalesce(places, by_time)).withColumn(
        "seen",
        F.filter(
            T.let(F.col("nodes"), lambda ns: F.transform("at", lambda i: F.get(ns, i)["value"])),
            lambda n: n["message"].isNotNull()
            & ~T.variant_truthy(n["message"]["metadata"], "$.is_visually_hidden_from_conversation")
            & F.coalesce(n["message"]["author"]["role"] != "system", F.lit(True)),
        ),
    )
    canvas = lambda n: F.coalesce(n["message"]["recipient"].startswith("canmore."), F.lit(False))
    spoken = F.filter(
        "seen",
        lambda n: ~canvas(n)
        & F.coalesce(n["message"]["author"]["role"].isin("user", "assistant"), F.lit(False))
        & (F.coalesce(n["message"]["recipient"], F.lit("all")) == "all"),
    )
    texts = F.transform(
        spoken,
        lambda n: message(
            F.coalesce(n["message"]["id"], n["id"]),
            F.when(n["message"]["author"]["role"] == "user", F.lit("human")).otherwise(F.lit("assistant")),
            F.concat(_text(n["message"]["content"]), _sources(n["message"]["metadata"])),
        ),
    )
    shaped = branched.withColumn(
        "msgs", F.filter(texts, lambda m: T.has_text(m["text"]))
    ).withColumn(
        "events",
        F.transform(
            F.filter("seen", canvas),
            lambda n: F.struct(
                n["message"]["recipient"].alias("recipient"),
                F.coalesce(T.variant_text(n["message"]["metadata"], "$.canvas.textdoc_id"), F.lit("default")).alias("doc_id"),
                T.variant_text(n["message"]["metadata"], "$.canvas.textdoc_type").alias("doc_type"),
                T.variant_text(n["message"]["content"]["text"]).alias("body"),
            ),
        ),
    )
    edited = shaped.filter(F.size("events") > 0).select("conv_key", F.to_json("events").alias("events"))
    artifacts = lambda: explode_artifacts(
        with_canvas_docs(edited, "events", "docs"),
        F.transform(
            F.from_json("docs", DOCS),
            lambda d: artifact(
                T.canvas_filename(d["name"], d["type"]),
                d["content"],
                language=d["type"],
                msg_uuid=F.lit("chatgpt-canvas"),
                presented=F.lit(True),
            ),
        ),
    )
    created = F.array_distinct(
        F.transform(
            F.filter(
                "events",
                lambda e: F.contains(e["recipient"], F.lit("create_textdoc"))
                & F.schema_of_variant(F.try_parse_json(F.coalesce(e["body"], F.lit("{}")))).startswith("OBJECT"),
            ),
            lambda e: e["doc_id"],
        )
    )
    uuids = F.transform(
        "msgs",
        lambda m, i: message(
            F.coalesce(m["msg_uuid"], F.concat(F.lit("gpt-"), i.cast("string"))), m["role"], m["text"]
        ),
    )
    return bundle(
        shaped,
        messages=uuids,
        conversation_id=F.coalesce(T.variant_text(F.col("p.conversation_id")), F.lit("chatgpt")),
        title=title_or(T.variant_text(F.col("p.title")), "ChatGPT conversation"),
        artifacts=artifacts,
        artifact_count=F.coalesce(F.size(created), F.lit(0)),
    )
