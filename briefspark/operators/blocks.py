"""Content blocks: classification, artifacts, sources, images, integrity.

``blocks(conv_key, msg_ord, msg_uuid, block_ord, raw)`` holds one JSON text per
block.  The column functions also serve the normalizer, which applies them to
arrays inside a payload row.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.functions.strings import read_json, valid
from briefspark.operators.ordered import first_wins

PAIR = "array<struct<title:string,url:string>>"
FOUND = ArrayType(
    StructType().add("at", "integer").add("kind", "string").add("title", "string").add("url", "string")
)


# -- one block --------------------------------------------------------------------


def block_type(v: Column) -> Column:
    return F.coalesce(T.variant_text(v, "$.type"), F.lit(""))


def _held(v: Column) -> Column:
    """struct(held, as_text): what a tool call displays, as a JSON object."""
    return T.let(
        F.try_variant_get(v, "$.input.display_content", "variant"),
        lambda shown: T.let(
            T.variant_text(shown),
            lambda text: F.struct(
                F.when(text.isNotNull(), F.try_parse_json(text)).otherwise(shown).alias("held"),
                text.alias("as_text"),
            ),
        ),
    )


def display_artifact(raw: Column, v: Column) -> Column:
    """The artifact shown by a tool call: struct(title, filename, language, content)."""

    def content(h: Column) -> Column:
        code = F.coalesce(T.variant_field(h["held"], "$.code"), T.variant_field(h["held"], "$.content"))
        raw_code = F.coalesce(
            F.get_json_object(raw, "$.input.display_content.code"),
            F.get_json_object(raw, "$.input.display_content.content"),
            F.lit(""),
        )
        return F.coalesce(T.variant_text(code), h["as_text"], T.compact_json(raw_code))

    def shape(h: Column) -> Column:
        filename = F.nullif(T.variant_text(h["held"], "$.filename"), F.lit(""))
        return T.let(
            filename,
            lambda name: F.when(
                name.isNotNull(),
                F.struct(
                    T.variant_text(h["held"], "$.title").alias("title"),
                    name.alias("filename"),
                    T.variant_text(h["held"], "$.language").alias("language"),
                    content(h).alias("content"),
                ),
            ),
        )

    return F.when(block_type(v) == "tool_use", T.let(_held(v), shape))


def has_display_artifact(v: Column) -> Column:
    return T.let(_held(v), lambda h: F.coalesce(F.length(T.variant_text(h["held"], "$.filename")) > 0, F.lit(False)))


def block_kind(v: Column) -> Column:
    return T.let(
        block_type(v),
        lambda kind: F.when(kind == "text", F.lit("text"))
        .when(kind == "tool_use", F.when(has_display_artifact(v), F.lit("artifact")).otherwise(F.lit("tool")))
        .when(kind.isin(*K.NOISE_BLOCKS), F.lit("tool-noise"))
        .otherwise(F.lit("unknown")),
    )


def block_hint(v: Column) -> Column:
    kind = block_type(v)
    return F.when(kind != "", F.concat(F.lit("type:"), kind)).otherwise(F.lit("no-type"))


def block_preview(raw: Column) -> Column:
    return T.one_line_preview(T.compact_json(raw))


def block_citations(v: Column) -> Column:
    cites = F.transform(
        T.variant_list(v, "$.citations"),
        lambda c: F.struct(
            F.coalesce(T.variant_text(c, "$.title"), T.variant_text(c, "$.url")).alias("title"),
            T.variant_text(c, "$.url").alias("url"),
        ),
    )
    http = F.filter(cites, lambda c: F.coalesce(c["url"].rlike("(?i)^https?://"), F.lit(False)))
    return F.coalesce(http.cast(PAIR), F.array().cast(PAIR))


def image_label(v: Column) -> Column:
    """Subject of an image block, NULL for other blocks."""
    alt = T.js_trim(F.coalesce(T.variant_text(v, "$.alt_text"), F.lit("")))
    return F.when(
        block_type(v) == "image", F.coalesce(F.nullif(alt, F.lit("")), F.lit("image"))
    )


# -- search results: JSON of unknown depth -------------------------------------------


def _finds(content) -> list[tuple[str, str, str]]:
    """Sources and images anywhere in a search result, in document order."""
    is_http = lambda x: isinstance(x, str) and re.match(r"https?://", x, re.I) is not None
    is_image = re.compile(K.IMAGE_URL.replace(r"\z", r"\Z"))
    sources: dict[str, str] = {}
    images: dict[str, str] = {}
    out: list[tuple[str, str, str]] = []

    def image(url, title):
        if is_http(url) and url not in images:
            images[url] = title.strip() or "image"
            out.append(("image", images[url], url))

    todo = [content]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            titles = [node.get("title"), node.get("page_title")]
            title = next((t for t in titles if isinstance(t, str) and t), "")
            url = node.get("url")
            if is_http(url):
                if is_image.search(url):
                    image(url, title)
                elif title and url not in sources:
                    sources[url] = title
                    out.append(("source", title, url))
            for field in K.IMAGE_FIELDS:
                held = node.get(field)
                image(held.get("url") if isinstance(held, dict) else held, title)
            todo.extend(reversed(list(node.values())))
    return out


def _content(text: str | None):
    """The lists and objects of a content; None for what cannot be read."""
    try:
        return read_json(text, strict=False) if text else None
    except ValueError:
        return None


@F.pandas_udf(FOUND)
def search_finds(blocks: pd.Series) -> pd.Series:
    """JSON list of {at, content} -> what each content holds, with its ``at``."""

    def find(text):
        if not text:
            return []
        return [
            {"at": b["at"], "kind": k, "title": valid(t), "url": valid(u)}
            for b in json.loads(text)
            for k, t, u in _finds(_content(b.get("content")))
        ]

    return blocks.map(find)


search_finds = search_finds.asNondeterministic()


def search_input(raws: Column, kinds: Column) -> Column:
    """The JSON list that ``search_finds`` reads; NULL when no block is a search result.

    A content that is a string is no result, also if the string looks like JSON.
    """

    def held(raw: Column, kind: Column) -> Column:
        found = F.try_variant_get(F.try_parse_json(raw), "$.content", "variant")
        nested = F.schema_of_variant(found).rlike("^(ARRAY|OBJECT)")
        return F.when(kind.isin(*K.SEARCH_BLOCKS) & nested, F.get_json_object(raw, "$.content"))

    asked = F.filter(
        F.transform(raws, lambda r, i: F.struct(i.alias("at"), held(r, F.get(kinds, i)).alias("content"))),
        lambda x: x["content"].isNotNull(),
    )
    return F.when(F.size(asked) > 0, F.to_json(asked))


# -- artifact tags in message text --------------------------------------------------------


def tag_artifacts(text: Column) -> Column:
    """array<struct(title, filename, language, content)> of the tags in a text."""

    def attribute(attrs: Column, name: str) -> Column:
        pattern = rf'([0-9A-Za-z_][0-9A-Za-z_-]*)[{K.BLANK}]*=[{K.BLANK}]*"([^"]*)"'
        pairs = F.arrays_zip(
            F.regexp_extract_all(attrs, F.lit(pattern), F.lit(1)).alias("k"),
            F.regexp_extract_all(attrs, F.lit(pattern), F.lit(2)).alias("v"),
        )
        return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]

    zipped = F.arrays_zip(
        T.find_all(text, K.ARTIFACT_TAG, 1).alias("attrs"),
        T.find_all(text, K.ARTIFACT_TAG, 2).alias("body"),
    )
    ident = lambda z: attribute(z["attrs"], "identifier")
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.nullif(attribute(z["attrs"], "title"), F.lit("")).alias("title"),
            F.when(F.contains(ident(z), F.lit(".")), ident(z)).alias("filename"),
            F.nullif(
                F.coalesce(attribute(z["attrs"], "language"), attribute(z["attrs"], "type")), F.lit("")
            ).alias("language"),
            z["body"].alias("content"),
        ),
    )


def strip_tags(text: Column) -> Column:
    tagged = F.contains(text, F.lit("<antArtifact"))
    return F.when(tagged, T.js_trim(T.replace_pattern(text, K.ARTIFACT_TAG, ""))).otherwise(text)


# -- table operators ------------------------------------------------------------------------


def _parsed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("v", F.try_parse_json("raw"))


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """+ kind, hint and preview (the last two for unknown blocks only)."""
    b = _parsed(blocks).withColumn("kind", block_kind(F.col("v")))
    unknown = F.col("kind") == "unknown"
    return (
        b.withColumn("hint", F.when(unknown, block_hint(F.col("v"))))
        .withColumn("preview", F.when(unknown, block_preview(F.col("raw"))))
        .drop("v")
    )


def display_content_artifacts(blocks: DataFrame) -> DataFrame:
    b = _parsed(blocks.filter(F.contains(F.col("raw"), F.lit("display_content"))))
    return (
        b.withColumn("a", display_artifact(F.col("raw"), F.col("v")))
        .filter(F.col("a").isNotNull())
        .select("conv_key", "msg_ord", "block_ord", "msg_uuid", "a.title", "a.filename", "a.language", "a.content")
    )


def ant_artifacts(messages: DataFrame) -> DataFrame:
    """messages(conv_key, ordinal, msg_uuid, text) -> artifacts of their tags."""
    tagged = messages.filter(F.contains(F.col("text"), F.lit("<antArtifact")))
    return tagged.select(
        "conv_key", "ordinal", "msg_uuid", F.posexplode(tag_artifacts(F.col("text"))).alias("pos", "a")
    ).select("conv_key", "ordinal", "pos", "msg_uuid", "a.title", "a.filename", "a.language", "a.content")


def search_context(blocks: DataFrame) -> DataFrame:
    """(conv_key, msg_ord, block_ord, ord, kind, title, url) of result blocks."""
    hits = _parsed(blocks).filter(block_type(F.col("v")).isin(*K.SEARCH_BLOCKS))
    asked = search_input(F.array("raw"), F.array(block_type(F.col("v"))))
    return (
        hits.withColumn("found", search_finds(asked))
        .select("conv_key", "msg_ord", "block_ord", F.posexplode("found").alias("ord", "f"))
        .select("conv_key", "msg_ord", "block_ord", "ord", "f.kind", "f.title", "f.url")
    )


def citations(blocks: DataFrame) -> DataFrame:
    """(conv_key, msg_ord, url, title, block_ord, ord): first title per message and url."""
    b = _parsed(blocks.filter(F.contains(F.col("raw"), F.lit("citations"))))
    flat = b.select(
        "conv_key", "msg_ord", "block_ord", F.posexplode(block_citations(F.col("v"))).alias("ord", "c")
    ).select("conv_key", "msg_ord", "c.url", "block_ord", "ord", "c.title")
    return first_wins(flat, ["conv_key", "msg_ord", "url"], ["block_ord", "ord"])


def assemble_messages(blocks: DataFrame) -> DataFrame:
    """Text of each message from its text blocks, tags taken out, sources appended.

    The group is one message, so it is bounded by the size of a payload row.
    """
    b = _parsed(blocks)
    texts = (
        b.filter(block_type(F.col("v")) == "text")
        .groupBy("conv_key", "msg_ord", "msg_uuid")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("block_ord", F.coalesce(T.variant_text(F.col("v"), "$.text"), F.lit("")).alias("t"))
                )
            ).alias("parts")
        )
        .withColumn("text", strip_tags(F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n")))
    )
    cited = (
        citations(blocks)
        .groupBy("conv_key", "msg_ord")
        .agg(F.array_sort(F.collect_list(F.struct("block_ord", "ord", "title", "url"))).alias("pairs"))
    )
    joined = texts.join(cited, ["conv_key", "msg_ord"], "left")
    return joined.select(
        "conv_key",
        F.col("msg_ord").alias("ordinal"),
        "msg_uuid",
        T.js_trim(F.concat("text", T.source_lines(F.col("pairs")))).alias("text"),
    )


def integrity_report(blocks: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_key, total_blocks, classified_blocks, complete)."""
    counts = (
        _parsed(blocks)
        .withColumn("kind", block_kind(F.col("v")))
        .groupBy("conv_key")
        .agg(
            F.count("*").alias("total_blocks"),
            F.count_if(F.col("kind") != "unknown").alias("classified_blocks"),
        )
    )
    if conversations is not None:
        counts = conversations.select("conv_key").join(counts, "conv_key", "left").fillna(0)
    return counts.withColumn("complete", F.col("total_blocks") == F.col("classified_blocks"))


def uploads(attachments: DataFrame) -> DataFrame:
    """attachments(conv_key, ordinal, file_name, file_type) -> first of each name."""
    named = (
        attachments.withColumn("name", T.js_trim(F.col("file_name")))
        .filter(F.length("name") > 0)
        .select("conv_key", F.lower("name").alias("key"), "ordinal", "name", F.nullif("file_type", F.lit("")).alias("type"))
    )
    return first_wins(named, ["conv_key", "key"], ["ordinal"]).select("conv_key", "ordinal", "name", "type")
