"""Chats that arrive as a flat list of messages: Perplexity, Grok, DeepSeek, HuggingChat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import text as T
from briefspark.sources.transcript import Transcript, bundle, message, renumber, title_or


def _parse(payloads: DataFrame) -> DataFrame:
    root = F.try_parse_json("payload")
    shaped = payloads.select("conv_key", "captured_at", "payload", root.alias("root"))
    return shaped.withColumn("ok", F.col("root").isNotNull())


def _role(is_human: Column) -> Column:
    return F.when(F.coalesce(is_human, F.lit(False)), F.lit("human")).otherwise(F.lit("assistant"))


def _kept(messages: Column, prefix: str) -> Column:
    return renumber(
        F.filter(messages, lambda m: T.has_text(F.coalesce(m["text"], F.lit("")))), prefix
    )


def _trimmed(v: Column) -> Column:
    return T.js_trim(F.coalesce(T.variant_text(v), F.lit("")))


def _blank_id() -> Column:
    return F.lit(None).cast("string")


# -- HuggingChat ----------------------------------------------------------------------


def normalize_hf(payloads: DataFrame) -> Transcript:
    parsed = _parse(payloads).withColumn(
        "body", F.coalesce(T.variant_field(F.col("root"), "$.json"), F.col("root"))
    )
    raw = F.filter(
        T.variant_list(F.col("body"), "$.messages"),
        lambda m: F.coalesce(T.variant_text(m, "$.from") != "system", F.lit(True)),
    )
    shaped = parsed.withColumn(
        "msgs",
        F.transform(
            raw,
            lambda m: message(
                _blank_id(),
                _role(T.variant_text(m, "$.from") == "user"),
                T.js_trim(F.coalesce(T.variant_text(m, "$.content"), F.lit(""))),
            ),
        ),
    )
    return bundle(
        shaped,
        messages=_kept(F.col("msgs"), "hf"),
        conversation_id=F.lit("huggingface-chat"),
        title=title_or(T.variant_text(F.col("body"), "$.title"), "HuggingFace chat"),
    )


# -- DeepSeek ---------------------------------------------------------------------------


def normalize_deepseek(payloads: DataFrame) -> Transcript:
    parsed = (
        _parse(payloads)
        .withColumn("data", F.coalesce(T.variant_field(F.col("root"), "$.data"), F.col("root")))
        .withColumn("biz", F.coalesce(T.variant_field(F.col("data"), "$.biz_data"), F.col("data")))
    )
    raw = F.coalesce(
        T.variant_list(F.col("biz"), "$.chat_messages"),
        T.variant_list(F.col("biz"), "$.messages"),
        T.variant_list(F.col("data"), "$.messages"),
    )
    shaped = parsed.withColumn(
        "msgs",
        F.transform(
            raw,
            lambda m: message(
                _blank_id(),
                _role(F.lower(T.variant_text(m, "$.role")).isin("user", "human")),
                T.js_trim(
                    F.coalesce(T.variant_text(m, "$.content"), T.variant_text(m, "$.content.text"), F.lit(""))
                ),
            ),
        ),
    )
    return bundle(
        shaped,
        messages=_kept(F.col("msgs"), "ds"),
        conversation_id=F.lit("deepseek"),
        title=F.lit("DeepSeek chat"),
    )


# -- Grok ---------------------------------------------------------------------------------


def normalize_grok(payloads: DataFrame) -> Transcript:
    parsed = _parse(payloads)

    def shape(m: Column, i: Column) -> Column:
        human = F.coalesce(F.lower(T.variant_text(m, "$.sender")) == "human", F.lit(False))
        query, said = T.variant_field(m, "$.query"), T.variant_field(m, "$.message")
        text = F.when(human, F.coalesce(query, said)).otherwise(F.coalesce(said, query))
        at = F.try_to_timestamp(T.variant_text(m, "$.createTime"))
        return F.struct(
            F.coalesce(F.unix_millis(at), F.lit(0).cast("bigint")).alias("at"),
            i.alias("i"),
            (T.variant_truthy(m, "$.isControl") | T.variant_truthy(m, "$.partial")).alias("skip"),
            message(_blank_id(), _role(human), _trimmed(text)).alias("m"),
        )

    shaped = parsed.withColumn(
        "items", F.transform(T.variant_list(F.col("root"), "$.responses"), shape)
    ).withColumn(
        "msgs",
        F.transform(F.filter(F.array_sort("items"), lambda x: ~x["skip"]), lambda x: x["m"]),
    )
    return bundle(
        shaped,
        messages=_kept(F.col("msgs"), "grok"),
        conversation_id=F.lit("grok"),
        title=title_or(T.variant_text(F.col("root"), "$.title"), "Grok chat"),
    )


# -- Perplexity -------------------------------------------------------------------------------


def normalize_perplexity(payloads: DataFrame) -> Transcript:
    parsed = _parse(payloads)
    raw = F.coalesce(
        T.variant_list(T.variant_field(F.col("root"), "$.chat_messages")),
        F.when(
            T.variant_field(F.col("root"), "$.chat_messages").isNull(),
            T.variant_list(F.col("root"), "$.entries"),
        ),
    )

    def source(s: Column) -> Column:
        link = F.coalesce(T.variant_field(s, "$.url"), T.variant_field(s, "$.link"))
        title = F.coalesce(T.variant_field(s, "$.title"), T.variant_field(s, "$.name"))
        shown = T.let(title, lambda t: F.coalesce(T.variant_text(t), F.to_json(t)))
        return T.let(
            F.coalesce(T.variant_text(s), T.variant_text(link)),
            lambda url: F.struct(F.coalesce(shown, url).alias("title"), url.alias("url")),
        )

    def entry(m: Column) -> Column:
        asked = T.js_trim(F.coalesce(T.variant_text(m, "$.query"), F.lit("")))
        answer = F.coalesce(
            T.variant_field(m, "$.text"), T.variant_field(m, "$.content"), T.variant_field(m, "$.answer")
        )
        none = F.expr("cast(array() as array<variant>)")
        cards = F.concat(
            *[
                F.coalesce(T.variant_list(m, f"$.{name}"), none)
                for name in ("search_results", "web_results", "sources", "citations")
            ]
        )
        pairs = F.filter(F.transform(cards, source), lambda p: p["url"].isNotNull())
        body = F.concat(_trimmed(answer), T.source_lines(T.first_per_url(pairs)))
        who = F.lower(T.variant_text(F.coalesce(T.variant_field(m, "$.sender"), T.variant_field(m, "$.role"))))
        return F.array(
            message(_blank_id(), F.lit("human"), asked),
            message(_blank_id(), _role(who.isin("user", "human")), body),
        )

    shaped = parsed.withColumn("msgs", F.flatten(F.transform(raw, entry)))
    return bundle(
        shaped,
        messages=_kept(F.col("msgs"), "pplx"),
        conversation_id=F.coalesce(T.variant_text(F.col("root"), "$.slug"), F.lit("perplexity")),
        title=title_or(T.variant_text(F.col("root"), "$.title"), "Perplexity thread"),
    )
