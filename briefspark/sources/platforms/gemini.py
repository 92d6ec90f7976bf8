"""Gemini: framed text around positional arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions.strings import read_json, valid
from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.sources.transcript import (
    Transcript,
    artifact,
    bundle,
    explode_artifacts,
    message,
    renumber,
)


def _longest(text: str) -> str:
    """The longest string in the nested lists of a JSON text (first of equals)."""
    try:
        best, todo = "", [read_json(text)]
    except ValueError:
        return ""
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            best = x if len(x) > len(best) else best
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return valid(best)


def _with_docs(df: DataFrame) -> DataFrame:
    """df(conv_key, n, canvas) -> (conv_key, n, docs): the longest string of each block."""
    key = dict(df.dtypes)["conv_key"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs = [[_longest(t) for t in ([] if c is None else c)] for c in pdf["canvas"]]
            yield pd.DataFrame({"conv_key": pdf["conv_key"], "n": pdf["n"], "docs": docs})

    return df.mapInPandas(read, f"conv_key {key}, n bigint, docs array<string>")


def _text(v: Column, path: str) -> Column:
    return T.js_trim(F.coalesce(T.variant_text(v, path), F.lit("")))


def _candidate_text(c: Column) -> Column:
    return T.let(
        _text(c, "$[1][0]"),
        lambda primary: F.when((primary != "") & ~primary.startswith(K.GEMINI_CARD), primary).otherwise(
            F.coalesce(F.nullif(_text(c, "$[22][0]"), F.lit("")), primary)
        ),
    )


def rpc_payload(framed: Column, rpc: str = K.GEMINI_READ_RPC) -> Column:
    """The payload of the first frame of a call, as a variant."""
    lines = F.transform(F.split(F.regexp_replace(framed, r"^\)\]\}'", ""), "\n"), T.js_trim)
    frames = F.flatten(
        F.transform(
            F.filter(lines, lambda x: x.startswith("[")),
            lambda x: F.coalesce(
                T.variant_list(F.try_parse_json(x)), F.expr("cast(array() as array<variant>)")
            ),
        )
    )
    hits = F.filter(
        frames,
        lambda f: F.coalesce(
            (T.variant_text(f, "$[0]") == "wrb.fr")
            & (T.variant_text(f, "$[1]") == rpc)
            & T.variant_text(f, "$[2]").isNotNull(),
            F.lit(False),
        ),
    )
    return F.try_parse_json(T.variant_text(F.get(hits, F.lit(0)), "$[2]"))


def normalize_gemini(payloads: DataFrame) -> Transcript:
    parsed = payloads.select(
        "conv_key", "captured_at", "payload", rpc_payload(F.col("payload")).alias("root")
    ).withColumn("ok", F.col("root").isNotNull())

    def turn(t: Column) -> Column:
        def pick(drafts: Column) -> Column:
            spoken = F.filter(drafts, lambda c: F.schema_of_variant(c).startswith("ARRAY") & (_candidate_text(c) != ""))
            return F.coalesce(F.get(spoken, F.lit(0)), F.get(drafts, F.lit(0)))

        return T.let(
            T.let(T.variant_list(t, "$[3][0]"), pick),
            lambda chosen: F.struct(
                _text(t, "$[2][0][0]").alias("asked"),
                F.coalesce(_candidate_text(chosen), F.lit("")).alias("said"),
                F.when(
                    T.variant_truthy(chosen, "$[30]"), F.to_json(F.try_variant_get(chosen, "$[30]", "variant"))
                ).alias("canvas"),
            ),
        )

    turns = parsed.withColumn(
        "turns", F.reverse(F.transform(T.variant_list(F.col("root"), "$[0]"), turn))
    )
    none = F.lit(None).cast("string")
    shaped = turns.withColumn(
        "msgs",
        F.filter(
            F.flatten(
                F.transform(
                    "turns",
                    lambda t: F.array(
                        message(none, F.lit("human"), t["asked"]),
                        message(none, F.lit("assistant"), t["said"]),
                    ),
                )
            ),
            lambda m: m["text"] != "",
        ),
    ).withColumn(
        "canvas",
        F.filter(F.transform("turns", lambda t: t["canvas"]), lambda c: c.isNotNull()),
    )
    n = F.coalesce(F.size("msgs"), F.lit(0)).cast("bigint").alias("n")
    kept = F.filter(
        F.transform(F.filter("docs", lambda d: F.length(d) > K.CANVAS_DOC_MIN), T.js_trim), lambda d: d != ""
    )

    # Python runs for these tables only, and only when they are asked for
    def artifacts() -> DataFrame:
        held = _with_docs(shaped.filter(F.size("canvas") > 0).select("conv_key", n, "canvas"))
        made = F.transform(
            kept,
            lambda d, i: artifact(
                F.concat(F.lit("gemini-canvas-"), (i + 1).cast("string"), F.lit(".md")),
                d,
                msg_uuid=F.lit("gemini-canvas"),
                presented=F.lit(True),
            ),
        )
        return explode_artifacts(held, made)

    def integrity() -> DataFrame:
        held = _with_docs(shaped.filter("ok").select("conv_key", n, "canvas"))
        total = (F.col("n") + F.size(kept)).cast("bigint")
        return held.select(
            "conv_key", total.alias("total_blocks"), total.alias("classified_blocks"), F.lit(True).alias("complete")
        )

    return bundle(
        shaped,
        messages=renumber(F.col("msgs"), "gm"),
        conversation_id=F.lit("gemini"),
        title=F.lit("Gemini conversation"),
        artifacts=artifacts,
        integrity=integrity,
    )
