"""Rendering a brief.

A brief is a set of long tables (``Brief``).  Rendering turns them into ordered
text units and joins those, so lengths can be measured without building texts and
a very long brief comes out in several parts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.operators.extract import NOW_OPENING, NOW_RULES
from briefspark.operators.ordered import Rule, assemble, total_chars


@dataclass
class Brief:
    """meta(conv_key, conversation_id, title, captured_at, produced_by, complete,
    unknown_count, notes) and the tables of its sections, all keyed by conv_key.

    now: text units (code, src, ordinal, pos, text); decided(text, replaces), open(text),
    rejected(idea, why), verbatim, files: each with (src, ordinal, pos);
    unknown(msg_ord, block_ord, msg_uuid, hint, preview).
    """

    meta: DataFrame
    now: DataFrame
    decided: DataFrame
    open: DataFrame
    rejected: DataFrame
    verbatim: DataFrame
    files: DataFrame
    unknown: DataFrame


def render_item(kind: Column, label: Column, value: Column, language: Column) -> Column:
    strong = F.concat(F.lit("**"), label, F.lit("**"))
    is_url = value.rlike(r"(?i)^(https?:|data:image/)")
    return (
        F.when(kind == "table", F.concat(strong, F.lit("\n\n"), value))
        .when(
            kind == "code",
            F.concat(strong, F.lit("\n\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), value, F.lit("\n```")),
        )
        .when((kind == "image") & is_url, F.concat(F.lit("!["), label, F.lit("]("), value, F.lit(")")))
        .when(kind == "image", F.concat(F.lit("- "), strong, F.lit(" (image): "), value))
        .otherwise(F.concat(F.lit("- "), strong, F.lit(" ("), kind, F.lit("): `"), value, F.lit("`")))
    )


def render_decided(text: Column, replaces: Column) -> Column:
    return F.concat(
        F.lit("- "), text, F.coalesce(F.concat(F.lit(" _(replaced: "), F.nullif(replaces, F.lit("")), F.lit(")_")), F.lit(""))
    )


def render_rejected(idea: Column, why: Column) -> Column:
    return F.concat(F.lit("- **"), idea, F.lit("**, "), why)


def render_file(name: Column, why: Column, source: Column) -> Column:
    return F.concat(F.lit("- `"), name, F.lit("`, "), why, F.lit(" _("), source, F.lit(")_"))


def render_unknown(hint: Column, uuid: Column, preview: Column) -> Column:
    return F.concat(F.lit("- `"), hint, F.lit("` (message "), F.substring(uuid, 1, 8), F.lit("): "), preview)


def honesty_banner(complete: Column, unknown_count: Column, notes: Column) -> Column:
    """Warning lines; "" when the capture is complete and nothing fell back."""
    clean = F.when(
        ~complete,
        F.concat(
            F.lit("> ⚠️ **Capture not 100% clean.** "),
            unknown_count.cast("string"),
            F.lit(
                " block(s) could not be parsed and are listed raw below, review them; nothing was dropped silently."
            ),
        ),
    )
    fell = F.when(
        F.coalesce(F.size(notes), F.lit(0)) > 0,
        F.concat(F.lit("> ⚠️ **Distiller fell back** in places: "), F.array_join(notes, " ")),
    )
    return F.concat_ws("\n", clean, fell)


def brief_header(title: Column, produced_by: Column, captured_at: Column, brand: str) -> Column:
    date = F.nullif(F.substring(F.coalesce(captured_at, F.lit("")), 1, 10), F.lit(""))
    stamp = F.concat_ws(
        " · ",
        F.lit(f"schema v{K.SCHEMA_VERSION}"),
        F.concat(F.lit("produced by "), produced_by),
        F.concat(F.lit("generated "), date),
    )
    return F.concat(
        F.lit("# Handoff brief, "), title, F.lit(f"\n\n_{brand} · "), stamp, F.lit("._\n")
    )


CODE = {name: 10 * (i + 1) for i, name in enumerate(K.SECTIONS)}
BODY_RULES = {
    code: Rule(group=code, sep=K.SECTIONS[name][1], heading=f"## {K.SECTIONS[name][0]}\n\n", end="\n")
    for name, code in CODE.items()
} | {
    code: replace(rule, group=CODE["now"], heading="## Now\n\n", end="\n") for code, rule in NOW_RULES.items()
}
GAP = "\n"


def _units(df: DataFrame, section: str, text: Column) -> DataFrame:
    return df.select(
        "conv_key",
        F.lit(CODE[section]).alias("code"),
        F.col("src").cast("int").alias("src"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("pos").cast("int").alias("pos"),
        text.alias("text"),
    )


def body_units(brief: Brief) -> DataFrame:
    """The items of a brief as text units (conv_key, code, src, ordinal, pos, text)."""
    c = F.col
    opening = c("code") == NOW_OPENING
    now = brief.now.withColumn(
        "text", F.when(opening, F.regexp_replace("text", rf"^[{K.BLANK}]+", "")).otherwise(c("text"))
    )
    odd = brief.unknown.withColumns({"src": F.lit(0), "ordinal": c("msg_ord"), "pos": c("block_ord")})
    parts = [
        now.select("conv_key", "code", "src", "ordinal", "pos", "text"),
        _units(brief.decided, "decided", render_decided(c("text"), c("replaces"))),
        _units(brief.open, "open", F.concat(F.lit("- "), "text")),
        _units(brief.rejected, "rejected", render_rejected(c("idea"), c("why"))),
        _units(brief.verbatim, "verbatim", render_item(c("kind"), c("label"), c("value"), c("language"))),
        _units(brief.files, "files", render_file(c("name"), c("why"), c("source"))),
        _units(odd, "unknown", render_unknown(c("hint"), c("msg_uuid"), c("preview"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def render_body(brief: Brief) -> DataFrame:
    """(conv_key, part, body)."""
    return _body(brief).drop("last")


def _body(brief: Brief) -> DataFrame:
    return assemble(body_units(brief), BODY_RULES, GAP).withColumnRenamed("text", "body")


def _opening(first: Column, banner: Column, body: Column) -> Column:
    """Header or banner lines before the first part of a body."""
    return F.concat(
        first,
        F.when(banner != "", F.concat(F.lit("\n"), banner)).otherwise(F.lit("")),
        F.when(body != "", F.lit("\n")).otherwise(F.lit("")),
    )


def _framed(meta: DataFrame, brand: str) -> DataFrame:
    return meta.select(
        "conv_key",
        honesty_banner(F.col("complete"), F.col("unknown_count"), F.col("notes")).alias("banner"),
        brief_header(F.col("title"), F.col("produced_by"), F.col("captured_at"), brand).alias("header"),
    )


def render_brief(brief: Brief, brand: str = "briefspark") -> DataFrame:
    """(conv_key, part, human_md, resume_prompt, resume_header, resume_footer).

    The body is put together once; both framings only add their edges to its first
    and last part.
    """
    joined = (
        _framed(brief.meta, brand)
        .join(_body(brief), "conv_key", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("body", F.coalesce("body", F.lit("")))
    )
    first = F.col("part") == 0
    last = F.col("part") == F.coalesce("last", F.lit(0))
    edge = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    c = F.col
    return joined.select(
        "conv_key",
        "part",
        F.concat(edge(first, _opening(c("header"), c("banner"), c("body"))), "body").alias("human_md"),
        F.concat(
            edge(first, _opening(F.lit(K.RESUME_HEADER), c("banner"), c("body"))),
            "body",
            edge(last, F.lit("\n" + K.RESUME_FOOTER)),
        ).alias("resume_prompt"),
        F.lit(K.RESUME_HEADER).alias("resume_header"),
        F.lit(K.RESUME_FOOTER).alias("resume_footer"),
    )


def brief_chars(brief: Brief, brand: str = "briefspark") -> DataFrame:
    """(conv_key, brief_chars): length of the human framing without building it."""
    body = total_chars(body_units(brief), BODY_RULES, GAP)
    edges = _framed(brief.meta, brand).join(body, "conv_key", "left")
    some = F.when(F.col("chars") > 0, F.lit("x")).otherwise(F.lit(""))
    opening = _opening(F.col("header"), F.col("banner"), some)
    return edges.select(
        "conv_key", (F.length(opening) + F.coalesce("chars", F.lit(0))).cast("bigint").alias("brief_chars")
    )
