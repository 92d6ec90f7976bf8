"""Deterministic extraction: the exact facts of a conversation.

Inputs are the tables ``messages(conv_key, ordinal, role, text, images)`` and
``artifacts(conv_key, ordinal, artifact_id, title, filename, language, content,
msg_uuid, binary, presented)``.  Every finder matches inside one row and then
keeps the first of each value with a pre-aggregated group-by.  Outputs:

* verbatim items ``(conv_key, src, ordinal, pos, kind, label, value, language)``
* files to attach ``(conv_key, src, ordinal, pos, name, why, source)``

where (src, ordinal, pos) is the order of an item in its conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.operators.ordered import (
    Rule,
    assemble,
    block_of,
    first_wins,
    last_wins,
    previous,
    running,
)

VERBATIM = ["conv_key", "src", "ordinal", "pos", "kind", "label", "value", "language"]
FILES = ["conv_key", "src", "ordinal", "pos", "name", "why", "source"]

# order of the sources in the brief
SRC_TABLE_MESSAGE, SRC_TABLE_ARTIFACT, SRC_IMAGE, SRC_FORMULA = 0, 1, 2, 3
SRC_ARTIFACT_CODE, SRC_FENCE, SRC_URL, SRC_ENDPOINT = 4, 5, 6, 7
SRC_FILE_ARTIFACT, SRC_FILE_GENERATED, SRC_FILE_UPLOAD, SRC_FILE_REFERENCED = 0, 1, 2, 3


FACT = "array<struct<src:int,pos:int,kind:string,label:string,value:string,language:string,key:string>>"
CHAT_FILE, MENTIONED_FILE = "chat file", "mentioned file"


def fact(src: int, pos, kind: str, label, value, language=None, key=None) -> Column:
    """One found fact; ``key`` is what two equal facts share (value by default)."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(
        F.lit(src).cast("int").alias("src"),
        pos.cast("int").alias("pos"),
        F.lit(kind).alias("kind"),
        text(label).alias("label"),
        value.alias("value"),
        (F.lit(None).cast("string") if language is None else language).alias("language"),
        (value if key is None else key).alias("key"),
    )


def facts_in(messages: DataFrame, *finders, text: str = "text") -> DataFrame:
    """All facts of the texts in one pass over the table.

    (conv_key, ordinal, src, pos, kind, label, value, language, key)
    """
    c = F.col(text)
    found = finders[0](c) if len(finders) == 1 else F.concat(*[F.coalesce(f(c), F.array().cast(FACT)) for f in finders])
    # outer, then filtered: for the inner form the optimizer adds a filter on the
    # size of the array, which would run every pattern twice
    return messages.select(
        "conv_key", F.col("ordinal").cast("bigint").alias("ordinal"), F.inline_outer(found)
    ).filter(F.col("kind").isNotNull())


def first_facts(facts: DataFrame) -> DataFrame:
    """First of each (kind, key) of a conversation; equal to removing repeats per
    source and then over all sources, since sources of one kind share the key."""
    return first_wins(facts, ["conv_key", "kind", "key"], ["src", "ordinal", "pos"])


def as_verbatim(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("kind").isin(CHAT_FILE, MENTIONED_FILE)).select(*VERBATIM)


def as_files(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind").isin(CHAT_FILE, MENTIONED_FILE)).select(
        "conv_key",
        "src",
        "ordinal",
        "pos",
        F.col("value").alias("name"),
        F.col("label").alias("why"),
        F.when(F.col("kind") == CHAT_FILE, F.lit("chat")).otherwise(F.lit("referenced")).alias("source"),
    )


def _files(df: DataFrame, src: int, name: Column, why: Column, source: str) -> DataFrame:
    return df.select(
        "conv_key",
        F.lit(src).alias("src"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("pos").cast("int").alias("pos"),
        name.alias("name"),
        why.alias("why"),
        F.lit(source).alias("source"),
    )


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key."""
    return first_wins(df, keys, order)


# -- tables -------------------------------------------------------------------

# header line with a pipe, separator line, at least one line with a pipe; the
# possessive loops keep the match linear and free of recursion on long tables
TABLE_BLOCK = (
    r"(?md)^[^|\n]*+\|[^\n]*+\n"
    rf"(?=[^|\n]*+\|)(?=[^\n-]*+-)[{K.BLANK_IN_LINE}|:-]++"
    r"(?:\n[^|\n]*+\|[^\n]*+)++"
)


def markdown_tables(text: Column) -> Column:
    """Every markdown table of a text, lines trimmed -> array<string>."""
    blocks = F.regexp_extract_all(text, F.lit(TABLE_BLOCK), F.lit(0))
    return F.transform(
        blocks,
        lambda b: F.array_join(F.transform(F.split(b, "\n"), T.js_trim), "\n"),
    )


def extract_tables(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.filter(F.contains(F.col(text), F.lit("|"))).select(
        "conv_key", "ordinal", F.posexplode_outer(markdown_tables(F.col(text))).alias("pos", "table")
    ).filter(F.col("table").isNotNull())


def table_facts(src: int = SRC_TABLE_MESSAGE):
    def find(text: Column) -> Column:
        tables = F.when(F.contains(text, F.lit("|")), markdown_tables(text))
        return F.filter(
            F.transform(tables, lambda t, i: fact(src, i, "table", "table", t, key=T.drop_blanks(t))),
            lambda f: F.length(f["key"]) >= K.TABLE_KEY_MIN,
        )

    return find


def tables_verbatim(messages: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    found = facts_in(messages, table_facts())
    if artifacts is not None:
        found = found.unionByName(facts_in(artifacts, table_facts(SRC_TABLE_ARTIFACT), text="content"))
    return first_facts(found).select(*VERBATIM)


def table_cells(tables: DataFrame, table: str = "table") -> DataFrame:
    """Markdown table -> one row per body cell (row, col, header, value)."""
    lines = F.filter(F.split(T.js_trim(F.col(table)), "\n"), lambda x: F.contains(x, F.lit("|")))

    def cells(line: Column) -> Column:
        skip = lambda p: F.slice(p, F.when(F.get(p, F.lit(0)) == "", F.lit(2)).otherwise(F.lit(1)), F.size(p))
        last = lambda c: F.slice(
            c,
            F.lit(1),
            F.size(c) - F.when(F.get(c, F.size(c) - 1) == "", F.lit(1)).otherwise(F.lit(0)),
        )
        return T.let(T.let(F.transform(F.split(line, r"\|"), T.js_trim), skip), last)

    keep = [c for c in tables.columns if c != table]
    shaped = tables.select(*keep, lines.alias("__lines")).filter(
        (F.size("__lines") >= 2)
        & F.get("__lines", F.lit(1)).rlike(rf"^{K.SEPARATOR_LINE}\z")
    )
    rows = shaped.select(
        *keep,
        cells(F.get("__lines", F.lit(0))).alias("__head"),
        F.posexplode(F.slice("__lines", F.lit(3), F.greatest(F.size("__lines"), F.lit(3)))).alias("row", "__line"),
    )
    return rows.select(
        *keep, "row", "__head", F.posexplode(cells(F.col("__line"))).alias("col", "value")
    ).select(*keep, "row", "col", F.get("__head", F.col("col")).alias("header"), "value")


# -- images ---------------------------------------------------------------------


def image_facts(messages: DataFrame) -> DataFrame:
    shown = messages.filter(F.size("images") > 0).select("conv_key", "ordinal", "images")
    last = last_wins(shown, ["conv_key"], ["ordinal"])
    value = lambda x: F.coalesce(F.nullif(T.js_trim(x), F.lit("")), F.lit("image"))
    return last.select(
        "conv_key",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.inline(
            F.transform(
                "images", lambda x, i: fact(SRC_IMAGE, i, "image", "image shown", value(x), key=F.lower(value(x)))
            )
        ),
    )


def latest_images(messages: DataFrame) -> DataFrame:
    """Subjects of the last message that shows any image."""
    return first_facts(image_facts(messages)).select(*VERBATIM)


# -- patterns that may run over the border between two messages -------------------
#
# The conversation text is its messages joined by a line break, and formulas and
# endpoints may hold blanks, so a match can begin in one message and end in a later
# one.  Texts are never joined for that: each message is matched on its own, and
# only the few characters at its ends that could take part travel to the neighbour.

_RUN = rf"[A-Z0-9$=+*/{K.BLANK}-]"  # what a formula is made of
_ENDS = rf"(?:{K.CELL}|[-+*/=])[{K.BLANK}]*\z"
_STARTS = rf"^[{K.BLANK}]*(?:\$?{K.CELL}|[-+*/=])"
_TAIL = rf"(?s)(.?{_RUN}+)\z"
_HEAD = rf"^{_RUN}+"


def _core(text: Column) -> Column:
    """The text without the ends that are matched together with the neighbours."""
    cut = F.when(text.rlike(_ENDS), F.regexp_replace(text, rf"{_RUN}++\z", "")).otherwise(text)
    return F.when(text.rlike(_STARTS), F.regexp_replace(cut, rf"{_HEAD}", "")).otherwise(cut)


def formula_facts(text: Column) -> Column:
    """Formulas inside one message, away from its borders."""
    hits = F.when(F.contains(text, F.lit("=")), T.find_all(_core(text), K.FORMULA))
    return F.transform(
        hits, lambda h, i: fact(SRC_FORMULA, i + 2**20, "constraint", "formula", T.drop_blanks(h))
    )


def endpoint_facts(text: Column) -> Column:
    hits = F.when(F.contains(text, F.lit("/")), T.find_all(text, K.ENDPOINT))
    part = lambda h, n: F.regexp_extract(h, K.edged(K.ENDPOINT), n)
    return F.transform(
        hits, lambda h, i: fact(SRC_ENDPOINT, i, "api", "endpoint", F.concat_ws(" ", part(h, 1), part(h, 2)))
    )


def borders(messages: DataFrame) -> DataFrame:
    """The ends of each non-blank message and those of the one before it."""
    text = F.col("text")
    tail_verb = K.edged(rf"\b({K.VERBS})[{K.BLANK}]*\z")
    left_over = T.replace_pattern(text, K.ENDPOINT, " ")
    edges = messages.filter(T.has_text(text)).select(
        "conv_key",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.when(text.rlike(_STARTS), F.regexp_extract(text, _HEAD, 0)).alias("head"),
        F.when(text.rlike(_ENDS), F.regexp_extract(text, _TAIL, 1)).alias("tail"),
        (~text.rlike(rf"[^A-Z0-9$=+*/{K.BLANK}-]")).alias("whole"),
        F.when(
            text.rlike(rf"(?:{K.VERBS})[{K.BLANK}]*\z"), F.nullif(F.regexp_extract(left_over, tail_verb, 1), F.lit(""))
        ).alias("verb"),
        F.nullif(F.regexp_extract(text, rf"^[{K.BLANK}]*(/[^{K.BLANK}{K.URL_STOP}]+)", 1), F.lit("")).alias("path"),
    )
    return previous(edges, ["conv_key"], "ordinal")


def border_endpoints(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("path").isNotNull() & F.col("prev.verb").isNotNull()).select(
        "conv_key",
        F.col("prev.ordinal").alias("ordinal"),
        F.inline(
            F.array(
                fact(SRC_ENDPOINT, F.lit(2**31 - 1), "api", "endpoint", F.concat_ws(" ", "prev.verb", "path"))
            )
        ),
    )


def border_formulas(linked: DataFrame) -> DataFrame:
    """Formulas at the ends of messages, joined with the neighbour's end."""
    edge = linked.filter(F.col("head").isNotNull() | F.col("tail").isNotNull())
    piece = lambda sub, text, joins: F.struct(
        F.lit(sub).alias("sub"), text.alias("piece"), joins.alias("joins")
    )
    meets = F.coalesce(F.col("head").isNotNull() & F.col("prev.tail").isNotNull(), F.lit(False))
    whole = F.array(piece(0, F.coalesce("head", "tail"), meets))
    ends = F.filter(
        F.array(piece(0, F.col("head"), meets), piece(1, F.col("tail"), F.lit(False))),
        lambda p: p["piece"].isNotNull(),
    )
    pieces = edge.select(
        "conv_key", "ordinal", F.inline(F.when(F.col("whole"), whole).otherwise(ends))
    ).withColumn("__block", block_of("ordinal"))
    at = F.col("ordinal") * 2 + F.col("sub")
    chained = running(
        pieces, ["conv_key"], ["__block"], ["ordinal", "sub"], maxima={"chain": F.when(~F.col("joins"), at)}
    )
    joined = chained.groupBy("conv_key", "chain").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "sub", "piece"))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "\n")
    hits = F.when(F.contains(text, F.lit("=")), T.find_all(text, K.FORMULA))
    late = (F.col("chain") % 2) * 2**30
    return joined.select(
        "conv_key",
        F.floor(F.col("chain") / 2).cast("bigint").alias("ordinal"),
        F.inline(
            F.transform(
                hits, lambda h, i: fact(SRC_FORMULA, i + late, "constraint", "formula", T.drop_blanks(h))
            )
        ),
    )


def formulas(messages: DataFrame) -> DataFrame:
    """Cell formulas of the conversation text, blanks removed, first of each."""
    found = facts_in(messages, formula_facts).unionByName(border_formulas(borders(messages)))
    return first_facts(found).select(*VERBATIM)


def endpoints(messages: DataFrame) -> DataFrame:
    """VERB /path mentions; the verb may end one message and the path start the next."""
    found = facts_in(messages, endpoint_facts).unionByName(border_endpoints(borders(messages)))
    return first_facts(found).select(*VERBATIM)


# -- patterns without blanks: one message at a time --------------------------------


def fence_facts(text: Column) -> Column:
    fenced = F.when(
        F.contains(text, F.lit("```")),
        F.arrays_zip(T.find_all(text, K.FENCE, 1).alias("lang"), T.find_all(text, K.FENCE, 2).alias("body")),
    )
    label = lambda f: F.when(f["lang"] != "", F.concat(f["lang"], F.lit(" snippet"))).otherwise(F.lit("code snippet"))
    found = F.transform(
        fenced,
        lambda f, i: fact(SRC_FENCE, i, "code", label(f), T.js_trim(f["body"]), F.nullif(f["lang"], F.lit(""))),
    )
    return F.filter(found, lambda f: F.length(f["value"]).between(K.FENCED_CODE_MIN, K.INLINE_CODE_MAX))


def url_facts(text: Column) -> Column:
    hits = F.when(F.contains(text, F.lit("://")), T.find_all(text, K.URL))
    return F.transform(hits, lambda u, i: fact(SRC_URL, i, "api", "url", u))


def generated_facts(text: Column) -> Column:
    hits = F.when(F.contains(text, F.lit("/mnt/data/")), T.find_all(text, K.SANDBOX_FILE, 1))
    name = lambda p: T.basename_of(p)
    found = F.transform(
        hits, lambda p, i: fact(SRC_FILE_GENERATED, i, CHAT_FILE, K.WHY_GENERATED, name(p), key=F.lower(name(p)))
    )
    return F.filter(found, lambda f: f["value"] != "")


def mentioned_facts(text: Column) -> Column:
    hits = F.when(text.rlike(K.FILE_ENDING), T.find_all(text, K.FILENAME, 1))
    found = F.transform(
        hits, lambda p, i: fact(SRC_FILE_REFERENCED, i, MENTIONED_FILE, K.WHY_REFERENCED, p, key=T.stem_of(p))
    )
    return F.filter(found, lambda f: ~T.is_sandbox_path(f["value"]) & ~T.looks_like_url(f["value"]))


def fenced_code(messages: DataFrame) -> DataFrame:
    return first_facts(facts_in(messages, fence_facts)).select(*VERBATIM)


def urls(messages: DataFrame) -> DataFrame:
    return first_facts(facts_in(messages, url_facts)).select(*VERBATIM)


def generated_files(messages: DataFrame) -> DataFrame:
    return as_files(first_facts(facts_in(messages, generated_facts)))


def first_mentions(facts: DataFrame, artifacts: DataFrame | None, cap: int | None) -> DataFrame:
    """Mentioned files that no artifact is named after (the first ``cap``, if given)."""
    firsts = facts.filter(F.col("kind") == MENTIONED_FILE)
    if artifacts is not None:
        produced = (
            artifacts.filter(F.coalesce("filename", F.lit("")) != "")
            .select("conv_key", T.stem_of(F.col("filename")).alias("key"))
            .filter(F.col("key") != "")
            .distinct()
        )
        firsts = firsts.join(produced, ["conv_key", "key"], "left_anti")
    if cap is not None:
        # row_number() <= cap is limited on the map side, before the exchange
        rank = F.row_number().over(Window.partitionBy("conv_key").orderBy("ordinal", "pos"))
        firsts = firsts.withColumn("__rank", rank).filter(F.col("__rank") <= cap)
    return as_files(firsts)


def referenced_files(
    messages: DataFrame, artifacts: DataFrame | None = None, cap: int | None = None
) -> DataFrame:
    """Filenames mentioned but not produced, first mention per stem; with ``cap``, the
    first so many of each conversation."""
    return first_mentions(first_facts(facts_in(messages, mentioned_facts)), artifacts, cap)


def conversation_facts(
    messages: DataFrame, artifacts: DataFrame | None = None, images: bool = True
) -> DataFrame:
    """Every fact of the conversations, in one pass over the messages; images=False
    is for messages without such a column.

    One exchange on (conversation, kind, key) then keeps the first of each.
    """
    linked = borders(messages)
    found = (
        facts_in(
            messages,
            table_facts(),
            formula_facts,
            fence_facts,
            url_facts,
            endpoint_facts,
            generated_facts,
            mentioned_facts,
        )
        .unionByName(border_formulas(linked))
        .unionByName(border_endpoints(linked))
    )
    if images:
        found = found.unionByName(image_facts(messages))
    if artifacts is not None:
        found = found.unionByName(facts_in(artifacts, table_facts(SRC_TABLE_ARTIFACT), text="content")).unionByName(
            inline_facts(artifacts)
        )
    return first_facts(found)


# -- artifacts, files, the state line -----------------------------------------------


def _goes_as_file() -> Column:
    return (
        F.coalesce("binary", F.lit(False))
        | F.coalesce("presented", F.lit(False))
        | (F.length("content") > K.INLINE_CODE_MAX)
        | F.coalesce(F.col("msg_uuid") == "reconstructed", F.lit(False))
    )


def inline_facts(artifacts: DataFrame) -> DataFrame:
    label = F.coalesce("filename", "title", F.concat(F.lit("artifact "), "artifact_id"))
    one = fact(SRC_ARTIFACT_CODE, F.lit(0), "code", label, F.col("content"), F.nullif("language", F.lit("")))
    return artifacts.filter(~_goes_as_file()).select(
        "conv_key", F.col("ordinal").cast("bigint").alias("ordinal"), F.inline(F.array(one))
    )


def artifact_files(artifacts: DataFrame) -> DataFrame:
    binary = F.coalesce("binary", F.lit(False))
    presented = F.coalesce("presented", F.lit(False))
    fallback = F.concat(F.lit("artifact-"), "artifact_id")
    name = F.when(binary, F.coalesce("filename", fallback)).otherwise(F.coalesce("filename", "title", fallback))
    why = (
        F.when(binary & presented, F.lit(K.WHY_BINARY_PRESENTED))
        .when(binary, F.lit(K.WHY_BINARY))
        .when(presented, F.lit(K.WHY_PRESENTED))
        .otherwise(F.lit(K.WHY_PRODUCED))
    )
    return _files(artifacts.filter(_goes_as_file()).withColumn("pos", F.lit(0)), SRC_FILE_ARTIFACT, name, why, "chat")


def split_artifacts(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small code goes inline, everything delivered or long becomes a file."""
    return inline_facts(artifacts).select(*VERBATIM), artifact_files(artifacts)


def upload_files(uploads: DataFrame) -> DataFrame:
    return _files(
        uploads.withColumn("pos", F.lit(0)),
        SRC_FILE_UPLOAD,
        F.col("name"),
        F.lit(K.WHY_UPLOADED),
        "referenced",
    )


def dedupe_verbatim(*items: DataFrame) -> DataFrame:
    """First of each (kind, value) over all sources in their fixed order."""
    return first_wins(
        reduce(DataFrame.unionByName, items), ["conv_key", "kind", "value"], ["src", "ordinal", "pos"]
    ).select(*VERBATIM)


def dedupe_files_by_stem(files: DataFrame) -> DataFrame:
    """Every produced file by full name; mentions by stem unless produced."""
    named = files.withColumn(
        "name",
        F.when(T.is_sandbox_path(F.col("name")), T.basename_of(F.col("name"))).otherwise(F.col("name")),
    )
    chat = first_wins(
        named.filter(F.col("source") == "chat").withColumn("key", F.lower("name")),
        ["conv_key", "key"],
        ["src", "ordinal", "pos"],
    )
    mentioned = first_wins(
        named.filter(F.col("source") != "chat").withColumn("key", T.stem_of(F.col("name"))),
        ["conv_key", "key"],
        ["src", "ordinal", "pos"],
    )
    stems = chat.select("conv_key", T.stem_of(F.col("name")).alias("key")).distinct()
    free = mentioned.join(stems, ["conv_key", "key"], "left_anti")
    return chat.select(*FILES).unionByName(free.select(*FILES))


# codes of the state line: opening, names after an own lead, names alone
NOW_OPENING, NOW_NAMES, NOW_LISTED = 10, 11, 12
NOW_RULES = {
    NOW_OPENING: Rule(group=1),
    NOW_NAMES: Rule(group=1, sep=", ", lead=" Files produced: ", close="."),
    NOW_LISTED: Rule(group=1, sep=", ", close="."),
}


def name_units(files: DataFrame, code: int) -> DataFrame:
    """Names of the produced files as text units."""
    return files.filter(F.col("source") == "chat").select(
        "conv_key", F.lit(code).alias("code"), "src", "ordinal", "pos", F.col("name").alias("text")
    )


def opening_units(openings: DataFrame) -> DataFrame:
    """openings(conv_key, text) as the first text unit of the state line."""
    return openings.select(
        "conv_key",
        F.lit(NOW_OPENING).alias("code"),
        F.lit(0).alias("src"),
        F.lit(0).cast("bigint").alias("ordinal"),
        F.lit(0).alias("pos"),
        "text",
    )


def now_units(messages: DataFrame, files: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The state line of the extraction as ordered text units."""
    counts = messages.groupBy("conv_key").agg(F.count("*").alias("n"))
    if conversations is not None:
        counts = conversations.select("conv_key").join(counts, "conv_key", "left").fillna(0, ["n"])
    text = F.concat(F.lit("Captured this conversation ("), F.col("n").cast("string"), F.lit(" messages)."))
    return opening_units(counts.withColumn("text", text)).unionByName(name_units(files, NOW_NAMES))


def tier0_now(
    messages: DataFrame, files: DataFrame, conversations: DataFrame | None = None
) -> DataFrame:
    """(conv_key, part, now); one part unless the list of files is very long."""
    return assemble(now_units(messages, files, conversations), NOW_RULES).select("conv_key", "part", F.col("text").alias("now"))
