"""The model stage: prompts in, checked sections out, merged per conversation.

The model itself is a function that the caller supplies.  A failed call or an
output that does not parse is an error row, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.functions.strings import read_json
from briefspark.operators.ordered import first_wins, last_wins

SECTIONS = (
    "struct<now:string,"
    "decided:array<struct<text:string,replaces:string>>,"
    "open:array<struct<text:string>>,"
    "rejected:array<struct<idea:string,why:string>>,"
    "verbatim:array<struct<kind:string,label:string,value:string,language:string>>,"
    "files:array<struct<name:string,why:string,source:string>>>"
)


def complete_batch(
    prompts: DataFrame,
    complete: Callable[[str], str],
    partitions: int | None = None,
    concurrency: int = 4,
) -> DataFrame:
    """prompts(.., prompt) -> + output, error.

    ``partitions`` x ``concurrency`` bounds the calls in flight.
    """
    keep = [f for f in prompts.schema.fields if f.name != "prompt"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", output string, error string"

    def call(prompt):
        try:
            return complete(prompt), None
        except Exception as e:  # noqa: BLE001 - any failure of the client is data
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                done = list(pool.map(call, pdf["prompt"]))
                out = pdf.drop(columns="prompt")
                yield out.assign(output=[d[0] for d in done], error=[d[1] for d in done])

    spread = prompts.repartition(partitions) if partitions else prompts
    return spread.mapInPandas(run, ddl)


LEDGER = "asked string, output string, error string, batch int"


def complete_with_ledger(
    prompts: DataFrame,
    complete: Callable[[str], str],
    ledger: str,
    batches: int = 8,
    partitions: int = 4,
    concurrency: int = 4,
) -> DataFrame:
    """prompts(.., prompt) -> + output, error, by way of a ledger of answers at the path ``ledger``.

    Different prompts that have no answer there yet are asked in ``batches``, by hash; each batch's
    answers are appended before the next is asked.  So a run that failed goes on where it
    stopped: at most one batch is asked again (and a lost task's part of a batch, which Spark repeats).  Equal
    prompts are asked once.  A failed call is in the ledger with its error, and the next
    run asks again.  ``partitions`` x ``concurrency`` calls are in flight at most, over all
    tasks.  A null prompt is an error row and is not asked.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    key = F.sha2(F.col("prompt"), 256).alias("asked")
    wanted = prompts.filter("prompt IS NOT NULL").groupBy(key).agg(F.any_value("prompt").alias("prompt"))
    for batch in range(batches):
        answered = spark.read.schema(LEDGER).parquet(ledger).filter("error IS NULL").select("asked")
        mine = wanted.filter(F.pmod(F.xxhash64("asked"), F.lit(batches)) == batch)
        asked = complete_batch(mine.join(answered, "asked", "left_anti"), complete, partitions, concurrency)
        asked.withColumn("batch", F.lit(batch)).write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger)
    # an answer before an error, and of several the least, so that reading again gives the same
    least = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "output", "error"))
    best = found.groupBy("asked").agg(least.alias("answer"))
    none = F.when(F.col("prompt").isNull(), F.lit("no prompt"))
    rest = [F.col(c) for c in prompts.columns if c != "prompt"]
    joined = prompts.withColumn("asked", key).join(best, "asked", "left")
    return joined.select(*rest, F.col("answer.output").alias("output"), F.coalesce("answer.error", none).alias("error"))


# -- parsing ---------------------------------------------------------------------------


def close_truncated(text: str) -> str | None:
    """Cut JSON after its last complete array element and close what is open."""
    open_at_cut, cut, stack = None, -1, []
    quoted = escaped = False
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), (ch != '"' or escaped)
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            del stack[-1:]
            if stack and stack[-1] == "[":
                cut, open_at_cut = i + 1, list(stack)
    if open_at_cut is None:
        return None
    return text[:cut] + "".join("}" if c == "{" else "]" for c in reversed(open_at_cut))


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of texts that Spark could not read, NULL when beyond repair."""

    def repair(text):
        for candidate in (text, close_truncated(text) if text else None):
            try:
                return json.dumps(read_json(candidate)) if candidate else None
            except ValueError:
                continue
        return None

    return texts.map(repair)


repaired_json = repaired_json.asNondeterministic()


def _object_text(text: Column) -> Column:
    """From the first opening to the last closing brace; "" when there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def _sections(v: Column) -> Column:
    def items(name: str) -> Column:
        return F.coalesce(T.variant_list(v, f"$.{name}"), F.expr("cast(array() as array<variant>)"))

    def text(x: Column, name: str) -> Column:
        return F.coalesce(T.variant_text(x, f"$.{name}"), F.lit(""))

    def optional(x: Column, name: str) -> Column:
        return F.nullif(text(x, name), F.lit(""))

    kind = lambda x: T.let(
        text(x, "kind"), lambda k: F.when(k.isin(*K.VERBATIM_KINDS), k).otherwise(F.lit("constraint"))
    )
    source = lambda x: F.when(text(x, "source") == "referenced", F.lit("referenced")).otherwise(F.lit("chat"))
    return F.struct(
        F.coalesce(T.variant_text(v, "$.now"), F.lit("")).alias("now"),
        F.filter(
            F.transform(items("decided"), lambda x: F.struct(text(x, "text").alias("text"), optional(x, "replaces").alias("replaces"))),
            lambda x: x["text"] != "",
        ).alias("decided"),
        F.filter(
            F.transform(items("open"), lambda x: F.struct(text(x, "text").alias("text"))), lambda x: x["text"] != ""
        ).alias("open"),
        F.filter(
            F.transform(items("rejected"), lambda x: F.struct(text(x, "idea").alias("idea"), text(x, "why").alias("why"))),
            lambda x: x["idea"] != "",
        ).alias("rejected"),
        F.filter(
            F.transform(
                items("verbatim"),
                lambda x: F.struct(
                    kind(x).alias("kind"),
                    text(x, "label").alias("label"),
                    text(x, "value").alias("value"),
                    optional(x, "language").alias("language"),
                ),
            ),
            lambda x: x["value"] != "",
        ).alias("verbatim"),
        F.filter(
            F.transform(
                items("filesToAttach"),
                lambda x: F.struct(text(x, "name").alias("name"), text(x, "why").alias("why"), source(x).alias("source")),
            ),
            lambda x: x["name"] != "",
        ).alias("files"),
    )


def _has_null_item(v: Column) -> Column:
    lists = [
        F.coalesce(T.variant_list(v, f"$.{n}"), F.expr("cast(array() as array<variant>)"))
        for n in ("decided", "open", "rejected", "verbatim", "filesToAttach")
    ]
    return F.exists(F.concat(*lists), lambda x: F.coalesce(F.is_variant_null(x), F.lit(True)))


def parse_sections(outputs: DataFrame) -> DataFrame:
    """outputs(.., output, error) -> + sections, parse error kept in ``error``.

    The first fenced body is read when there is one, else the whole text: an answer
    whose fence holds no object has none.  Only the texts that Spark cannot parse are
    sent to Python, which repairs truncated JSON.
    """
    trimmed = T.js_trim(F.coalesce("output", F.lit("")))
    fence = rf"```(?:json)?[{K.BLANK}]*([\s\S]*?)```"
    body = T.let(trimmed, lambda t: F.when(t.rlike(fence), F.regexp_extract(t, fence, 1)).otherwise(t))
    chosen = T.let(
        _object_text(body), lambda text: F.struct(text.alias("text"), F.try_parse_json(text).alias("v"))
    )
    tried = outputs.withColumn("__t", chosen)
    broken = F.when(F.col("__t.v").isNull() & (F.col("__t.text") != ""), F.col("__t.text"))
    mended = tried.withColumn("__fix", repaired_json(broken))

    def check(v: Column) -> Column:
        return (
            F.when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("__t.text") == "", F.lit(K.NOTE_NO_OBJECT))
            .when(v.isNull(), F.lit(K.NOTE_BAD_JSON))
            .when(_has_null_item(v), F.lit("null item in a section"))
        )

    result = T.let(
        F.coalesce("__t.v", F.try_parse_json("__fix")),
        lambda v: T.let(
            check(v),
            lambda e: F.struct(e.alias("error"), F.when(e.isNull(), _sections(v)).alias("sections")),
        ),
    )
    keep = [c for c in outputs.columns if c != "error"]
    return mended.withColumn("__r", result).select(*keep, "__r.error", "__r.sections")


# -- one result per conversation ----------------------------------------------------------


def select_minibriefs(parsed: DataFrame) -> DataFrame:
    """parsed(conv_key, chunk_ord, sections, error) -> (conv_key, chunks, parsed_chunks, mode).

    mode: ``deterministic`` (nothing parsed), ``single`` or ``merge``.
    """
    counts = parsed.groupBy("conv_key").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("error").isNull()).alias("parsed_chunks"),
    )
    return counts.withColumn(
        "mode",
        F.when(F.col("parsed_chunks") == 0, F.lit("deterministic"))
        .when(F.col("parsed_chunks") == 1, F.lit("single"))
        .otherwise(F.lit("merge")),
    )


def fallback_notes(parsed: DataFrame) -> DataFrame:
    """(conv_key, ord, note): one per failed chunk, one more when none parsed."""
    modes = select_minibriefs(parsed)
    failed = (
        parsed.filter(F.col("error").isNotNull())
        .join(modes.select("conv_key", "chunks"), "conv_key")
        .select(
            "conv_key",
            F.col("chunk_ord").cast("bigint").alias("ord"),
            F.concat(
                F.lit("Chunk "),
                (F.col("chunk_ord") + 1).cast("string"),
                F.lit("/"),
                F.col("chunks").cast("string"),
                F.lit(" did not parse ("),
                "error",
                F.lit("); its raw model output was kept out of the merge."),
            ).alias("note"),
        )
    )
    none = modes.filter(F.col("mode") == "deterministic").select(
        "conv_key", F.col("chunks").cast("bigint").alias("ord"), F.lit(K.NOTE_NO_CHUNK).alias("note")
    )
    return failed.unionByName(none)


def merge_fallback(merged: DataFrame, parsed: DataFrame) -> DataFrame:
    """merged(conv_key, sections, error): the last mini-brief where a merge failed.

    -> (conv_key, sections, note)
    """
    good = parsed.filter(F.col("error").isNull()).select("conv_key", "chunk_ord", F.col("sections").alias("last"))
    last = last_wins(good, ["conv_key"], ["chunk_ord"])
    return merged.join(last.select("conv_key", "last"), "conv_key", "left").select(
        "conv_key",
        F.coalesce("sections", "last").alias("sections"),
        F.when(
            F.col("sections").isNull(),
            F.concat(
                F.lit("Merge step did not parse ("),
                F.coalesce("error", F.lit("")),
                F.lit("); used the final chunk's brief as the resolved state."),
            ),
        ).alias("note"),
    )


def _numbered_item(item, name, cols):
    return lambda x, i: item(name, i, *cols(x))


def section_items(parsed: DataFrame) -> DataFrame:
    """Mini-briefs as long items (conv_key, chunk_ord, section, pos, a, b, c, d).

    now: a=text; decided: a=text b=replaces; open: a=text; rejected: a=idea b=why;
    verbatim: a=kind b=label c=value d=language; files: a=name b=why c=source.
    """
    none = F.lit(None).cast("string")
    s = "sections"
    columns = {
        "decided": lambda x: (x["text"], x["replaces"], none, none),
        "open": lambda x: (x["text"], none, none, none),
        "rejected": lambda x: (x["idea"], x["why"], none, none),
        "verbatim": lambda x: (x["kind"], x["label"], x["value"], x["language"]),
        "files": lambda x: (x["name"], x["why"], x["source"], none),
    }

    def item(section, pos, a, b, c, d):
        return F.struct(
            F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")
        )

    now = F.when(
        F.col(f"{s}.now") != "", F.array(item("now", F.lit(0), F.col(f"{s}.now"), none, none, none))
    )
    lists = [
        F.transform(F.col(f"{s}.{name}"), _numbered_item(item, name, cols))
        for name, cols in columns.items()
    ]
    empty = F.filter(F.array(item("now", F.lit(0), F.lit(""), none, none, none)), lambda x: F.lit(False))
    every = F.concat(F.coalesce(now, empty), *lists)
    return (
        parsed.select("conv_key", "chunk_ord", F.explode_outer(every).alias("i"))
        .filter(F.col("i").isNotNull())
        .select("conv_key", "chunk_ord", "i.section", "i.pos", "i.a", "i.b", "i.c", "i.d")
    )


def merge_latest_state(items: DataFrame) -> DataFrame:
    """Items of all mini-briefs -> one set per conversation, the latest state wins.

    A keyed reading of the merge rules: ``now`` comes from the last mini-brief; a
    thread (its text, lower-cased, blanks collapsed) keeps the section and value of
    the last chunk that mentions it; rejected ideas accumulate unless revived.
    Verbatim items are threads by label (by value without a label), files by name.
    Equality of keys is exact: paraphrases are not recognised as one thread.
    """
    norm = lambda c: F.lower(T.js_trim(F.regexp_replace(c, rf"[{K.BLANK}]+", " ")))
    thread = (
        F.when(F.col("section") == "now", F.lit("now"))
        .when(F.col("section") == "verbatim", F.concat(F.lit("verbatim:"), F.coalesce(F.nullif(norm(F.col("b")), F.lit("")), F.col("c"))))
        .when(F.col("section") == "files", F.concat(F.lit("files:"), norm(F.col("a"))))
        .otherwise(F.concat(F.lit("thread:"), norm(F.col("a"))))
    )
    keyed = items.withColumn("thread_key", thread).withColumn("__back", -F.col("chunk_ord"))
    # latest chunk first, then the first item inside it
    won = first_wins(keyed, ["conv_key", "thread_key"], ["__back", "pos"])
    return won.select("conv_key", "thread_key", "section", "chunk_ord", "pos", "a", "b", "c", "d")
