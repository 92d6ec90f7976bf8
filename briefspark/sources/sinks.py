"""Writing briefs and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefspark.functions import text as T
from briefspark.operators.ordered import hold

SCORECARD_TITLE = "# briefspark eval scorecard"
SCORECARD_JUDGED = "Mode: **full judgement** (model: `{}`)."
SCORECARD_UNJUDGED = "Mode: **shape + size only** (no model)."
SCORECARD_HEAD = (
    "| Fixture | Full→Brief size | Integrity | Decided/Open/Rejected/Verbatim/Files | Same next move? |",
    "|---|---|---|---|---|",
)


def briefs_for_export(briefs: DataFrame, meta: DataFrame) -> DataFrame:
    """briefs(conv_key, part, human_md) + meta(conv_key, title) -> named documents.

    The same text is offered as markdown and as plain text.
    """
    named = briefs.join(meta.select("conv_key", "title"), "conv_key").withColumn("slug", T.slug(F.col("title")))
    both = named.withColumn("ext", F.explode(F.array(F.lit("md"), F.lit("txt"))))
    return both.select(
        "conv_key",
        F.concat_ws(".", "slug", "ext").alias("file_name"),
        "part",
        F.col("human_md").alias("content"),
        F.substring("slug", 1, 1).alias("slug_prefix"),
    )


def write_briefs(documents: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One table of documents, partitioned by the first letter of the slug.

    Rows of a letter are spread over all tasks, so a frequent title does not make
    one huge file; ``maxRecordsPerFile`` of the session bounds file sizes.
    """
    documents.write.mode(mode).partitionBy("slug_prefix").format(fmt).save(path)


def scorecard_row(reduction: Column) -> Column:
    percent = F.concat(F.floor(reduction * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))
    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in ("decided", "open", "rejected", "verbatim", "files")])
    return F.concat(
        F.lit("| "),
        F.col("id").cast("string"),
        F.lit(" | "),
        F.col("full_chars").cast("string"),
        F.lit("→"),
        F.col("brief_chars").cast("string"),
        F.lit(" (−"),
        percent,
        F.lit(") | "),
        F.when(F.col("integrity_complete"), F.lit("✓")).otherwise(F.lit("⚠ partial")),
        F.lit(" | "),
        counts,
        F.lit(" | "),
        F.when(F.col("same_move").isNull(), F.lit(", "))
        .when(F.col("same_move"), F.lit("✅ yes"))
        .otherwise(F.lit("❌ no")),
        F.lit(" |"),
    )


def scorecard_markdown(scorecard: DataFrame) -> DataFrame:
    """scorecard(id, ..) -> (id, line): the table rows of the summary."""
    have = scorecard if "same_move" in scorecard.columns else scorecard.withColumn("same_move", F.lit(None).cast("boolean"))
    return have.select("id", scorecard_row(F.col("reduction")).alias("line"))


def scorecard_document(scorecard: DataFrame, judge: str | None = None) -> DataFrame:
    """(part, place, id, line): the whole summary; ordered by these, the lines are the document.

    ``judge`` names the model whose verdicts (same_move, reasoning; NULL where it gave
    none) the scorecard holds; they add a pass rate and the reasons.
    """
    spark = scorecard.sparkSession
    columns = "part int, place int, id string, line string"

    def fixed(part: int, lines: list[str]) -> DataFrame:
        return spark.createDataFrame([(part, n, "", line) for n, line in enumerate(lines)], columns)

    def of_rows(part: int, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.lit(0).alias("place"), F.col("id").cast("string").alias("id"), "line")

    if judge is not None:
        scorecard = hold(scorecard)  # lines, pass rate and reasons read it
    mode = SCORECARD_JUDGED.format(judge) if judge else SCORECARD_UNJUDGED
    out = fixed(0, [SCORECARD_TITLE, "", mode, "", *SCORECARD_HEAD]).unionByName(of_rows(1, scorecard_markdown(scorecard)))
    if judge is None:
        return out
    counts = scorecard.agg(F.count_if("same_move").alias("passed"), F.count("*").alias("n"))
    rate = F.concat(
        F.lit("**Same-next-move pass rate: "), F.col("passed").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("**")
    )
    passed = counts.select(F.lit(2).alias("part"), F.lit(1).alias("place"), F.lit("").alias("id"), rate.alias("line"))
    reason = F.concat(F.lit("- **"), F.col("id").cast("string"), F.lit("**: "), F.coalesce("reasoning", F.lit("")))
    reasons = scorecard.filter(F.col("same_move").isNotNull()).select("id", reason.alias("line"))
    return (
        out.unionByName(fixed(2, [""]))
        .unionByName(passed)
        .unionByName(fixed(3, ["", "## Judge reasoning", ""]))
        .unionByName(of_rows(4, reasons))
    )


def write_scorecard(scorecard: DataFrame, path: str, judge: str | None = None, mode: str = "overwrite") -> None:
    """``path``/json holds the entries, ``path``/markdown the summary.

    The summary is written in order by range partitioning, so the files read one
    after the other are the document.
    """
    scorecard.write.mode(mode).json(f"{path}/json")
    document = scorecard_document(scorecard, judge).orderBy("part", "place", "id")
    document.select("line").write.mode(mode).text(f"{path}/markdown")
