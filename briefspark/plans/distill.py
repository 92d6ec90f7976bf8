"""The two ways from transcripts to briefs, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.operators import chunk as C
from briefspark.operators import extract as X
from briefspark.operators import model as M
from briefspark.operators import reconcile as R
from briefspark.operators.lineage import collapse_lineage
from briefspark.operators.ordered import checkpoint_folder
from briefspark.operators.render import Brief
from briefspark.sources.transcript import Transcript


def collapsed_artifacts(t: Transcript) -> DataFrame:
    """Artifacts without stale drafts, in the order of their lineages."""
    kept = collapse_lineage(t.artifacts)
    return kept.drop("ordinal").withColumn("ordinal", F.col("slot"))


def _empty(t: Transcript, ddl: str) -> DataFrame:
    key = dict(t.meta.dtypes)["conv_key"]
    return t.meta.sparkSession.createDataFrame(
        [], f"conv_key {key}, src int, ordinal bigint, pos int, {ddl}"
    )


def _meta(t: Transcript, produced_by) -> DataFrame:
    counts = t.integrity.select(
        "conv_key", "complete", (F.col("total_blocks") - F.col("classified_blocks")).alias("unknown_count")
    )
    return (
        t.meta.join(counts, "conv_key", "left")
        .withColumn("complete", F.coalesce("complete", F.lit(True)))
        .fillna(0, ["unknown_count"])
        .withColumn("produced_by", produced_by)
        .withColumn("notes", F.array().cast("array<string>"))
    )


def tier0_facts(
    t: Transcript, cap: int | None = None, collapsed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(verbatim, files): everything that must survive, without a model.

    The messages are read once for all facts.  What was found is small next to the
    chats and is used several times from here on, so it is kept.  ``cap`` limits the
    mentioned files of a conversation to its first ones; by default all are listed.
    ``collapsed`` is for callers that have the artifacts without stale drafts already.
    """
    a = keep(collapsed_artifacts(t), "kept_artifacts") if collapsed is None else collapsed
    facts = keep(X.conversation_facts(t.messages, a), "facts")
    files = X.artifact_files(a).unionByName(X.upload_files(t.uploads))
    mentioned = X.first_mentions(facts, t.artifacts, cap)
    produced = X.as_files(facts.filter(F.col("kind") == X.CHAT_FILE))
    return X.as_verbatim(facts), X.dedupe_files_by_stem(
        files.unionByName(produced).unionByName(mentioned)
    )


def distill_deterministic(t: Transcript, cap: int | None = None, collapsed: DataFrame | None = None) -> Brief:
    """Transcript -> brief without a model."""
    verbatim, files = tier0_facts(t, cap, collapsed)
    files = keep(files, "files")
    return Brief(
        meta=_meta(t, F.lit("deterministic")),
        now=X.now_units(t.messages, files, t.meta),
        decided=_empty(t, "text string, replaces string"),
        open=_empty(t, "text string"),
        rejected=_empty(t, "idea string, why string"),
        verbatim=verbatim,
        files=files,
        unknown=t.unknown,
    )


def chunk_prompts(units: DataFrame, make_prompt, max_chars: int = K.CHUNK_CHARS) -> DataFrame:
    """(conv_key, chunk_ord, prompt); ``make_prompt(text, chunk_ord)`` is a Column function."""
    chunks = C.chunk_transcript(units, max_chars)
    return chunks.select("conv_key", "chunk_ord", make_prompt(F.col("text"), F.col("chunk_ord")).alias("prompt"))


def _items(sections: DataFrame) -> dict[str, DataFrame]:
    fields = {
        "decided": ["text", "replaces"],
        "open": ["text"],
        "rejected": ["idea", "why"],
        "verbatim": ["kind", "label", "value", "language"],
        "files": ["name", "why", "source"],
    }
    return {
        name: sections.select("conv_key", F.posexplode_outer(f"sections.{name}").alias("pos", "x"))
        .filter(F.col("x").isNotNull())
        .select(
            "conv_key",
            F.lit(0).alias("src"),
            F.lit(0).cast("bigint").alias("ordinal"),
            F.col("pos").cast("int").alias("pos"),
            *[F.col("x")[c].alias(c) for c in columns],
        )
        for name, columns in fields.items()
    }


def distill_with_model(
    t: Transcript,
    complete: Callable[[str], str],
    client_id: str,
    chunk_prompt,
    merge_prompt,
    max_chars: int = K.CHUNK_CHARS,
    partitions: int | None = None,
    save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> Brief:
    """Chunks -> mini-briefs -> one brief, reconciled with the extracted facts.

    ``chunk_prompt(text, chunk_ord)`` and ``merge_prompt(outputs)`` build prompts
    from Columns (``outputs``: the raw mini-briefs of a conversation in order).
    ``save(df, name)`` should write the model outputs to a table and read them
    back, so that no lost executor makes the model answer twice; the default
    checkpoints, so it needs a checkpoint directory.
    """
    if save is None:
        if not checkpoint_folder(t.meta.sparkSession):
            raise ValueError("model answers have to be saved: give `save` or set spark.checkpoint.dir")
        save = keep
    collapsed = keep(collapsed_artifacts(t), "kept_artifacts")
    base = distill_deterministic(t, collapsed=collapsed)
    verbatim, files = base.verbatim, base.files
    units = C.transcript_units(t.messages, collapsed, collapsed=True)
    asked = M.complete_batch(chunk_prompts(units, chunk_prompt, max_chars), complete, partitions)
    parsed = save(M.parse_sections(asked), "mini_briefs")
    modes = save(M.select_minibriefs(parsed), "brief_modes")

    good = parsed.filter(F.col("error").isNull())
    single = good.join(modes.filter(F.col("mode") == "single").select("conv_key"), "conv_key", "left_semi")
    # one merge prompt per conversation holds its mini-briefs: bounded by what a model reads
    several = (
        good.join(modes.filter(F.col("mode") == "merge").select("conv_key"), "conv_key", "left_semi")
        .groupBy("conv_key")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_ord", "output"))).alias("o"))
        .select("conv_key", merge_prompt(F.transform("o", lambda x: x["output"])).alias("prompt"))
    )
    merged = save(M.parse_sections(M.complete_batch(several, complete, partitions)), "merged_briefs")
    resolved = M.merge_fallback(merged, parsed)
    final = single.select("conv_key", "sections", F.lit(None).cast("string").alias("note")).unionByName(resolved)
    final = save(final, "resolved_briefs")
    items = _items(final)

    fallen = modes.filter(F.col("mode") == "deterministic").select("conv_key")
    bare = t.meta.join(modes, "conv_key", "left_anti").select("conv_key")
    plain = fallen.unionByName(bare)
    notes = (
        M.fallback_notes(parsed)
        .unionByName(
            final.filter(F.col("note").isNotNull()).select(
                "conv_key", F.lit(2**40).cast("bigint").alias("ord"), "note"
            )
        )
        .groupBy("conv_key")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "note"))).alias("n"))
        .select("conv_key", F.transform("n", lambda x: x["note"]).alias("notes"))
    )
    client = F.lit(client_id)
    by = F.when(F.col("fell"), F.concat(client, F.lit(" (fallback: deterministic)"))).otherwise(client)
    meta = (
        base.meta.drop("notes", "produced_by")
        .join(fallen.withColumn("fell", F.lit(True)), "conv_key", "left")
        .join(notes, "conv_key", "left")
        .withColumn("produced_by", by)
        .withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
        .drop("fell")
    )

    def both(modelled: DataFrame, extracted: DataFrame) -> DataFrame:
        return modelled.unionByName(extracted.join(plain, "conv_key", "left_semi"))

    modelled_only = files.join(plain, "conv_key", "left_anti")
    all_files = save(R.reconcile_files(modelled_only, items["files"]), "reconciled_files")
    facts = verbatim.join(plain, "conv_key", "left_anti")
    kept = items["verbatim"].select(*X.VERBATIM)
    pictures = R.guarantee_images(kept, facts)
    tables = R.guarantee_tables(kept, facts).join(kept.select("conv_key", "src", "ordinal", "pos"), ["conv_key", "src", "ordinal", "pos"], "left_anti")
    now = R.count_units(final.select("conv_key", F.col("sections.now").alias("now")), all_files)
    return Brief(
        meta=meta,
        now=both(now, base.now),
        decided=R.drop_meta(items["decided"], "text"),
        open=R.drop_meta(items["open"], "text"),
        rejected=R.drop_meta(items["rejected"], "idea", "why"),
        verbatim=both(pictures.unionByName(tables.select(*X.VERBATIM)), verbatim),
        files=both(all_files, files),
        unknown=t.unknown,
    )


def keep(df: DataFrame, name: str) -> DataFrame:
    """Hold a result that several later steps read (``name`` is for savers that write tables).

    In the checkpoint directory, where the session has one: that also cuts the
    lineage and survives lost executors.  Else as cached blocks, which Spark
    recomputes when an executor with them is lost.
    """
    if checkpoint_folder(df.sparkSession):
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
