"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefspark.functions import text as T
from briefspark.operators import blocks as B
from briefspark.operators import branch as BR
from briefspark.operators import chunk as C
from briefspark.operators import evaluate as V
from briefspark.operators import extract as X
from briefspark.operators import lineage as D
from briefspark.operators import model as M
from briefspark.operators import parity as PA
from briefspark.operators import reconcile as R
from briefspark.operators import render as RD
from briefspark.operators import replay as RP
from briefspark.plans import distill as P
from briefspark.plans import seeds as S
from briefspark.sources import brief_table as BT
from briefspark.sources import files as FL
from briefspark.sources import pages as PG
from briefspark.operators.ordered import checkpoint_folder
from briefspark.sources import payloads as PL
from briefspark.sources import sinks as SK
from briefspark.sources import store as ST
from briefspark.sources.transcript import Transcript, normalize_simple

def shared_folder(spark: SparkSession) -> str:
    """Where queries write files that they read back: the checkpoint folder, or a temporary one
    in a local session that has none."""
    folder = checkpoint_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="briefspark-")
    return folder


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Register a query; its integer columns come out as BIGINT."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = f(spark, sf)
        return df.select(
            *[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes]
        )

    QUERIES[f.__name__] = run
    return f


def _flat(messages: DataFrame) -> DataFrame:
    return messages.select("conv_key", "ordinal", "role", "text")


VERBATIM = ["conv_key", "kind", "label", "value", "language"]
FILES = ["conv_key", "name", "source"]


MIXED = ("huggingface", "deepseek", "grok", "perplexity", "chatgpt", "gemini", "claude")


def _mixed(spark: SparkSession, sf: str) -> Transcript:
    """One export of chats of all platforms, dealt out by conv_id."""
    make = {
        "huggingface": S.hf_payloads, "deepseek": S.deepseek_payloads, "grok": S.grok_payloads, "perplexity": S.perplexity_payloads,
        "chatgpt": S.chatgpt_payloads, "gemini": S.gemini_payloads, "claude": S.claude_payloads,
    }
    pages = S.pages_of_chats(spark, sf)
    parts = [make[name](pages.filter(F.col("conv_key").cast("bigint") % len(MIXED) == n)) for n, name in enumerate(MIXED)]
    return PL.normalize(PL.with_routes(reduce(DataFrame.unionByName, parts)))


def _seeded_transcript(spark: SparkSession, sf: str) -> Transcript:
    m = S.seeded(spark, sf)
    simple = normalize_simple(m.select("conv_key", "ordinal", "role", "text"))
    chats = S.chats(spark, sf)
    meta = chats.select(F.col("conv_id").alias("conv_key")).distinct().selectExpr(
        "conv_key",
        "CAST(conv_key AS STRING) AS conversation_id",
        "'Chat ' || CAST(conv_key AS STRING) AS title",
        "'2026-06-26T00:00:00Z' AS captured_at",
    )
    uploads = chats.filter("role = 'user'").selectExpr(
        "conv_id AS conv_key", "turn AS ordinal", "'Sheet_' || CAST(turn AS STRING) || '.csv' AS name", "'csv' AS type"
    )
    unknown = chats.filter("role = 'system'").selectExpr(
        "conv_id AS conv_key",
        "turn AS msg_ord",
        "CAST(0 AS BIGINT) AS block_ord",
        "'message-' || CAST(turn AS STRING) AS msg_uuid",
        "'type:mystery' AS hint",
        "'{\"type\":\"mystery\"}' AS preview",
    )
    integrity = chats.groupBy(F.col("conv_id").alias("conv_key")).agg(
        F.count("*").alias("total_blocks"), F.count_if(F.col("role") != "system").alias("classified_blocks")
    ).withColumn("complete", F.col("total_blocks") == F.col("classified_blocks"))
    return Transcript(
        meta=meta,
        messages=m,
        artifacts=S.artifacts(spark, sf),
        uploads=uploads,
        integrity=integrity,
        unknown=unknown,
        errors=simple.errors,
    )


# -- sources ------------------------------------------------------------------------


@query
def route_platform(spark, sf):
    chats = S.chats(spark, sf).select(F.expr("'chat' AS origin"), F.expr(f"{S.CHAT_URL} AS url"))
    pages = S.table(spark, sf, "pages").select(F.expr("'page' AS origin"), "url")
    routed = chats.unionByName(pages).withColumn("platform", PL.route_platform(F.col("url")))
    return routed.groupBy("origin", "platform").agg(F.count("*").alias("n"))


@query
def conversation_id_from_url(spark, sf):
    rows = S.chats(spark, sf).select("conv_id", "turn", F.expr(f"{S.CHAT_URL} AS url"))
    platform = PL.route_platform(F.col("url"))
    return rows.withColumn("platform", platform).withColumn(
        "chat_id", PL.conversation_id_from_url(F.col("platform"), F.col("url"))
    )


@query
def normalize_mixed_messages(spark, sf):
    return _flat(_mixed(spark, sf).messages)


@query
def normalize_mixed_meta(spark, sf):
    return _mixed(spark, sf).meta.select("conv_key", "conversation_id", "title", "captured_at")


@query
def payload_errors(spark, sf):
    """The page table as a table of payloads: each page text is a bad document and
    must come out as an error row."""
    pages = S.table(spark, sf, "pages").select(
        "url", F.lit("grok").alias("platform"), F.lit(None).cast("string").alias("captured_at"), F.col("html").alias("payload"),
        F.col("page_id").cast("string").alias("conv_key"),
    )
    errors = PL.normalize_grok(PL.with_routes(pages)).errors
    chat_errors = PL.normalize_grok(S.hf_payloads(S.pages_of_chats(spark, sf))).errors
    return errors.unionByName(chat_errors)


@query
def normalize_simple_messages(spark, sf):
    rows = S.chats(spark, sf).select(
        F.col("conv_id").alias("conv_key"), F.col("turn").alias("ordinal"), F.expr(S.ROLE).alias("role"), F.expr(S.PADDED_TEXT).alias("text")
    )
    return normalize_simple(rows).messages.select("conv_key", "ordinal", "msg_uuid", "role", "text")


@query
def messages_from_pages(spark, sf):
    """The stored pages, and the chats as pages with author attributes."""
    pages = S.table(spark, sf, "pages").select(F.expr("'page-' || CAST(page_id AS STRING) AS page_id"), "html")
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    node = lambda m: F.concat(
        F.lit('<div data-message-author-role="'), m["role"], F.lit('"><p>'), escaped(m["text"]), F.lit("</p></div>")
    )
    chats = S.pages_of_chats(spark, sf, padded=False).select(
        F.concat(F.lit("chat-"), "conv_key").alias("page_id"),
        F.concat(F.lit("<html><body>"), F.array_join(F.transform("turns", node), ""), F.lit("</body></html>")).alias("html"),
    )
    return PG.messages_from_pages(pages.unionByName(chats))


@query
def prefer_data_layer(spark, sf):
    rows = S.chats(spark, sf)
    failed = rows.filter("role = 'system'").select("conv_id").distinct()
    shape = lambda df, tag: df.select(F.col("conv_id").alias("conv_key"), F.col("turn").alias("ordinal"), F.expr(f"'{tag}' || role").alias("role"), "text")
    data = shape(rows.join(failed, "conv_id", "left_anti"), "")
    return ST.prefer_data_layer(data, shape(rows, "screen "))


@query
def upsert_briefs(spark, sf):
    rows = S.chats(spark, sf).selectExpr(
        "conv_id AS store_key", "role", "lpad(CAST(turn AS STRING), 6, '0') AS saved_at", "text AS brief"
    )
    return ST.upsert_briefs(
        rows.filter("role = 'user'").drop("role"), rows.filter("role <> 'user'").drop("role")
    )


@query
def upsert_brief_table(spark, sf):
    """Briefs by host and path of their chat, saved in two upserts of a stored table; what it holds."""
    rows = S.chats(spark, sf).select(
        ST.store_key(F.expr(S.CHAT_URL)).alias("store_key"),
        F.expr("lpad(CAST(conv_id AS STRING), 12, '0') || lpad(CAST(turn AS STRING), 6, '0')").alias("saved_at"),
        F.col("text").alias("brief"),
        "role",
    )
    store = BT.BriefTable(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    store.upsert(rows.filter("role <> 'user'").drop("role"))
    store.upsert(rows.filter("role = 'user'").drop("role"))
    return store.read()


@query
def stale_briefs(spark, sf):
    rows = S.chats(spark, sf).selectExpr("conv_id AS conv_key", "turn AS ordinal", "role", "text")
    store = ST.content_hash(rows.filter("role <> 'system'"))
    return ST.stale(store, rows).select("conv_key")


@query
def brief_slug(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))
    return ST.brief_slug(docs).select("doc_id", "slug")


def _titled_chats(spark, sf):
    """(conv_key, title): titles that many chats share."""
    turns = S.chats(spark, sf).groupBy(F.col("conv_id").alias("conv_key"))
    return turns.agg(F.concat(F.lit("Chat of "), F.count("*").cast("string"), F.lit(" turns!")).alias("title"))


@query
def brief_file_names(spark, sf):
    """One name for each chat, told apart by a number where titles have one slug."""
    return FL.file_names(_titled_chats(spark, sf))


@query
def write_brief_files(spark, sf):
    """A file for each chat, a part for each turn; what the files hold."""
    path = f"{shared_folder(spark)}/briefs-{uuid.uuid4().hex}"
    turns = S.chats(spark, sf).selectExpr("conv_id AS conv_key", "turn AS part", "coalesce(text, '') || chr(10) AS human_md")
    FL.write_brief_files(turns, _titled_chats(spark, sf), path, extensions=("md",))
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


# -- normalizers -----------------------------------------------------------------------


@query
def normalize_hf(spark, sf):
    return _flat(PL.normalize_hf(S.hf_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def read_payload_arrays(spark, sf):
    """All chats as export files of one JSON array each, some 64 chats to a file, read back
    through the payload reader and normalized."""
    payloads = S.hf_payloads(S.pages_of_chats(spark, sf)).select("conv_key", "payload")
    files = max(1, payloads.count() // 64)
    chats = payloads.groupBy(F.pmod(F.xxhash64("conv_key"), F.lit(files))).agg(F.concat_ws(",\n ", F.collect_list("payload")).alias("chats"))
    folder = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    chats.select(F.concat(F.lit("[\n "), "chats", F.lit("\n]")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return PL.normalize_hf(PL.read_payloads(spark, folder, "array", platform="huggingface")).messages.select("ordinal", "role", "text")


@query
def normalize_deepseek(spark, sf):
    return _flat(PL.normalize_deepseek(S.deepseek_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def normalize_grok(spark, sf):
    return _flat(PL.normalize_grok(S.grok_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def normalize_perplexity(spark, sf):
    return _flat(PL.normalize_perplexity(S.perplexity_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def normalize_chatgpt(spark, sf):
    return _flat(PL.normalize_chatgpt(S.chatgpt_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def normalize_gemini(spark, sf):
    return _flat(PL.normalize_gemini(S.gemini_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def normalize_claude(spark, sf):
    return _flat(PL.normalize_claude(S.claude_payloads(S.pages_of_chats(spark, sf))).messages)


@query
def normalize_claude_report(spark, sf):
    t = PL.normalize_claude(S.claude_payloads(S.pages_of_chats(spark, sf)))
    ups = t.uploads.groupBy("conv_key").agg(F.count("*").alias("uploads"), F.min("name").alias("first_upload"))
    odd = t.unknown.groupBy("conv_key").agg(F.count("*").alias("unknown"), F.min("preview").alias("preview"))
    return t.integrity.join(ups, "conv_key").join(odd, "conv_key", "left").fillna(0, ["unknown"])


@query
def parity_report(spark, sf):
    pages = S.pages_of_chats(spark, sf, flat_roles=True)
    made = {
        "huggingface": S.hf_payloads(pages),
        "deepseek": S.deepseek_payloads(pages),
        "grok": S.grok_payloads(pages),
        "perplexity": S.perplexity_payloads(pages, sources=False),
        "chatgpt": S.chatgpt_payloads(pages),
        "gemini": S.gemini_payloads(pages),
        "claude": S.claude_payloads(pages),
    }
    from briefspark.operators.ordered import dense_ordinal

    texts = {}
    for name, payloads in made.items():
        m = PL.NORMALIZERS[name](payloads).messages
        if name == "claude":  # keeps branch places, which have gaps where a message was blank
            m = dense_ordinal(m, ["conv_key"], "ordinal", "n").drop("ordinal").withColumnRenamed("n", "ordinal")
        texts[name] = _flat(m)
    return V.parity_report(texts)


#: What is planted in the payloads of three platforms: a changed text, a role, a lost end.
PLANTED = {
    "grok": "transform(turns, t -> named_struct('turn', t.turn, 'conv_id', t.conv_id, 'role', t.role, "
    "'text', if(t.turn = t.conv_id % 3, t.text || ' changed', t.text)))",
    "huggingface": "transform(turns, t -> named_struct('turn', t.turn, 'conv_id', t.conv_id, "
    "'role', if(t.conv_id % 5 = 2 AND t.turn = 1, 'user', t.role), 'text', t.text))",
    "deepseek": "filter(turns, t -> t.conv_id % 4 <> 1 OR t.turn < 2)",
}


@query
def parity_differences(spark, sf):
    """Where four platforms first differ on the same chats, three of them with planted differences."""
    pages = S.pages_of_chats(spark, sf, flat_roles=True)
    make = {"grok": S.grok_payloads, "huggingface": S.hf_payloads, "deepseek": S.deepseek_payloads, "chatgpt": S.chatgpt_payloads}
    sources = {
        name: PL.NORMALIZERS[name](payloads(pages.withColumn("turns", F.expr(PLANTED.get(name, "turns"))))).messages
        for name, payloads in make.items()
    }
    return PA.parity_differences(sources, facts=False)


# -- branches -----------------------------------------------------------------------------


@query
def active_branch(spark, sf):
    nodes, leaf = S.branch_nodes(spark, sf)
    return BR.active_branch(nodes.select("conv_key", "pos", "node", "parent"), leaf).select("conv_key", "node", "branch_ord")


@query
def linear_branch(spark, sf):
    nodes, leaf = S.branch_nodes(spark, sf)
    return BR.linear_branch(nodes, leaf).select("conv_key", "node", "branch_ord")


# -- blocks ---------------------------------------------------------------------------------


@query
def classify_blocks(spark, sf):
    return B.classify_blocks(S.blocks(spark, sf)).select("conv_key", "msg_ord", "block_ord", "kind", "hint", "preview")


@query
def display_content_artifacts(spark, sf):
    return B.display_content_artifacts(S.blocks(spark, sf)).select(
        "conv_key", "msg_ord", "block_ord", "title", "filename", "language", "content"
    )


def _tagged(spark, sf):
    return S.chats(spark, sf).selectExpr(
        "conv_id AS conv_key",
        "turn AS ordinal",
        "'m' || CAST(turn AS STRING) AS msg_uuid",
        "'before <antArtifact identifier=\"a' || CASE WHEN turn % 2 = 0 THEN '.md' ELSE '' END || '\" type=\"text\" title = \"Doc\">' "
        "|| text || '</antArtifact> and <antArtifact title=\"\">x</antArtifact> after' AS text",
    )


@query
def ant_artifacts(spark, sf):
    return B.ant_artifacts(_tagged(spark, sf)).selectExpr(
        "conv_key", "ordinal", "CAST(pos AS BIGINT) AS pos", "title", "filename", "language", "content"
    )


@query
def strip_artifact_tags(spark, sf):
    return _tagged(spark, sf).select("conv_key", "ordinal", B.strip_tags(F.col("text")).alias("text"))


@query
def search_context(spark, sf):
    return B.search_context(S.blocks(spark, sf)).selectExpr(
        "conv_key", "msg_ord", "block_ord", "CAST(ord AS BIGINT) AS ord", "kind", "title", "url"
    )


@query
def citations(spark, sf):
    return B.citations(S.blocks(spark, sf)).select("conv_key", "msg_ord", "url", "title")


@query
def image_subject(spark, sf):
    labels = F.array(
        F.expr("'Chart of ' || role || ' turns'"), F.lit("image"), F.expr("' chart OF ' || CASE WHEN turn % 2 = 0 THEN role ELSE 'all' END || ' things'"),
    )
    return S.chats(spark, sf).select(
        "conv_id", "turn", T.image_subject(labels, F.expr("turn % 3 = 0")).alias("subject")
    )


@query
def assemble_messages(spark, sf):
    return B.assemble_messages(S.blocks(spark, sf)).select("conv_key", "ordinal", "text")


@query
def integrity_report(spark, sf):
    return B.integrity_report(S.blocks(spark, sf))


@query
def uploads(spark, sf):
    rows = S.chats(spark, sf).selectExpr(
        "conv_id AS conv_key", "turn AS ordinal",
        "CASE WHEN turn % 4 = 3 THEN '  ' ELSE ' ' || role || CASE WHEN turn % 2 = 0 THEN '.CSV' ELSE '.csv' END || ' ' END AS file_name",
        "CASE WHEN role = 'user' THEN 'csv' ELSE '' END AS file_type",
    )
    return B.uploads(rows)


# -- files ------------------------------------------------------------------------------------


def _events(spark, sf, with_shell=True):
    rows = S.chats(spark, sf)
    path = F.expr("'draft_' || CAST(turn % 3 AS STRING) || '.md'")
    make = F.to_json(F.struct(path.alias("path"), F.col("text").alias("file_text")))
    edit = F.to_json(F.struct(path.alias("path"), F.lit("the").alias("old_str"), F.lit("THE").alias("new_str")))
    event = lambda i, name, body: F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), body.alias("input"))
    steps = [event(0, "create_file", make), event(1, "str_replace", edit)]
    if with_shell:
        steps.append(
            event(
                2,
                "bash_tool",
                F.to_json(
                    F.struct(
                        F.concat(
                            F.lit("mkdir -p /mnt/user-data/outputs && cp -f "), path, F.expr("' \"/mnt/user-data/outputs/final ' || CAST(turn % 2 AS STRING) || '.md\"'")
                        ).alias("command")
                    )
                ),
            )
        )
        steps.append(
            event(3, "present_files", F.to_json(F.struct(F.array(F.lit("/mnt/user-data/outputs/final 0.md"), F.lit("/tmp/deck.pptx")).alias("filepaths"))))
        )
    return rows.withColumn("e", F.explode(F.array(*steps))).select(
        F.col("conv_id").alias("conv_key"),
        (F.col("turn") * 8 + F.col("e.i")).alias("ord"),
        "e.name",
        "e.input",
    )


@query
def replay_files(spark, sf):
    state = RP.replay_files(_events(spark, sf))
    return state.filter("place IS NOT NULL").select("conv_key", "path", "content")


@query
def replay_files_by_path(spark, sf):
    """Without commands that tie paths together every path replays on its own."""
    state = RP.replay_files(_events(spark, sf, with_shell=False))
    return state.filter("place IS NOT NULL").select("conv_key", "path", "content")


@query
def replay_across_folders(spark, sf):
    """Every turn moves to a folder next to the last one, writes a note there and copies it up."""
    folder = F.expr("'cd ../t' || CAST(turn % 3 AS STRING)")
    steps = [
        ("bash_tool", F.struct(folder.alias("command"))),
        ("create_file", F.struct(F.lit("note.md").alias("path"), F.col("text").alias("file_text"))),
        ("bash_tool", F.struct(F.lit("cp note.md ../last.md; mv -f ../last.md ../latest.md").alias("command"))),
    ]
    calls = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.to_json(body).alias("input")) for i, (name, body) in enumerate(steps)]
    events = S.chats(spark, sf).withColumn("e", F.explode(F.array(*calls))).selectExpr(
        "conv_id AS conv_key", "turn * 4 + e.i AS ord", "e.name", "e.input"
    )
    return RP.replay_files(events).select("conv_key", "path", "content")


def _sandbox(spark, sf):
    """Sandbox states: odd chats deliver files, the others only have drafts."""
    rows = S.chats(spark, sf)
    files = rows.selectExpr(
        "conv_id AS conv_key",
        "CASE WHEN conv_id % 2 = 1 AND turn % 2 = 0 THEN '/mnt/user-data/outputs/' ELSE '/home/claude/' END || 'f' || CAST(turn AS STRING) || CASE WHEN turn % 4 = 2 THEN '.pdf' ELSE '.md' END AS path",
        "CASE WHEN turn = 0 THEN '' ELSE text END AS content",
        "turn AS place",
        "turn AS write_ord",
        "CAST(NULL AS BIGINT) AS manifest_ord",
    )
    listed = rows.filter("role = 'user'").selectExpr(
        "conv_id AS conv_key",
        "'/mnt/user-data/outputs/f' || CAST(turn AS STRING) || '.md' AS path",
        "CAST(NULL AS STRING) AS content",
        "CAST(NULL AS BIGINT) AS place",
        "CAST(NULL AS BIGINT) AS write_ord",
        "turn AS manifest_ord",
    ).filter("conv_key % 2 = 1")
    return files.unionByName(listed)


@query
def choose_deliverables(spark, sf):
    return RP.choose_deliverables(_sandbox(spark, sf)).select(
        "conv_key", "path", "filename", "content", "binary", "presented", "content_inferred"
    )


@query
def replay_canvas(spark, sf):
    rows = S.chats(spark, sf)
    create = F.to_json(F.struct(F.lit("essay").alias("name"), F.lit("document").alias("type"), F.col("text").alias("content")))
    one = F.struct(F.lit("t(h)e").alias("pattern"), F.lit("T$1[$&]").alias("replacement"), F.lit(False).alias("multiple"))
    every = F.struct(F.lit("[aeiou]n\\b").alias("pattern"), F.lit("_").alias("replacement"), F.lit(True).alias("multiple"))
    bad = F.struct(F.lit("(").alias("pattern"), F.lit("!").alias("replacement"), F.lit(True).alias("multiple"))
    update = F.to_json(F.struct(F.array(one, bad, every).alias("updates")))
    event = lambda i, name, body: F.struct(F.lit(i).alias("i"), F.lit(name).alias("recipient"), body.alias("body"))
    events = rows.withColumn(
        "e",
        F.explode(
            F.array(
                event(0, "canmore.create_textdoc", create),
                event(1, "canmore.update_textdoc", update),
                event(2, "canmore.comment_textdoc", F.lit("not json")),
            )
        ),
    ).select(
        F.col("conv_id").alias("conv_key"),
        (F.col("turn") * 4 + F.col("e.i")).alias("ord"),
        "e.recipient",
        F.expr("CASE WHEN turn % 2 = 0 THEN 'even' ELSE CAST(NULL AS STRING) END").alias("doc_id"),
        F.lit(None).cast("string").alias("doc_type"),
        "e.body",
    )
    docs = RP.replay_canvas(events)
    return docs.select(
        "conv_key", "doc_id", T.canvas_filename(F.col("name"), F.col("doc_type")).alias("filename"), "content"
    )


@query
def gemini_canvas_docs(spark, sf):
    """Each message as the canvas document of an answer, next to shorter strings."""
    rows = S.chats(spark, sf)
    doc = S.json_quote(F.col("text"))
    nulls = "null," * 28
    inner = F.concat(
        F.lit('[[[null,null,[["q"]],[[["rc",["a"],'), F.lit(nulls), F.lit('[["id",['), doc, F.lit('],"x"]]]]]]]]')
    )
    payloads = rows.select(
        F.expr("CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING)").alias("conv_key"),
        F.lit(None).cast("string").alias("captured_at"),
        F.concat(F.lit(")]}'\n[[\"wrb.fr\",\"hNvQHb\","), S.json_quote(inner), F.lit("]]")).alias("payload"),
    )
    return PL.normalize_gemini(payloads).artifacts.select("conv_key", "artifact_id", "filename", "content")


@query
def canvas_filename(spark, sf):
    types = "CASE doc_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'code/python' WHEN 2 THEN 'code/rust' WHEN 3 THEN 'slides' WHEN 4 THEN CAST(NULL AS STRING) ELSE 'code/react' END"
    name = "source || CASE WHEN doc_id % 4 = 0 THEN '.Txt' ELSE '_' || lang END"
    return S.table(spark, sf, "documents").select(
        "doc_id", T.canvas_filename(F.expr(name), F.expr(types)).alias("filename")
    )


@query
def path_scalars(spark, sf):
    rows = S.chats(spark, sf).selectExpr("'chat' AS origin", f"{S.FILE_PATH} AS path").unionByName(
        S.table(spark, sf, "pages").selectExpr("'page' AS origin", "url AS path")
    )
    p = F.col("path")
    return rows.select(
        "origin",
        "path",
        T.basename_of(p).alias("base"),
        T.ext_of(p).alias("ext"),
        T.stem_of(p).alias("stem"),
        T.is_sandbox_path(p).alias("sandbox"),
        T.is_binary_file(p).alias("binary"),
    )


# -- drafts --------------------------------------------------------------------------------------


@query
def token_set(spark, sf):
    docs = S.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(T.token_set(F.col("text"))), " ").alias("tokens"))


@query
def draft_similarity(spark, sf):
    sims = D.draft_similarity(S.artifacts(spark, sf))
    return sims.select("conv_key", "prev_ordinal", "ordinal", F.round("sim", 6).alias("sim"))


@query
def similar_drafts(spark, sf):
    pairs = D.similar_drafts(S.artifacts(spark, sf))
    return pairs.select("conv_key", "ordinal_a", "ordinal_b", F.round("sim", 6).alias("sim"))


@query
def collapse_lineage(spark, sf):
    return D.collapse_lineage(S.artifacts(spark, sf)).select("conv_key", "slot", "ordinal", "content")


# -- extraction -------------------------------------------------------------------------------------


@query
def collapse_lineage_by_groups(spark, sf):
    """The same drafts, dealt out to tasks by groups of alike ones instead of by chat."""
    return D.collapse_lineage(S.artifacts(spark, sf), by_groups=True).select("conv_key", "slot", "ordinal", "content")


@query
def extract_tables(spark, sf):
    return X.extract_tables(S.seeded(spark, sf)).selectExpr("conv_key", "ordinal", "CAST(pos AS BIGINT) AS pos", "`table` AS table_text")


@query
def tables_verbatim(spark, sf):
    m = S.seeded(spark, sf)
    made = m.filter("role = 'assistant'").withColumnRenamed("text", "content")
    return X.tables_verbatim(m, made).select("conv_key", "src", "ordinal", "value")


@query
def table_cells(spark, sf):
    tables = X.extract_tables(S.seeded(spark, sf))
    return X.table_cells(tables).selectExpr(
        "conv_key", "ordinal", "CAST(pos AS BIGINT) AS pos", "CAST(row AS BIGINT) AS row_no", "CAST(col AS BIGINT) AS col_no", "header", "value"
    )


@query
def latest_images(spark, sf):
    return X.latest_images(S.seeded(spark, sf)).select("conv_key", "ordinal", "kind", "label", "value")


@query
def formulas(spark, sf):
    return X.formulas(S.seeded(spark, sf)).select("conv_key", "ordinal", "kind", "label", "value")


@query
def fenced_code(spark, sf):
    return X.fenced_code(S.seeded(spark, sf)).select("conv_key", "ordinal", "label", "value", "language")


@query
def urls(spark, sf):
    return X.urls(S.seeded(spark, sf)).select("conv_key", "ordinal", "kind", "label", "value")


@query
def endpoints(spark, sf):
    return X.endpoints(S.seeded(spark, sf)).select("conv_key", "ordinal", "kind", "label", "value")


@query
def generated_files(spark, sf):
    return X.generated_files(S.seeded(spark, sf)).select("conv_key", "ordinal", "name", "why", "source")


@query
def referenced_files(spark, sf):
    return X.referenced_files(S.seeded(spark, sf)).select("conv_key", "ordinal", "name", "source")


@query
def split_artifacts(spark, sf):
    inline, files = X.split_artifacts(S.artifacts(spark, sf))
    return inline.select("conv_key", "ordinal", F.lit("inline").alias("way"), F.col("label").alias("name"), F.col("value").alias("detail")).unionByName(
        files.select("conv_key", "ordinal", F.lit("file").alias("way"), "name", F.col("why").alias("detail"))
    )


@query
def dedupe_verbatim(spark, sf):
    m = S.seeded(spark, sf)
    return X.dedupe_verbatim(X.urls(m), X.endpoints(m), X.formulas(m), X.fenced_code(m)).select(*VERBATIM)


@query
def dedupe_files_by_stem(spark, sf):
    m = S.seeded(spark, sf)
    mentioned = S.chats(spark, sf).selectExpr(
        "conv_id AS conv_key", "2 AS src", "turn AS ordinal", "0 AS pos",
        "CASE turn % 3 WHEN 0 THEN 'docs/Report_' || CAST(conv_id % 8 AS STRING) || '.md' WHEN 1 THEN '/tmp/Plan.md' ELSE 'plan.txt' END AS name",
        "'mentioned' AS why", "'referenced' AS source",
    )
    return X.dedupe_files_by_stem(X.generated_files(m).unionByName(mentioned)).select(*FILES)


@query
def tier0_now(spark, sf):
    m = S.seeded(spark, sf)
    return X.tier0_now(m, X.dedupe_files_by_stem(X.generated_files(m)))


@query
def distill_deterministic_verbatim(spark, sf):
    verbatim, _ = P.tier0_facts(_seeded_transcript(spark, sf))
    return verbatim.select(*VERBATIM)


@query
def distill_deterministic_files(spark, sf):
    _, files = P.tier0_facts(_seeded_transcript(spark, sf))
    return files.select("conv_key", "name", "why", "source")


# -- transcript text -------------------------------------------------------------------------------------


@query
def render_transcript(spark, sf):
    units = C.transcript_units(S.seeded(spark, sf), S.artifacts(spark, sf))
    return C.render_transcript(units).selectExpr("conv_key", "part", "text AS full_text")


@query
def chunk_transcript(spark, sf):
    units = C.transcript_units(S.seeded(spark, sf))
    return C.chunk_transcript(units, max_chars=1500)


# -- model stage ---------------------------------------------------------------------------------------------


def _answer_json(spark, sf):
    """A mini-brief per turn, as a model may answer: fenced, with prose, cut or wrong."""
    item = lambda **c: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in c.items()])
    body = F.to_json(
        F.struct(
            F.expr("'State of turn ' || CAST(turn AS STRING)").alias("now"),
            F.array(item(text=F.expr("'Use plan ' || CAST(turn % 2 AS STRING)"), replaces=""), item(text="", replaces="x")).alias("decided"),
            F.array(item(text=F.expr("'Ask  about plan ' || CAST(turn % 3 AS STRING)")), item(text="Check the distiller output")).alias("open"),
            F.array(item(idea=F.expr("'use Plan ' || CAST((turn + 1) % 2 AS STRING)"), why="too slow")).alias("rejected"),
            F.array(
                item(kind="image", label="timeout", value=F.expr("CAST(turn AS STRING) || 's'"), language=""),
                item(kind="code", label="body", value=F.col("text"), language="txt"),
            ).alias("verbatim"),
            F.array(item(name=F.expr("'note_' || CAST(turn % 2 AS STRING) || '.md'"), why="ask", source="elsewhere")).alias("filesToAttach"),
        )
    )
    cut = F.regexp_replace(body, r'(?s)"verbatim".*\z', '"verbatim":[{"kind":"code","label":"x","val')
    return S.chats(spark, sf).select(
        F.col("conv_id").alias("conv_key"),
        F.col("turn").alias("chunk_ord"),
        F.when(F.expr("turn % 5 = 0"), F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye")))
        .when(F.expr("turn % 5 = 1"), F.concat(F.lit("Sure. "), body, F.lit(" Done.")))
        .when(F.expr("turn % 5 = 2"), cut)
        .when(F.expr("turn % 5 = 3 AND conv_id % 2 = 0"), F.concat(F.lit("See "), body, F.lit("\n```json\nnone here\n```")))
        .when(F.expr("turn % 5 = 3"), F.lit("no object at all"))
        .otherwise(body)
        .alias("output"),
        F.lit(None).cast("string").alias("error"),
    )


def _parsed(spark, sf):
    return M.parse_sections(_answer_json(spark, sf))


@query
def complete_batch(spark, sf):
    prompts = S.chats(spark, sf).selectExpr("conv_id AS conv_key", "turn AS chunk_ord", "text AS prompt")

    def echo(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise RuntimeError("refused")
        return "echo " + prompt

    return M.complete_batch(prompts, echo)


@query
def complete_with_ledger(spark, sf):
    """The same answers by way of a stored ledger, of which a second run asks failed prompts only."""
    prompts = S.chats(spark, sf).selectExpr("conv_id AS conv_key", "turn AS chunk_ord", "text AS prompt")
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def first(prompt: str) -> str:
        if len(prompt) % 7 < 2:
            raise RuntimeError("refused")
        return "first " + prompt

    def second(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise RuntimeError("refused")
        return "second " + prompt

    M.complete_with_ledger(prompts, first, ledger, batches=2)
    return M.complete_with_ledger(prompts, second, ledger, batches=2)


@query
def parse_sections(spark, sf):
    p = _parsed(spark, sf)
    return p.select(
        "conv_key",
        "chunk_ord",
        "error",
        "sections.now",
        F.expr("CAST(size(sections.decided) AS BIGINT)").alias("n_decided"),
        F.expr("CAST(size(sections.open) AS BIGINT)").alias("n_open"),
        F.expr("CAST(size(sections.verbatim) AS BIGINT)").alias("n_verbatim"),
        F.expr("get(sections.rejected, 0).idea").alias("idea"),
        F.expr("get(sections.verbatim, 0).kind").alias("kind"),
        F.expr("get(sections.verbatim, 1).value").alias("value"),
        F.expr("get(sections.files, 0).source").alias("source"),
    )


@query
def select_minibriefs(spark, sf):
    return M.select_minibriefs(_parsed(spark, sf))


@query
def fallback_notes(spark, sf):
    return M.fallback_notes(_parsed(spark, sf))


@query
def merge_fallback(spark, sf):
    p = _parsed(spark, sf)
    merged = p.filter("chunk_ord = 0").select(
        "conv_key",
        F.expr("CASE WHEN conv_key % 2 = 0 THEN sections END").alias("sections"),
        F.expr("CASE WHEN conv_key % 2 = 1 THEN 'bad' END").alias("error"),
    )
    return M.merge_fallback(merged, p).select("conv_key", F.col("sections.now").alias("now"), "note")


@query
def merge_latest_state(spark, sf):
    return M.merge_latest_state(M.section_items(_parsed(spark, sf))).select("conv_key", "section", "chunk_ord", "a", "b", "c")


def _items(spark, sf):
    return P._items(_parsed(spark, sf).select("conv_key", "chunk_ord", "sections").withColumn("conv_key", F.expr("CAST(conv_key AS STRING) || '/' || CAST(chunk_ord AS STRING)")))


@query
def reconcile_files(spark, sf):
    det = X.generated_files(S.seeded(spark, sf))
    model = S.chats(spark, sf).selectExpr(
        "conv_id AS conv_key", "0 AS src", "turn AS ordinal", "0 AS pos",
        "CASE turn % 4 WHEN 0 THEN 'report_' || CAST(conv_id % 8 AS STRING) || '.DOCX' WHEN 1 THEN 'sandbox:/mnt/data/new.csv' WHEN 2 THEN 'x/new.txt' ELSE 'ref.txt' END AS name",
        "'model' AS why", "CASE WHEN turn % 4 >= 2 THEN 'referenced' ELSE 'chat' END AS source",
    )
    return R.reconcile_files(det, model).select("conv_key", "name", "why", "source")


@query
def drop_meta(spark, sf):
    rows = S.chats(spark, sf).selectExpr(
        "conv_id AS conv_key", "turn",
        "text || CASE turn % 4 WHEN 0 THEN ' the Handoff' WHEN 1 THEN ' verbatim  section' WHEN 2 THEN ' undercounting' ELSE ' handoffs' END AS idea",
        "CASE WHEN turn % 4 = 3 AND conv_id % 3 = 0 THEN 'an extractor' ELSE 'extractors' END AS why",
    )
    return R.drop_meta(rows, "idea", "why").select("conv_key", "turn", "idea", "why")


def _facts(spark, sf):
    """(model, extracted) verbatim items with tables and images."""
    m = S.seeded(spark, sf)
    tables = X.tables_verbatim(m)
    images = X.latest_images(m)
    model = tables.filter("ordinal = 1").withColumn("value", F.replace("value", F.lit(" turn "), F.lit(" TURN "))).unionByName(
        images.filter("pos = 0").withColumn("value", F.upper("value"))
    )
    return model, tables.unionByName(images)


@query
def guarantee_tables(spark, sf):
    model, facts = _facts(spark, sf)
    return R.guarantee_tables(model, facts).select("conv_key", "kind", "value")


@query
def guarantee_tables_in_rounds(spark, sf):
    """The same tables, settled side by side over overlapping pairs instead of in a stream per chat."""
    model, facts = _facts(spark, sf)
    return R.guarantee_tables(model, facts, in_rounds=True).select("conv_key", "kind", "value")


@query
def guarantee_images(spark, sf):
    model, facts = _facts(spark, sf)
    return R.guarantee_images(model, facts).select("conv_key", "kind", "value")


@query
def table_overlap(spark, sf):
    docs = S.table(spark, sf, "documents").join(
        S.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    both = docs.select(
        "doc_id",
        T.overlap_tokens(F.col("text")).alias("a"),
        T.overlap_tokens(F.expr("'the of and ' || lang || ' ' || source || ' ' || coalesce(CAST(quality AS STRING), '')")).alias("b"),
    )
    return both.select("doc_id", F.round(R.table_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query
def guarantee_count(spark, sf):
    m = S.seeded(spark, sf)
    files = X.generated_files(m).unionByName(
        S.chats(spark, sf).filter("role = 'assistant'").selectExpr(
            "conv_id AS conv_key", "2 AS src", "turn AS ordinal", "0 AS pos",
            "'part_' || CAST(turn AS STRING) || '.md' AS name", "'w' AS why", "'chat' AS source",
        )
    )
    now = S.chats(spark, sf).groupBy(F.col("conv_id").alias("conv_key")).agg(
        F.expr("CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' Made PART_1.md and part_2.md ' END").alias("now")
    )
    return R.guarantee_count(now, files)


# -- rendering ----------------------------------------------------------------------------------------------------


@query
def render_item(spark, sf):
    kinds = "CASE turn % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'code' WHEN 2 THEN 'image' WHEN 3 THEN 'api' ELSE 'image' END"
    value = "CASE WHEN turn % 5 = 4 THEN 'HTTPS://x.example/' || CAST(turn AS STRING) ELSE text END"
    lang = "CASE WHEN conv_id % 2 = 0 THEN 'sql' ELSE CAST(NULL AS STRING) END"
    return S.chats(spark, sf).select(
        "conv_id", "turn", RD.render_item(F.expr(kinds), F.col("role"), F.expr(value), F.expr(lang)).alias("item")
    )


@query
def honesty_banner(spark, sf):
    rows = S.chats(spark, sf).groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("odd"), F.count("*").alias("n"))
    notes = F.expr("CASE WHEN n % 2 = 0 THEN array('Chunk ' || CAST(n AS STRING) || ' failed.', 'Merged.') ELSE array() END")
    return rows.select("conv_id", RD.honesty_banner(F.col("odd") == 0, F.col("odd"), notes).alias("banner"))


def _brief(spark, sf):
    t = _seeded_transcript(spark, sf)
    return t, P.distill_deterministic(t)


def _measured_brief(spark, sf):
    """The units of the transcripts and the briefs, from one collapse of the drafts."""
    t = _seeded_transcript(spark, sf)
    collapsed = P.keep(P.collapsed_artifacts(t), "kept_artifacts")
    return C.transcript_units(t.messages, collapsed, collapsed=True), P.distill_deterministic(t, collapsed=collapsed)


@query
def render_body(spark, sf):
    return RD.render_body(_brief(spark, sf)[1])


@query
def render_brief(spark, sf):
    return RD.render_brief(_brief(spark, sf)[1]).select("conv_key", "part", "human_md", "resume_prompt")


# -- evaluation -----------------------------------------------------------------------------------------------------


def _scorecard(spark, sf):
    return V.brief_metrics(*_measured_brief(spark, sf))


@query
def brief_metrics(spark, sf):
    return _scorecard(spark, sf).withColumn("reduction", F.round("reduction", 6))


@query
def scorecard_markdown(spark, sf):
    return SK.scorecard_markdown(_scorecard(spark, sf))


@query
def scorecard_document(spark, sf):
    verdicts = V.parse_verdict(_verdicts(spark, sf)).filter("turn = conv_id % 5")
    judged = _scorecard(spark, sf).join(
        verdicts.select(F.col("conv_id").alias("id"), "same_move", "reasoning"), "id", "left"
    )
    return SK.scorecard_document(judged, "stand-in")


@query
def corpus_summary(spark, sf):
    platforms = S.chats(spark, sf).select(F.col("conv_id").alias("conv_key"), F.expr(f"{S.CHAT_URL} AS url")).groupBy("conv_key").agg(
        F.min(PL.route_platform(F.col("url"))).alias("platform")
    )
    out = V.corpus_summary(_scorecard(spark, sf), platforms)
    return out.select("platform", "conversations", "full_chars", "brief_chars")


@query
def corpus_quantiles(spark, sf):
    """Quantiles of the reduction per platform, from stored parts of three batches of chats."""
    platforms = S.chats(spark, sf).select(F.col("conv_id").alias("conv_key"), F.expr(f"{S.CHAT_URL} AS url")).groupBy("conv_key").agg(
        F.min(PL.route_platform(F.col("url"))).alias("platform")
    )
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    card = P.keep(_scorecard(spark, sf), "scorecard")
    for batch in range(3):
        V.summary_parts(card.filter(F.expr(f"pmod(id, 3) = {batch}")), platforms).write.mode("append").parquet(path)
    out = V.summed_parts(spark.read.parquet(path))
    found = [F.round(F.col("quantiles")[n], 6).alias(name) for n, name in enumerate(("p10", "median", "p90"))]
    return out.select("platform", "conversations", *found, F.round("rank_error", 6).alias("rank_error"))


def _verdicts(spark, sf):
    return S.chats(spark, sf).selectExpr(
        "conv_id",
        "turn",
        "CASE turn % 4 WHEN 0 THEN 'ok {\"sameMove\": true, \"reasoning\": \"same\"} end' "
        "WHEN 1 THEN '{\"sameMove\": false}' WHEN 2 THEN text ELSE '{\"sameMove\": 1, \"reasoning\": \"' || role || '\"}' END AS output",
    )


@query
def parse_verdict(spark, sf):
    return V.parse_verdict(_verdicts(spark, sf)).select("conv_id", "turn", "same_move", "reasoning")


@query
def pass_rate(spark, sf):
    out = V.pass_rate(V.parse_verdict(_verdicts(spark, sf)))
    return out.select("n", "passed", F.round("rate", 6).alias("rate"))


@query
def distill_with_model(spark, sf):
    """The whole model way with a fixed stand-in model: the rendered briefs."""
    return RD.render_brief(_model_brief(spark, sf)).select("conv_key", "part", "human_md")


@query
def model_modes(spark, sf):
    """Who produced each brief of the model way, and what fell back."""
    return _model_brief(spark, sf).meta.select("conv_key", "produced_by", F.array_join("notes", " ").alias("notes"))


def stand_in_model(prompt: str) -> str:
    """A deterministic model: counts what it was given."""
    import json

    if prompt.startswith("MERGE "):
        return json.dumps({"now": "Merged.", "decided": [{"text": "Keep the plan"}, {"text": "fix the distiller"}]})
    if "| key | value |" in prompt and len(prompt) % 5 == 0:
        return "no answer"
    return json.dumps({"now": "One chunk.", "open": [{"text": "Next step"}]})


def _model_brief(spark, sf):
    t = _seeded_transcript(spark, sf)
    return P.distill_with_model(
        t,
        stand_in_model,
        "stand-in",
        lambda text, chunk: F.concat(F.lit("CHUNK "), text),
        lambda outputs: F.concat(F.lit("MERGE "), F.array_join(outputs, "\n")),
        max_chars=1500,
    )


def entry(spark: SparkSession, sf: str | None = None) -> DataFrame:
    """Flagship: chats -> facts -> rendered handoff briefs of a folder of tables
    (by default the one that BRIEFSPARK_SF_DIR names)."""
    return render_brief(spark, sf or os.environ.get("BRIEFSPARK_SF_DIR", "/root/testdata/sf0.001"))
