"""Inputs of the registered queries, derived from the given tables.

The chat table holds none of the patterns that the operators look for, so every
message gets some appended.  The expressions marked "shared" are valid in Spark
and in ANSI engines and are used word for word by the check SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# -- shared expressions ---------------------------------------------------------

SEEDED_TEXT = """text || CASE turn % 6
    WHEN 0 THEN ' see services/mod_' || CAST(conv_id % 7 AS STRING) || '.py and www.site' || CAST(conv_id % 5 AS STRING) || '.org/a/x.html and éx' || CAST(conv_id % 3 AS STRING) || '.py'
    WHEN 1 THEN chr(10) || chr(10) || '| key | value |' || chr(10) || '| --- | --- |' || chr(10) || '| conv | ' || CAST(conv_id % 11 AS STRING) || ' |' || chr(10) || '| turn | ' || CAST(turn AS STRING) || ' |' || chr(10)
    WHEN 2 THEN chr(10) || '```python' || chr(10) || 'def f_' || CAST(conv_id % 9 AS STRING) || '(x):' || chr(10) || '    return x' || chr(10) || '```' || chr(10)
    WHEN 3 THEN ' Call GET /api/v1/items/' || CAST(conv_id % 13 AS STRING) || ' or https://api.example.com/v1/' || CAST(conv_id % 4 AS STRING)
    WHEN 4 THEN ' total B12=B5+B6+B7 and ratio =C2/C' || CAST(3 + conv_id % 6 AS STRING)
    ELSE ' [get](sandbox:/mnt/data/Report_' || CAST(conv_id % 8 AS STRING) || '.docx)'
  END"""

ROLE = "CASE WHEN role = 'user' THEN 'human' ELSE 'assistant' END"

#: text between blanks, all blank on every fifth turn
PADDED_TEXT = (
    "CASE WHEN turn % 5 = 3 THEN '  ' || chr(9) || chr(10) || chr(160) "
    "ELSE chr(10) || ' ' || text || chr(160) || ' ' END"
)

#: an address on one of ten hosts
CHAT_URL = """CASE conv_id % 10
    WHEN 0 THEN 'https://claude.ai/chat/' || lpad(CAST(conv_id AS STRING), 8, '0') || '-ab?x=1'
    WHEN 1 THEN 'https://chatgpt.com/c/' || lpad(CAST(conv_id AS STRING), 36, 'a')
    WHEN 2 THEN 'https://gemini.google.com/app/' || lpad(CAST(conv_id AS STRING), 12, 'z')
    WHEN 3 THEN 'https://www.perplexity.ai/search/topic-' || CAST(turn AS STRING) || '?q=1'
    WHEN 4 THEN 'https://grok.com/c/' || lpad(CAST(conv_id AS STRING), 10, 'f')
    WHEN 5 THEN 'https://chat.deepseek.com/a/chat/s/' || lpad(CAST(conv_id AS STRING), 9, 'e')
    WHEN 6 THEN 'https://huggingface.co/chat/conversation/' || lpad(CAST(conv_id AS STRING), 24, 'c')
    WHEN 7 THEN 'https://team.claude.ai/projects'
    WHEN 8 THEN 'https://notclaude.ai/chat/' || lpad(CAST(conv_id AS STRING), 8, '0')
    ELSE 'https://chat.openai.com/c/' || lpad(CAST(conv_id AS STRING), 36, '9')
  END"""

#: content block of a turn: one of eight shapes
BLOCK_SHAPE = "turn % 8"

FILE_PATH = """CASE turn % 4
    WHEN 0 THEN '/home/claude/work/note_' || CAST(conv_id % 5 AS STRING) || '.tar.gz'
    WHEN 1 THEN 'sandbox:/mnt/data/Report_' || CAST(conv_id AS STRING) || '.PDF'
    WHEN 2 THEN 'docs/.env'
    ELSE 'a/b_' || CAST(turn AS STRING) || '.Md/'
  END"""

DRAFT_TEXT = "text || CASE v WHEN 0 THEN '' ELSE ' revised second edition' END"


# -- tables ------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages(conv_key, ordinal, role, text, images) with planted facts."""
    return chats(spark, sf_dir).select(
        F.col("conv_id").alias("conv_key"),
        F.col("turn").alias("ordinal"),
        F.expr(ROLE).alias("role"),
        F.expr(SEEDED_TEXT).alias("text"),
        F.array(F.expr("'Chart of ' || role"), F.expr("' chart OF ' || role"), F.lit("")).alias("images"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages as artifacts, each in two drafts."""
    return (
        chats(spark, sf_dir)
        .filter("role = 'assistant'")
        .withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
        .selectExpr(
            "conv_id AS conv_key",
            "turn * 2 + v AS ordinal",
            "'artifact-' || CAST(turn * 2 + v AS STRING) AS artifact_id",
            "'Draft ' || CAST(turn AS STRING) AS title",
            "CASE turn % 3 WHEN 0 THEN 'out_' || CAST(turn AS STRING) || '.md' WHEN 1 THEN 'plan.pdf' ELSE CAST(NULL AS STRING) END AS filename",
            "CASE WHEN turn % 2 = 0 THEN 'markdown' ELSE CAST(NULL AS STRING) END AS language",
            f"{DRAFT_TEXT} AS content",
            "'tool_use' AS format",
            "CASE WHEN turn % 4 = 1 THEN 'reconstructed' ELSE 'm' || CAST(turn AS STRING) END AS msg_uuid",
            "turn % 3 = 1 AS binary",
            "turn % 4 = 2 AS presented",
        )
    )


def branch_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A chain of turns with an abandoned sibling at each; chats that open with a
    system message have no known leaf."""
    rows = chats(spark, sf_dir)
    nodes = rows.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
        "conv_id AS conv_key",
        "turn * 2 + v AS pos",
        "CASE v WHEN 0 THEN 'n' ELSE 'x' END || CAST(turn AS STRING) AS node",
        "CASE WHEN turn = 0 THEN CAST(NULL AS STRING) ELSE 'n' || CAST(turn - 1 AS STRING) END AS parent",
        "CAST(100 - turn AS DOUBLE) AS create_time",
        "v = 0 AS has_message",
    )
    leaf = (
        rows.groupBy(F.col("conv_id").alias("conv_key"))
        .agg(F.max("turn").alias("t"), F.bool_or(F.col("role") == "system").alias("lost"))
        .select("conv_key", F.expr("CASE WHEN lost THEN 'gone' ELSE 'n' || CAST(t AS STRING) END").alias("leaf"))
    )
    return nodes, leaf


def block_json() -> Column:
    """JSON of the content block of a turn."""
    t = F.col("text")
    n = F.col("conv_id").cast("string")
    shape = F.expr(BLOCK_SHAPE)
    url = F.concat(F.lit("https://src.example/"), n)
    return (
        F.when(
            shape == 0,
            F.to_json(
                F.struct(
                    F.lit("text").alias("type"),
                    t.alias("text"),
                    F.array(
                        F.struct(url.alias("url"), F.lit("First").alias("title")),
                        F.struct(url.alias("url"), F.lit("Second").alias("title")),
                        F.struct(F.lit("ftp://x").alias("url"), F.lit("No").alias("title")),
                    ).alias("citations"),
                )
            ),
        )
        .when(shape == 1, F.to_json(F.struct(F.lit("image").alias("type"), F.concat(F.lit(" Map of "), n, F.lit(" ")).alias("alt_text"))))
        .when(
            shape == 2,
            F.to_json(
                F.struct(
                    F.lit("tool_use").alias("type"),
                    F.lit("artifacts").alias("name"),
                    F.struct(
                        F.struct(
                            F.concat(F.lit("f_"), n, F.lit(".md")).alias("filename"),
                            t.alias("code"),
                            F.lit("markdown").alias("language"),
                            F.lit("T").alias("title"),
                        ).alias("display_content")
                    ).alias("input"),
                )
            ),
        )
        .when(
            shape == 3,
            F.to_json(
                F.struct(
                    F.lit("tool_use").alias("type"),
                    F.lit("create_file").alias("name"),
                    F.struct(F.lit("/home/claude/a.md").alias("path"), t.alias("file_text")).alias("input"),
                )
            ),
        )
        .when(
            (shape == 4) & (F.col("conv_id") % 3 == 0),
            F.to_json(
                F.struct(
                    F.lit("tool_result").alias("type"),
                    F.concat(F.lit('[{"title":"In a string","url":"'), url, F.lit('"}] see note')).alias("content"),
                )
            ),
        )
        .when(
            shape == 4,
            F.to_json(
                F.struct(
                    F.lit("web_search_tool_result").alias("type"),
                    F.array(
                        F.struct(F.lit("Page").alias("title"), url.alias("url"), F.lit(None).cast("string").alias("image_url")),
                        F.struct(
                            F.concat(F.lit(" Pic "), n).alias("title"),
                            F.concat(url, F.lit("/a.PNG?s=1")).alias("url"),
                            F.lit(None).cast("string").alias("image_url"),
                        ),
                        F.struct(
                            F.lit("Thumb").alias("title"),
                            F.lit("none").alias("url"),
                            F.concat(url, F.lit("/t")).alias("image_url"),
                        ),
                        F.struct(F.lit("Again").alias("title"), url.alias("url"), F.lit(None).cast("string").alias("image_url")),
                    ).alias("content"),
                )
            ),
        )
        .when(shape == 5, F.to_json(F.struct(F.lit("thinking").alias("type"), t.alias("thinking"))))
        .when(shape == 6, F.to_json(F.struct(F.lit("mystery").alias("type"), t.alias("payload"))))
        .otherwise(F.to_json(F.struct(t.alias("payload"))))
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks(conv_key, msg_ord, msg_uuid, block_ord, raw): two turns make a message."""
    return chats(spark, sf_dir).select(
        F.col("conv_id").alias("conv_key"),
        F.expr("CAST(floor(turn / 2) AS BIGINT)").alias("msg_ord"),
        F.expr("'m' || CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING)").alias("msg_uuid"),
        F.expr("turn % 2").alias("block_ord"),
        block_json().alias("raw"),
    )


# -- payloads of the platforms --------------------------------------------------------


def pages_of_chats(spark: SparkSession, sf_dir: str, padded: bool = True, flat_roles: bool = False) -> DataFrame:
    """One row per chat, however long: conv_key and its turns in order."""
    role = "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END" if flat_roles else "role"
    rows = chats(spark, sf_dir).select(
        F.expr("CAST(conv_id AS STRING)").alias("conv_key"),
        "conv_id",
        "turn",
        F.expr(role).alias("role"),
        F.expr(PADDED_TEXT if padded else "text").alias("text"),
    )
    return rows.groupBy("conv_key").agg(
        F.array_sort(F.collect_list(F.struct("turn", "conv_id", "role", "text"))).alias("turns")
    )


def _payload(df: DataFrame, platform: str, payload: Column) -> DataFrame:
    return df.select(
        "conv_key",
        F.lit(platform).alias("platform"),
        F.lit(None).cast("string").alias("url"),
        F.lit("2026-06-26T00:00:00Z").alias("captured_at"),
        payload.alias("payload"),
    )


def hf_payloads(pages: DataFrame) -> DataFrame:
    messages = F.transform("turns", lambda m: F.struct(m["role"].alias("from"), m["text"].alias("content")))
    return _payload(pages, "huggingface", F.to_json(F.struct(F.lit(" Chat ").alias("title"), messages.alias("messages"))))


def deepseek_payloads(pages: DataFrame) -> DataFrame:
    messages = F.transform(
        "turns",
        lambda m: F.struct(
            F.upper(m["role"]).alias("role"),
            F.when(m["role"] == "user", m["text"].cast("variant"))
            .otherwise(F.to_variant_object(F.struct(m["text"].alias("text"))))
            .alias("content"),
        ),
    )
    return _payload(
        pages,
        "deepseek",
        F.to_json(
            F.struct(F.lit(0).alias("code"), F.struct(F.struct(messages.alias("chat_messages")).alias("biz_data")).alias("data"))
        ),
    )


def grok_payloads(pages: DataFrame) -> DataFrame:
    """Newest first, with a control row and a partial row for every turn."""

    def reply(m: Column, control: bool, partial: bool) -> Column:
        human = m["role"] == "user"
        stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + m["turn"]), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.struct(
            F.when(human, F.lit("human")).otherwise(F.lit("ASSISTANT")).alias("sender"),
            F.when(~human, m["text"]).alias("message"),
            F.when(human, m["text"]).alias("query"),
            F.lit(control).alias("isControl"),
            F.lit(partial).alias("partial"),
            stamp.alias("createTime"),
        )

    every = F.reverse(
        F.flatten(
            F.transform("turns", lambda m: F.array(reply(m, False, False), reply(m, True, False), reply(m, False, True)))
        )
    )
    return _payload(pages, "grok", F.to_json(F.struct(F.lit("Talk").alias("title"), every.alias("responses"))))


def perplexity_payloads(pages: DataFrame, sources: bool = True) -> DataFrame:
    def entry(m: Column) -> Column:
        human = m["role"] == "user"
        card = F.array(
            F.struct(F.lit("One").alias("title"), F.lit("https://one.example").alias("url")),
            F.struct(F.lit("Same").alias("title"), F.lit("https://one.example").alias("url")),
            F.struct(F.lit(None).cast("string").alias("title"), F.lit("https://two.example").alias("url")),
        )
        return F.struct(
            F.when(human, m["text"]).alias("query"),
            F.when(~human, m["text"]).alias("answer"),
            (F.when(~human, card) if sources else F.lit(None).cast("array<struct<title:string,url:string>>")).alias(
                "search_results"
            ),
        )

    return _payload(
        pages,
        "perplexity",
        F.to_json(F.struct(F.lit("Thread").alias("title"), F.col("conv_key").alias("slug"), F.transform("turns", entry).alias("entries"))),
    )


def _id(m: Column, prefix: str, back: int = 0) -> Column:
    return F.concat(F.lit(prefix), (m["turn"] - back).cast("string"))


def chatgpt_payloads(pages: DataFrame) -> DataFrame:
    """A chain of nodes with a hidden node and an abandoned sibling at every turn."""

    def node(m: Column, prefix: str, parent: str, hidden: bool, text: Column) -> Column:
        first = F.get("turns", F.lit(0))["turn"]
        up = F.when(m["turn"] > first, _id(m, parent, 1)) if prefix != "h" else _id(m, "n")
        held = F.when(m["turn"] > first, _id(m, "h", 1)) if prefix == "n" else up
        return F.struct(
            _id(m, prefix).alias("key"),
            F.struct(
                _id(m, prefix).alias("id"),
                held.alias("parent"),
                F.struct(
                    _id(m, prefix).alias("id"),
                    F.struct(m["role"].alias("role")).alias("author"),
                    F.lit("all").alias("recipient"),
                    m["turn"].cast("double").alias("create_time"),
                    F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content"),
                    F.struct(F.lit(hidden).alias("is_visually_hidden_from_conversation")).alias("metadata"),
                ).alias("message"),
            ).alias("value"),
        )

    nodes = F.flatten(
        F.transform(
            "turns",
            lambda m: F.array(
                node(m, "n", "h", False, m["text"]),
                node(m, "h", "n", True, F.lit("hidden")),
                node(m, "x", "n", False, F.lit("abandoned")),
            ),
        )
    )
    last = F.element_at("turns", -1)
    return _payload(
        pages,
        "chatgpt",
        F.to_json(
            F.struct(
                F.lit("Chat").alias("title"),
                F.col("conv_key").alias("conversation_id"),
                _id(last, "n").alias("current_node"),
                F.map_from_entries(nodes).alias("mapping"),
            )
        ),
    )


def json_quote(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.regexp_replace(quoted, r"(?s)^\[(.*)\]\z", "$1")


def gemini_payloads(pages: DataFrame) -> DataFrame:
    def turn(m: Column) -> Column:
        said = json_quote(m["text"])
        return F.when(
            m["role"] == "user", F.concat(F.lit("[null,null,[["), said, F.lit("]],null]"))
        ).otherwise(
            F.concat(F.lit('[null,null,null,[[["rc0",[""]],["rc1",['), said, F.lit("]]]]]"))
        )

    inner = F.concat(F.lit("[["), F.array_join(F.reverse(F.transform("turns", turn)), ","), F.lit("]]"))
    framed = F.concat(
        F.lit(")]}'\n\n99\n[[\"di\",7]]\n12\n[[\"wrb.fr\",\"hNvQHb\","), json_quote(inner), F.lit(",null]]\n25\n[[\"e\",4]]")
    )
    return _payload(pages, "gemini", framed)


def claude_payloads(pages: DataFrame) -> DataFrame:
    """A chain of messages with an abandoned sibling, an unknown block on system
    turns, and one attachment per turn."""
    first = F.get("turns", F.lit(0))["turn"]
    Block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))  # noqa: E731,N806

    def msg(m: Column, prefix: str, text: Column) -> Column:
        odd = F.when(m["role"] == "system", F.array(Block("mystery", F.lit("odd")))).otherwise(
            F.array().cast("array<struct<type:string,text:string>>")
        )
        return F.struct(
            _id(m, prefix).alias("uuid"),
            F.when(m["turn"] > first, _id(m, "n", 1)).alias("parent_message_uuid"),
            F.when(m["role"] == "user", F.lit("human")).otherwise(F.lit("assistant")).alias("sender"),
            F.concat(F.array(Block("text", text)), odd).alias("content"),
            F.array(
                F.struct(
                    F.concat(F.lit(" Sheet_"), (m["turn"] % 2).cast("string"), F.lit(".csv ")).alias("file_name"),
                    F.lit("csv").alias("file_type"),
                )
            ).alias("attachments"),
        )

    messages = F.flatten(
        F.transform("turns", lambda m: F.array(msg(m, "x", F.lit("abandoned")), msg(m, "n", m["text"])))
    )
    return _payload(
        pages,
        "claude",
        F.to_json(
            F.struct(
                F.col("conv_key").alias("uuid"),
                F.lit(" Talk ").alias("name"),
                _id(F.element_at("turns", -1), "n").alias("current_leaf_message_uuid"),
                messages.alias("chat_messages"),
            )
        ),
    )
