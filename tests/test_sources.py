from __future__ import annotations

import json

from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.operators import branch as BR
from briefspark.operators import model as M
from briefspark.operators import replay as RP
from briefspark.sources import pages as PG
from briefspark.sources import payloads as PL

PAYLOAD = "conv_key string, platform string, url string, captured_at string, payload string"


def payload(spark, platform, *docs):
    rows = [(str(i), platform, None, "2026-01-02T00:00:00Z", d if isinstance(d, (str, type(None))) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, PAYLOAD)


def talk(messages):
    return [(r.role, r.text) for r in messages.orderBy("conv_key", "ordinal").collect()]


def test_grok_order_fallbacks_and_errors(spark):
    p = payload(
        spark,
        "grok",
        {
            "responses": [
                {"sender": "ASSISTANT", "message": " second ", "createTime": "2026-01-01T00:00:02Z"},
                {"sender": "human", "query": "first", "message": "x", "createTime": "2026-01-01T00:00:01Z"},
                {"sender": "human", "query": "", "message": "kept out", "createTime": "2026-01-01T00:00:03Z"},
                {"sender": "human", "message": "gone", "isControl": True},
            ]
        },
        "not json",
        {"responses": []},
        None,
    )
    t = PL.normalize_grok(p)
    assert talk(t.messages) == [("human", "first"), ("assistant", "second")]
    assert {(r.conv_key, r.error) for r in t.errors.collect()} == {
        ("1", "payload is not valid JSON"),
        ("2", "no messages parsed"),
        ("3", "no payload"),
    }


def test_chatgpt_canvas_and_sources(spark):
    node = lambda i, parent, **m: {"id": i, "parent": parent, "message": {"id": i, **m}}
    doc = {
        "title": "T",
        "conversation_id": "c1",
        "current_node": "d",
        "mapping": {
            "a": node("a", None, author={"role": "user"}, content={"content_type": "text", "parts": ["hi", {"x": 1}]}),
            "b": node(
                "b", "a", author={"role": "assistant"}, recipient="canmore.create_textdoc",
                content={"content_type": "code", "text": json.dumps({"name": "essay", "type": "document", "content": "Hello DRAFT world"})},
            ),
            "c": node(
                "c", "b", author={"role": "assistant"}, recipient="canmore.update_textdoc",
                content={"content_type": "code", "text": json.dumps({"updates": [{"pattern": "(", "replacement": "!"}, {"pattern": "DRAFT", "replacement": "FINAL"}]})},
            ),
            "d": node(
                "d", "c", author={"role": "assistant"}, recipient="all",
                content={"content_type": "text", "parts": ["done"]},
                metadata={
                    "content_references": [{"items": [{"url": "u1", "title": "old"}, {"url": "u2"}]}],
                    "citations": [{"metadata": {"url": "u1", "title": "new"}}],
                },
            ),
            "x": node("x", "a", author={"role": "user"}, content={"content_type": "text", "parts": ["other branch"]}),
        },
    }
    t = PL.normalize_chatgpt(payload(spark, "chatgpt", doc))
    assert talk(t.messages) == [("human", "hi"), ("assistant", "done\n\nSources:\n- new: u1\n- u2: u2")]
    a = t.artifacts.first()
    assert (a.filename, a.content, a.presented) == ("essay.md", "Hello FINAL world", True)
    assert t.integrity.first().total_blocks == 3


def test_claude_blocks_files_images(spark):
    blocks = [
        {"type": "text", "text": "see <antArtifact identifier=\"n.md\" type=\"t\">body</antArtifact>"},
        {"type": "image", "alt_text": "Liquid IV Tropical"},
        {"type": "knowledge", "content": [{"title": "Liquid IV Lemon", "url": "https://x.io/a.png"}, {"title": "Page", "url": "https://p.io"}]},
        {"type": "tool_use", "name": "artifacts", "input": {"display_content": json.dumps({"filename": "c.yaml", "code": "k: 1"})}},
        {"type": "tool_use", "name": "create_file", "input": {"path": "draft.md", "file_text": "one two"}},
        {"type": "tool_use", "name": "str_replace", "input": {"path": "draft.md", "old_str": "two", "new_str": "TWO"}},
        {"type": "tool_use", "name": "bash_tool", "input": {"command": "cd /home/claude && cp draft.md '/mnt/user-data/outputs/the end.md'"}},
        {"type": "tool_use", "name": "present_files", "input": {"filepaths": ["/mnt/user-data/outputs/the end.md", "/mnt/user-data/outputs/deck.pptx"]}},
        {"type": "odd", "b": 1, "a": 2},
    ]
    doc = {
        "uuid": "c", "name": " ", "current_leaf_message_uuid": "m2",
        "chat_messages": [
            {"uuid": "m1", "sender": "human", "text": "flat"},
            {"uuid": "m2x", "parent_message_uuid": "m1", "sender": "assistant", "content": [{"type": "text", "text": "old"}]},
            {"uuid": "m2", "parent_message_uuid": "m1", "sender": "assistant", "content": blocks},
        ],
    }
    t = PL.normalize_claude(payload(spark, "claude", doc))
    rows = t.messages.orderBy("ordinal").collect()
    assert [(r.role, r.text) for r in rows] == [("human", "flat"), ("assistant", "see\n\nSources:\n- Page: https://p.io")]
    assert rows[1].images == ["Liquid IV (image search)"]
    arts = [(r.artifact_id, r.filename, r.content, r.binary, r.presented) for r in t.artifacts.orderBy("ordinal").collect()]
    assert arts == [
        ("artifact-1", "c.yaml", "k: 1", False, False),
        ("artifact-2", "n.md", "body", False, False),
        ("artifact-3", "the end.md", "one TWO", False, True),
        ("artifact-4", "deck.pptx", "", True, True),
    ]
    i = t.integrity.first()
    assert (i.total_blocks, i.classified_blocks, i.complete) == (10, 9, False)
    u = t.unknown.first()
    assert (u.hint, u.preview) == ("type:odd", '{"type":"odd","b":1,"a":2}')
    assert t.meta.first().title == "Untitled conversation"


def test_branch_cycle_missing_leaf_and_doubling(spark):
    rows = [("cycle", i, f"n{i}", f"n{(i + 2) % 3}") for i in range(3)]
    rows += [("lost", i, f"n{i}", None) for i in range(3)]
    rows += [("long", i, f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("long", 40, "x", "n3")]
    nodes = spark.createDataFrame(rows, "conv_key string, pos bigint, node string, parent string")
    leaf = spark.createDataFrame([("cycle", "n1"), ("lost", "zz"), ("long", "n39")], "conv_key string, leaf string")
    got = {}
    for limit in (2_000, 2):
        out = BR.active_branch(nodes, leaf, fold_nodes=limit).orderBy("conv_key", "branch_ord").collect()
        got[limit] = [(r.conv_key, r.node) for r in out]
    assert got[2_000] == got[2]
    assert got[2] == (
        [("cycle", n) for n in ("n2", "n0", "n1")]
        + [("long", f"n{i}") for i in range(40)]
        + [("lost", f"n{i}") for i in range(3)]
    )


def test_replay_routes_give_the_same_files(spark):
    call = lambda **k: json.dumps(k)
    plain = [
        ("a", 0, "create_file", call(path="a.md", file_text="x\ny")),
        ("a", 1, "insert", call(path="/home/claude/a.md", insert_line=1, insert_text="new")),
        ("a", 2, "str_replace", call(path="a.md", old_str="absent", new_str="z")),
        ("a", 3, "str_replace_based", call(command="create", path="b.md", file_text="b")),
    ]
    events = "conv_key string, ord bigint, name string, input string"
    tied = plain + [("a", 4, "bash_tool", call(command="ls; rm -f gone.md"))]
    read = lambda rows: sorted(
        (r.path, r.content) for r in RP.replay_files(spark.createDataFrame(rows, events)).collect()
    )
    assert read(plain) == read(tied) == [("/home/claude/a.md", "x\nnew\ny"), ("/home/claude/b.md", "b")]


def test_parse_salvage_and_null_items(spark):
    cut = '{"now":"n","decided":[{"text":"a"},{"text":"b"},{"te'
    odd = 'use ```json\nnot here``` {"now": 1, "verbatim": [{"kind": "image", "value": "v"}]}'
    rows = [(0, cut, None), (1, '{"decided":[null]}', None), (2, "{broken", None), (3, odd, None)]
    out = M.parse_sections(spark.createDataFrame(rows, "id int, output string, error string")).orderBy("id").collect()
    assert [d.text for d in out[0].sections.decided] == ["a", "b"]
    assert out[1].error == "null item in a section" and out[1].sections is None
    assert out[2].error and out[2].sections is None
    # the fence is what counts, and it holds no object
    assert out[3].error == K.NOTE_NO_OBJECT and out[3].sections is None
    # a model image is read as a constraint: the parser knows no image kind
    bare = [(0, odd.replace("```json\nnot here```", ""), None)]
    out = M.parse_sections(spark.createDataFrame(bare, "id int, output string, error string")).collect()
    assert out[0].sections.now == "" and out[0].sections.verbatim[0].kind == "constraint"


def test_pages_by_container_and_alternation():
    html = "<article>" + "a" * 30 + "<script>no</script></article><article class='bot'>" + "b" * 30 + "</article>"
    assert PG.page_messages(html) == [("human", "a" * 30), ("assistant", "b" * 30)]
    assert PG.page_messages("<p>nothing</p>") == []


def test_read_payloads_from_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"messages":[{"from":"user","content":"hi"}]}\nbad\n')
    p = PL.read_payloads(spark, str(tmp_path), "lines", platform="huggingface")
    t = PL.normalize(p)
    assert talk(t.messages) == [("human", "hi")]
    assert t.errors.count() == 1 and p.select(F.countDistinct("conv_key")).first()[0] == 2


def test_mixed_platforms_from_one_table(spark, tmp_path):
    rows = [
        ("a", "huggingface", None, None, json.dumps({"messages": [{"from": "user", "content": "one"}]})),
        ("b", "deepseek", None, None, json.dumps({"messages": [{"role": "user", "content": "two"}]})),
        ("c", "generic", None, None, "{}"),
    ]
    table = PL.by_platform(spark.createDataFrame(rows, PAYLOAD), str(tmp_path / "payloads"))
    assert sorted(r["text"] for r in PL.normalize(table).messages.collect()) == ["one", "two"]
    plan = table.filter("platform = 'grok'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in plan
