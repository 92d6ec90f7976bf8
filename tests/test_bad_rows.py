"""A broken row becomes an error row or is passed over; it never fails a job."""

import json

from pyspark.sql import functions as F

from briefspark.operators import blocks as B
from briefspark.operators import extract as X
from briefspark.operators import model as M
from briefspark.operators import replay as RP
from briefspark.sources import pages as PG
from briefspark.sources import payloads as PL

DEEP = "[" * 100_000 + "]" * 100_000


def search(spark, content) -> list[tuple]:
    raw = content if isinstance(content, str) and content.startswith('{"type"') else json.dumps({"type": "tool_result", "content": content})
    rows = spark.createDataFrame([("c", 0, "m", 0, raw)], "conv_key string, msg_ord bigint, msg_uuid string, block_ord bigint, raw string")
    return [(r["kind"], r["title"], r["url"]) for r in B.search_context(rows).collect()]


def test_string_results_are_no_search_results(spark):
    found = {"title": "T", "url": "https://a.example/"}
    assert search(spark, [found]) == [("source", "T", "https://a.example/")]
    assert search(spark, "[see note] done") == [] and search(spark, "{oops") == []
    assert search(spark, json.dumps([found])) == []


def test_half_a_surrogate_pair_in_a_title(spark):
    raw = '{"type":"tool_result","content":[{"title":"x\\ud83d","url":"https://a.example/"}]}'
    got = search(spark, raw)
    assert len(got) <= 1 and all("\ud83d" not in title for _, title, _ in got)


def test_claude_chat_with_a_string_result(spark):
    chat = {
        "uuid": "c", "name": "n", "current_leaf_message_uuid": "m1",
        "chat_messages": [
            {"uuid": "m0", "sender": "human", "content": [{"type": "text", "text": "hi"}]},
            {"uuid": "m1", "parent_message_uuid": "m0", "sender": "assistant", "content": [
                {"type": "tool_result", "content": "[see note] done"}, {"type": "text", "text": "ok"}]},
        ],
    }
    rows = [("c", "claude", None, None, json.dumps(chat)), ("d", "claude", None, None, DEEP)]
    t = PL.normalize(spark.createDataFrame(rows, "conv_key string, platform string, url string, captured_at string, payload string"))
    assert [r["text"] for r in t.messages.orderBy("ordinal").collect()] == ["hi", "ok"]


def test_sandbox_calls(spark):
    create = json.dumps({"path": "a.md", "file_text": "x\ny"})
    edits = ['{"path":"a.md","insert_line":1e999,"new_str":"end"}', '{"path":"a.md","insert_line":NaN,"new_str":"no"}', DEEP,
             '{"path":"a.md","insert_line":1000000000000000000000000,"new_str":"more"}', '{"path":"b\\ud83d.md","file_text":"z"}']
    names = ["create_file", "insert", "insert", "insert", "insert", "create_file"]
    rows = [("a", n, name, call) for n, (name, call) in enumerate(zip(names, [create, *edits]))]
    got = RP.replay_files(spark.createDataFrame(rows, "conv_key string, ord bigint, name string, input string")).collect()
    assert sorted((r["path"], r["content"]) for r in got) == [("/home/claude/a.md", "x\ny\nend\nmore"), ("/home/claude/b�.md", "z")]


def test_canvas_edits():
    def edit(pattern, replacement="!", text="aaa {b}", **more):
        doc = {"name": "n", "content": text, "type": None}
        payload = json.dumps({"updates": [{"pattern": pattern, "replacement": replacement, **more}]})
        return RP.edit_canvas(doc, "canmore.update_textdoc", payload, None)["content"]

    assert edit("a+") == "! {b}" and edit("a", multiple=True) == "!!! {b}"
    for bad in ("a{99999999999}", "a*+", "a{1,2}+", "(?>a)", "(?i)a", "(?P<x>a)", "(a", "[b"):
        assert edit(bad) == "aaa {b}", bad
    assert edit(r"[*+]+|a\++") == "aaa {b}" and edit("(?<x>a)(?=a)", "<$<x>>") == "<a>aa {b}"
    assert RP.edit_canvas({"name": "n", "content": "c", "type": None}, "update_textdoc", DEEP, None)["content"] == "c"


def test_slow_pattern_is_skipped(monkeypatch):
    monkeypatch.setattr(RP, "PATTERN_SECONDS", 0.2)
    doc = {"name": "n", "content": "a" * 40 + "b" * 40, "type": None}
    payload = json.dumps({"updates": [{"pattern": "(a|aa|b|bb)+$c", "replacement": ""}, {"pattern": "b+", "replacement": "!"}]})
    assert RP.edit_canvas(doc, "update_textdoc", payload, None)["content"] == "a" * 40 + "!"


def test_pages_with_broken_declarations(spark):
    rows = [(1, "<![unknown foo]><p>x</p>"), (2, "<![if x"), (3, None)]
    got = PG.messages_from_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert len(got) == 3 and all(r["error"] for r in got)


def test_answers_nested_too_deep(spark):
    rows = [(1, '{"now":' + "[" * 100_000, None)]
    out = M.parse_sections(spark.createDataFrame(rows, "id int, output string, error string")).collect()
    assert out[0]["error"] and out[0]["sections"] is None


def test_all_mentions_are_listed(spark):
    text = " ".join(f"see file_{n}.txt" for n in range(40))
    m = spark.createDataFrame([("c", 0, "human", text)], "conv_key string, ordinal bigint, role string, text string")
    assert X.referenced_files(m).count() == 40 and X.referenced_files(m, cap=25).count() == 25


def test_long_chat_is_one_document(spark):
    messages = [{"from": "user" if n % 2 == 0 else "assistant", "content": f"m{n}"} for n in range(3000)]
    rows = [("c", "huggingface", None, None, json.dumps({"title": "t", "messages": messages}))]
    t = PL.normalize(spark.createDataFrame(rows, "conv_key string, platform string, url string, captured_at string, payload string"))
    assert t.messages.filter(F.col("ordinal") == 2999).first()["text"] == "m2999" and t.messages.count() == 3000


def test_an_edit_that_takes_too_long_is_counted(monkeypatch):
    monkeypatch.setattr(RP, "PATTERN_SECONDS", 0.2)
    fold = RP._CanvasFold()
    slow = {"pattern": "(a|aa)+$", "replacement": "x", "multiple": True}
    good = {"pattern": "!", "replacement": "?"}
    fold.add(3, "canmore.create_textdoc", json.dumps({"name": "n", "content": "a" * 60 + "!"}), None)
    fold.add(4, "canmore.update_textdoc", json.dumps({"updates": [slow, good, slow | {"pattern": "("}]}), None)
    [(first, name, kind, content, skipped)] = fold.rows()
    assert (first, name, kind, skipped) == (3, "n", None, 1) and content == "a" * 60 + "?"
