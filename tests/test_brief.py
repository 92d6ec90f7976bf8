"""Whole briefs on two small chats with known sizes, and the model way with a stand-in."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from briefspark.operators import chunk as C
from briefspark.operators import evaluate as V
from briefspark.operators import render as R
from briefspark.plans import distill as P
from briefspark.sources import payloads as PL
from briefspark.sources import sinks as SK
from tests.test_sources import payload

PLAN = [
    ("human", "Pick a queue for the jobs. Kafka or Redis?"),
    ("assistant", "Redis fits: POST /jobs and see worker.py\n| q | n |\n|---|---|\n| a | 1 |\n"),
    ("human", "Also write [out](sandbox:/mnt/data/Plan.docx) and [x](sandbox:/mnt/data/Data.csv)"),
]


@pytest.fixture(scope="module")
def chat(spark):
    doc = {
        "uuid": "c", "name": "Queue", "current_leaf_message_uuid": "m2",
        "chat_messages": [
            {"uuid": f"m{i}", "parent_message_uuid": f"m{i - 1}" if i else None, "sender": who, "content": [{"type": "text", "text": t}]}
            for i, (who, t) in enumerate(PLAN)
        ],
    }
    return PL.normalize_claude(payload(spark, "claude", doc))


def test_brief_text_and_metrics(chat):
    brief = P.distill_deterministic(chat)
    row = R.render_brief(brief, brand="Test").first()
    assert row.human_md.startswith(
        "# Handoff brief, Queue\n\n_Test · schema v1 · produced by deterministic · generated 2026-01-02._\n\n## Now\n\n"
        "Captured this conversation (3 messages). Files produced: Plan.docx, Data.csv.\n\n## Verbatim, keep exact\n\n"
        "**table**\n\n| q | n |\n|---|---|\n| a | 1 |\n\n- **endpoint** (api): `POST /jobs`\n\n## Bring these"
    )
    assert "- `worker.py`, referred to in the chat" in row.human_md
    assert row.resume_prompt.endswith("\nThat is the full current state. Continue from here.")
    units = C.transcript_units(chat.messages, chat.artifacts)
    m = V.brief_metrics(units, brief, brand="Test").first()
    full = C.render_transcript(units).first().text
    assert (m.full_chars, m.brief_chars) == (len(full), len(row.human_md))
    assert m.reduction == pytest.approx(1 - len(row.human_md) / len(full))
    assert (m.verbatim, m.files, m.integrity_complete) == (2, 3, True)


def run_model(chat, answers, max_chars=16_000):
    def model(prompt: str) -> str:
        return answers["merge" if prompt.startswith("MERGE") else "chunk"]

    return P.distill_with_model(
        chat,
        model,
        "fake",
        lambda text, i: F.concat(F.lit("CHUNK "), text),
        lambda outputs: F.concat(F.lit("MERGE "), F.array_join(outputs, "\n")),
        max_chars=max_chars,
    )


def test_model_brief_is_reconciled(chat):
    answer = {
        "now": "Queue chosen.",
        "decided": [{"text": "Redis", "replaces": "Kafka"}, {"text": "the distiller is nice"}],
        "verbatim": [{"kind": "table", "label": "t", "value": "| q | n | z |\n|---|---|---|\n| a | 1 | 2 |"}],
        "filesToAttach": [{"name": "plan.md", "source": "referenced", "why": "w"}],
    }
    text = R.render_brief(run_model(chat, {"chunk": json.dumps(answer)})).first().human_md
    assert "Queue chosen. Files produced in this chat (2): Plan.docx, Data.csv." in text
    assert "- Redis _(replaced: Kafka)_" in text and "distiller" not in text
    assert text.count("| a | 1 |") == 1 and "plan.md" not in text and "produced by fake ·" in text


def test_model_failures_are_told(chat):
    failed = R.render_brief(run_model(chat, {"chunk": "nothing"})).first().human_md
    assert "fake (fallback: deterministic)" in failed and "Distiller fell back" in failed
    assert "Captured this conversation (3 messages)." in failed
    merged = run_model(chat, {"chunk": '{"now":"part"}', "merge": "bad"}, max_chars=60)
    text = R.render_brief(merged).first().human_md
    assert "used the final chunk's brief" in text and "\npart Files produced" in text
    good = run_model(chat, {"chunk": '{"now":"part"}', "merge": '{"now":"60s"}'}, max_chars=60)
    assert "\n60s Files produced" in R.render_brief(good).first().human_md


def test_sinks(chat, tmp_path, spark):
    brief = P.distill_deterministic(chat)
    docs = SK.briefs_for_export(R.render_brief(brief), brief.meta)
    SK.write_briefs(docs, str(tmp_path / "briefs"))
    back = spark.read.parquet(str(tmp_path / "briefs"))
    assert sorted(r.file_name for r in back.collect()) == ["queue.md", "queue.txt"]
    card = V.brief_metrics(C.transcript_units(chat.messages), brief)
    SK.write_scorecard(card, str(tmp_path / "card"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "card" / "markdown")).collect()]
    assert lines[0].startswith("# ") and lines[2].startswith("Mode: **shape + size only**")
    assert lines[4].startswith("| Fixture") and any(" 0/0/0/2/3 " in x for x in lines[6:])


def test_flat_plan_has_no_python_worker(chat):
    facts = P.X.conversation_facts(chat.messages.select("conv_key", "ordinal", "role", "text"), images=False)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "FlatMapGroups" not in plan


def test_scorecard_is_measured_once(spark):
    made = spark.sparkContext.accumulator(0)

    def tell(x):
        made.add(1)
        return x

    told = F.udf(tell, "double").asNondeterministic()
    card = spark.createDataFrame(
        [(n, 100, 10, 0.9, True, n % 2 == 0, "because", 0, 0, 0, 2, 3) for n in range(10)],
        "id long, full_chars long, brief_chars long, reduction double, integrity_complete boolean, same_move boolean, reasoning string, "
        "decided int, open int, rejected int, verbatim int, files int",
    ).withColumn("reduction", told("reduction"))
    lines = SK.scorecard_document(card, "judge").collect()
    assert [r["line"] for r in lines if (r["part"], r["place"]) == (2, 1)] == ["**Same-next-move pass rate: 5/10**"]
    assert sum(r["part"] == 4 for r in lines) == 10
    assert made.value == 10
