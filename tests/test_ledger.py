from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from briefspark.operators import model as M


def asker(folder: Path, bad: str = ""):
    """A model that leaves a line for each call, and refuses prompts that hold ``bad``."""

    def ask(prompt: str) -> str:
        with open(folder / "calls", "a") as calls:
            calls.write(prompt + "\n")
        if bad and bad in prompt:
            raise ValueError("refused")
        return prompt.upper()

    return ask


def calls(folder: Path) -> list[str]:
    return sorted((folder / "calls").read_text().split()) if (folder / "calls").exists() else []


def test_no_prompt_is_asked_twice(spark, tmp_path):
    rows = [(k, f"p{k % 50}") for k in range(200)] + [(900, None), (901, "")]
    prompts, ledger = spark.createDataFrame(rows, "id long, prompt string"), str(tmp_path / "ledger")
    got = {r["id"]: (r["output"], r["error"]) for r in M.complete_with_ledger(prompts, asker(tmp_path, "p7"), ledger, batches=3).collect()}
    want = {k: (None, "ValueError: refused") if p == "p7" else (None, "no prompt") if p is None else (p.upper(), None) for k, p in rows}
    assert got == want and calls(tmp_path) == sorted(f"p{k}" for k in range(50))
    again = M.complete_with_ledger(prompts, asker(tmp_path), ledger, batches=5)
    assert {r["id"]: r["output"] for r in again.collect()} == {k: p and p.upper() if p != "" else "" for k, p in rows}
    assert calls(tmp_path) == sorted([*(f"p{k}" for k in range(50)), "p7"])


def test_a_run_that_failed_goes_on(spark, tmp_path, monkeypatch):
    prompts, ledger = spark.range(60).select("id", F.format_string("p%d", "id").alias("prompt")), str(tmp_path / "ledger")
    batches, ask = [], M.complete_batch

    def lost(*given):
        batches.append(1)
        if len(batches) == 3:
            raise RuntimeError("lost")
        return ask(*given)

    monkeypatch.setattr(M, "complete_batch", lost)
    with pytest.raises(RuntimeError, match="lost"):
        M.complete_with_ledger(prompts, asker(tmp_path), ledger, batches=4)
    before = calls(tmp_path)
    monkeypatch.undo()
    assert M.complete_with_ledger(prompts, asker(tmp_path), ledger, batches=4).filter("output IS NULL").count() == 0
    assert 0 < len(before) < 60 and calls(tmp_path) == sorted(f"p{k}" for k in range(60))


def test_nothing_to_ask(spark, tmp_path):
    none = spark.createDataFrame([], "id long, prompt string")
    assert M.complete_with_ledger(none, asker(tmp_path), str(tmp_path / "ledger"), batches=2).count() == 0 and calls(tmp_path) == []
