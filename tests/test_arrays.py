from __future__ import annotations

import json
import random

import pytest

from briefspark.sources import payloads as PL
from briefspark.sources.arrays import Cutter, read_arrays


def chats(n: int, seed: int = 1) -> list:
    rng = random.Random(seed)
    odd = ['a "quote" \\', "},{", "]", "[1, {", "\\\\\"", "é漢😀", "\n}\t", "}" * 9, ""]
    talk = lambda: " ".join(rng.choice([*odd, "word", "more"]) for _ in range(rng.randrange(12)))
    return [{"id": k, "messages": [{"role": "user", "content": talk(), "at": [k, [], {}]} for _ in range(rng.randrange(4))]} for k in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def payloads_of(spark, path) -> list[str]:
    return sorted(r["payload"] for r in read_arrays(spark, str(path)).collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_is_read_in_many_tasks(spark, small_splits, tmp_path, indent):
    docs = chats(150)
    (tmp_path / "export.json").write_text(json.dumps(docs, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "other.json").write_text(json.dumps(chats(20, 2), indent=indent))
    found = [json.loads(x) for x in payloads_of(spark, tmp_path)]
    assert sorted(found, key=str) == sorted(docs + chats(20, 2), key=str)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_a_chat_over_many_blocks_stays_whole(spark, small_splits, tmp_path):
    long = {"text": "}" * 200 + ',"[' * 900 + "x" * 3000}
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, long, [1, 2], "text, with } and ]", 5, None]))
    assert payloads_of(spark, tmp_path) == sorted(map(json.dumps, [{"a": 1}, long, [1, 2], "text, with } and ]", 5, None]))


def test_shuffled_fragments_give_the_same(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr("briefspark.sources.arrays.BLOCKS", 0)
    (tmp_path / "a.json").write_text(json.dumps(chats(60)))
    assert sorted(map(json.loads, payloads_of(spark, tmp_path)), key=str) == sorted(chats(60), key=str)


def test_empty_broken_and_cut_off(spark, tmp_path):
    texts = {"empty": "", "none": " [ ] ", "cut": '[{"a": 1}, {"b": 2', "open": '[{"a": 3}, {"b": "never closed}, {"c": 1}]', "outside": 'x [{"a": 4}] y', "bom": '﻿[{"a": 5}]\n', "gap": '[{"a": 6},, {"a": 7}\n,]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    found = payloads_of(spark, tmp_path)
    good = ['{"a": %d}' % n for n in (1, 3, 4, 5, 6, 7)]
    bad = ['{"b": 2', '{"b": "never closed}, {"c": 1}]', "x", "y"]
    assert found == sorted(good + bad)
    t = PL.normalize(PL.read_payloads(spark, str(tmp_path), "array", platform="grok"))
    errors = [r["error"] for r in t.errors.collect()]
    assert len(errors) == len(found) and errors.count("payload is not valid JSON") == 4


def test_cutting_does_not_depend_on_the_pieces():
    text = json.dumps(chats(30, 5))
    for size in (1, 7, 50, 10**6):
        cutter, found = Cutter(False, 0), []
        pieces = [x + "}" for x in text.split("}")]
        for at in range(0, len(pieces), size):
            found += cutter.cut("".join(pieces[at : at + size]))
        assert [json.loads(x) for x in found if x.strip()] == chats(30, 5)
