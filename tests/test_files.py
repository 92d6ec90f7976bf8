from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from briefspark.sources import files as W

TITLES = ["Plan 2", "Plan", None, "plan!", "PLAN", "", "Ünïcode ★", "x" * 90, "x" * 70, "Plan", "a/b\\..c"]


def briefs(spark):
    rows = [(k, part, f"{k}/{part} é\n") for k in range(len(TITLES)) for part in range(1 + (k % 3) * 6)]
    rows += [(99, 0, "has no title row"), (3, 1, None)]
    meta = [(k, t, "more") for k, t in enumerate(TITLES)]
    return (
        spark.createDataFrame(rows, "conv_key long, part int, human_md string"),
        spark.createDataFrame(meta, "conv_key long, title string, extra string"),
    )


def want() -> dict[str, str]:
    names = ["plan-2", "plan", "handoff-brief", "plan_2", "plan_3", "handoff-brief_2", "n-code", "x" * 60, "x" * 60 + "_2", "plan_4", "a-b-c"]
    return {n: "".join(f"{k}/{part} é\n" for part in range(1 + (k % 3) * 6)) for k, n in enumerate(names)}


def stored(path: Path, ext: str) -> dict[str, str]:
    return {f.stem: f.read_text(encoding="utf-8") for f in path.glob(f"*/*.{ext}")}


def test_files_hold_the_briefs(spark, tmp_path):
    path = tmp_path / "out"
    W.write_brief_files(*briefs(spark), str(path))
    assert stored(path, "md") == stored(path, "txt") == want()
    assert [f.name for f in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="exists"):
        W.write_brief_files(*briefs(spark), str(path))
    one, meta = briefs(spark)
    W.write_brief_files(one.filter("conv_key = 1"), meta, str(path), overwrite=True, extensions=("md",))
    assert stored(path, "md") == {"plan": want()["plan"]} and not stored(path, "txt")
    assert [f.name for f in tmp_path.iterdir()] == ["out"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    one, meta = briefs(spark)
    bad = one.withColumn("human_md", F.when(F.col("conv_key") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("human_md")))
    path = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        W.write_brief_files(bad, meta, str(path))
    assert list(tmp_path.iterdir()) == []
    W.write_brief_files(one, meta, str(path))
    with pytest.raises(Exception, match="lost"):
        W.write_brief_files(bad, meta, str(path), overwrite=True)
    assert stored(path, "md") == want() and [f.name for f in tmp_path.iterdir()] == ["out"]


def test_a_repeated_attempt_leaves_nothing(spark, tmp_path):
    """Two attempts of one task write; only that whose message is committed is kept."""
    path = tmp_path / "out"
    spark.dataSource.register(W.BriefFiles)
    writer = W.BriefFilesWriter({"path": str(path)}, False)
    (Path(writer.staging) / "00000-lost").mkdir(parents=True)
    (Path(writer.staging) / "00000-lost" / "half.md").write_text("ha")
    (Path(writer.staging) / "00000-good").mkdir()
    (Path(writer.staging) / "00000-good" / "whole.md").write_text("whole")
    writer.commit([W.Written("00000-good", 1), W.Written("00001-none", 0)])
    assert stored(path, "md") == {"whole": "whole"} and [f.name for f in tmp_path.iterdir()] == ["out"]


def test_no_briefs(spark, tmp_path):
    one, meta = briefs(spark)
    W.write_brief_files(one.limit(0), meta.limit(0), str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_names_of_one_hot_title(spark):
    """Ranks go on over partitions: a slug of most rows lies in several."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    meta = spark.range(20_000).select(F.col("id").alias("conv_key"), F.when(F.col("id") % 3 < 2, "Same").otherwise(F.col("id").cast("string")).alias("title"))
    names = {r["conv_key"]: r["name"] for r in W.file_names(meta).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot = [k for k in range(20_000) if k % 3 < 2]
    assert [names[k] for k in hot] == ["same"] + [f"same_{n}" for n in range(2, len(hot) + 1)]
    assert all(names[k] == str(k) for k in range(2, 20_000, 3)) and len(names) == 20_000
