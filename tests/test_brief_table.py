from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from briefspark.sources.brief_table import BUCKET, BriefTable

ROWS = "store_key string, saved_at string, brief string"


def rows(spark, *found):
    return spark.createDataFrame(found, ROWS)


def held(df) -> dict:
    got = df.collect()
    assert len({r["store_key"] for r in got}) == len(got)
    return {r["store_key"]: (r["saved_at"], r["brief"]) for r in got}


def files(path) -> dict[str, int]:
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_upsert_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    store = BriefTable(spark, str(tmp_path / "s"), buckets=32)
    all_rows = spark.range(2000).select(F.format_string("h/%d", "id").alias("store_key"), F.lit("1").alias("saved_at"), F.lit("old").alias("brief"))
    assert store.upsert(all_rows) == 32
    before, first = files(tmp_path), store._manifest()["folders"]
    new = all_rows.filter("store_key IN ('h/7', 'h/8', 'h/9')").withColumns({"saved_at": F.lit("2"), "brief": F.lit("new")})
    new = new.unionByName(rows(spark, ("h/extra", "1", "added")))
    touched = store._touched(new, 32)
    assert store.upsert(new) == len(touched) <= 4
    made = set(files(tmp_path)) - set(before)
    assert {int(f.split(f"{BUCKET}=")[1].split("/")[0]) for f in made} == touched
    assert {f: t for f, t in files(tmp_path).items() if f in before} == before
    after = store._manifest()["folders"]
    assert {int(b) for b in after if after[b] != first[b]} == touched
    got = held(store.read())
    assert len(got) == 2001 and got["h/extra"] == ("1", "added") and got["h/7"] == ("2", "new") and got["h/10"] == ("1", "old")
    one = store.read(rows(spark, ("h/7", None, None), ("h/none", None, None)))
    assert held(one) == {"h/7": ("2", "new")}
    opened = {int(f.split(f"{BUCKET}=")[1].split("/")[0]) for f in one.inputFiles()}
    assert opened <= store._touched(rows(spark, ("h/7", None, None), ("h/none", None, None)), 32)
    assert store.forget() == 0 and len(held(store.read())) == 2001


def test_the_latest_wins(spark, tmp_path):
    store = BriefTable(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(rows(spark, ("a", "5", "a5"), ("a", "3", "a3"), ("b", "5", "b5"), (None, "1", "n1"), ("c", None, "c?")))
    store.upsert(rows(spark, ("a", "4", "late"), ("b", "5", "same time"), (None, "2", "n2"), ("c", "0", "c0"), ("d", None, None)))
    assert held(store.read()) == {"a": ("5", "a5"), "b": ("5", "same time"), None: ("2", "n2"), "c": ("0", "c0"), "d": (None, None)}
    assert held(store.read(rows(spark, (None, None, None)))) == {None: ("2", "n2")}


def test_a_failed_upsert_leaves_the_store(spark, tmp_path):
    store = BriefTable(spark, str(tmp_path / "s"), buckets=4)
    with pytest.raises(ValueError, match="no store"):
        store.read()
    store.upsert(rows(spark, ("a", "1", "x"), ("b", "1", "y")))
    bad = rows(spark, ("a", "2", "z"), ("b", "2", "w")).withColumn(
        "brief", F.when(F.col("store_key") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("brief"))
    )
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    assert held(store.read()) == {"a": ("1", "x"), "b": ("1", "y")}
    with pytest.raises(RuntimeError, match="changed"):
        store._swap(store._manifest(), 0)
    store.upsert(rows(spark, ("a", "3", "after"), ("b", "3", "after")))
    store.forget()
    assert held(store.read()) == {"a": ("3", "after"), "b": ("3", "after")}


def test_no_rows(spark, tmp_path):
    store = BriefTable(spark, str(tmp_path / "s"), buckets=4)
    assert store.upsert(rows(spark, ("a", "1", "x")).limit(0)) == 0 and store.read().count() == 0
    assert store.upsert(rows(spark, ("a", "1", "x"))) == 1
    assert store.upsert(rows(spark, ("a", "1", "x")).limit(0)) == 0 and held(store.read()) == {"a": ("1", "x")}
