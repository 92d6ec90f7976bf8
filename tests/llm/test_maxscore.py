import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefspark.llm import maxscore as m
from tests.llm.cases import CLASHING


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({name: F.lit(1) for name in [*CLASHING, "terms", "query_id", "rank"]})


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(90)]
    rows += [(i, rows[0][1]) for i in range(200, 245)]  # ties
    bad = [(300, None), (320, []), (None, [0.1] * 6), (340, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (360, [math.nan] + [0.0] * 5), (380, [math.inf] + [0.0] * 5)]
    zero = [(400, [0.0] * 6)]
    repeated = rows[20:22]
    got = m.top_k(table(spark, rows + bad + zero + repeated), F.col("vec_id") % 20 == 0, k=7).collect()
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows + zero + repeated]
    want = set()
    for q, vector in {i: v for i, v in good if i % 20 == 0}.items():
        best = sorted(((-int(vector @ v), i) for i, v in good if i != q))[:7]
        want |= {(q, n + 1, i, -score) for n, (score, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slack", [0.0, 0.25, 1.0])
@pytest.mark.parametrize("copies", [0, 900])
def test_shard_against_all_scores(monkeypatch, slack, copies):
    monkeypatch.setattr(m, "SLACK", slack)
    monkeypatch.setattr(m, "STEP_ROWS", 128)
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * rng.normal(0, 0.2, (1500, 16)))
    vectors[rng.choice(1500, copies, replace=False)] = vectors[0]
    ids = rng.permutation(9000)[:1500].astype(np.int64)
    asked = np.arange(0, 1500, 15)
    of, scores, places = (shard := m.Shard(ids, vectors)).best(ids[asked], vectors[asked], 20)
    every = vectors[asked] @ vectors.T
    for n, q in enumerate(asked):
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -every[n, others]))][:20]
        assert shard.ids[places[of == n]].tolist() == ids[best].tolist() and scores[of == n].tolist() == every[n, best].tolist()


def test_few_and_none(spark):
    assert m.top_k(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert m.top_k(table(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert [tuple(r) for r in m.top_k(table(spark, [(0, [1.0]), (1, [-2.0])]), F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, -8192)]


def test_one_id_with_thousands_of_vectors_next_to_other_queries(spark):
    rng = np.random.default_rng(5)
    vectors = np.floor(64 * rng.normal(0, 0.2, (4200, 16)))
    ids = np.append(np.zeros(2048, np.int64), np.arange(1, 2153))
    asked = np.append(0, np.arange(2048, 4200, 34))
    of, scores, places = (shard := m.Shard(ids, vectors)).best(ids[asked], vectors[asked], 20)
    every = vectors[asked] @ vectors.T
    for n, q in enumerate(asked):
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -every[n, others]))][:20]
        assert scores[of == n].tolist() == every[n, best].tolist()
    rows = [(int(i) * 20, [float(x) / 64 for x in v]) for i, v in zip(ids, vectors)]
    table_of = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = m.top_k(table_of, F.col("vec_id") % 400 == 0, k=5).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {r["query_id"] for r in got} == {n * 400 for n in range(108)} and {r["n"] for r in got} == {5}
