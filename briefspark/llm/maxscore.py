"""MaxScore: exact top-k inner products over an inverted index in shards.

A vector of integers is a document and a dimension is a term with a posting list in every
shard: the components of the shard's vectors, and the largest value of either sign.  The bound
of a term for a query is the most that it can add: weight times largest value of that sign.
Per query block and shard, vectors are taken in steps of ascending id:

1. The terms of each query are put in order of their bounds.  Those at the small end whose
   bounds together stay within SLACK of the threshold (the k-th best score so far) are
   non-essential: a vector to which the essential terms add nothing cannot get among the best.
2. The essential lists are traversed, which gives partial scores.
3. Non-essential terms are looked up for the candidates, largest bound first; a candidate
   leaves as soon as its partial score plus the bounds that are left cannot beat the threshold.
4. The k best of the old and the new scores are kept.

As ids ascend, a later vector that only ties with the threshold cannot win (ties go to the
smaller id).  Without a threshold yet, all terms are essential.  Lists are dense arrays and a
step handles many queries at once: a query whose bounds together stay within its threshold
passes over the step, and a list that is essential to none of the others is not traversed.  Shards are independent; their k best are merged by rank.

Queries and vectors meet in blocks: every shard is read by every block of QUERY_BLOCK
queries, so neither side is broadcast and nothing is sent to the driver but two counts.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do rows of a null id; every row is a candidate, repeats too (they are searched once,
with their number); of rows that share an id, the query takes the smallest vector; vectors of
other lengths than the query's take no part in its search; fewer than k candidates give them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.llm.common import small_batches, table

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Vectors of a shard, and queries, that are scored between two looks at the threshold.
STEP_ROWS = 2048
STEP_QUERIES = 512
#: The part of the threshold that the non-essential terms may add together (at most 1).
SLACK = 0.25


class Shard:
    """The posting lists of one shard in steps of ascending ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.order, self.ids, lists = order, ids[order], np.ascontiguousarray(vectors[order].T)
        self.steps = [
            (start, np.ascontiguousarray(lists[:, start : start + STEP_ROWS]))
            for start in range(0, len(ids), STEP_ROWS)
        ]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(place of the query, score, place of the vector) of the k best of each query."""
        none = np.empty(0, np.int64)
        of, scores, places = none, none, none
        threshold = np.full(len(queries), -np.inf)
        for start, lists in self.steps:
            most, least = np.maximum(lists.max(1), 0), np.minimum(lists.min(1), 0)
            bounds = np.maximum(queries * most, queries * least)
            goes_on = np.flatnonzero(bounds.sum(1) > threshold)  # the others: no vector of the step can win
            if not len(goes_on):
                continue
            bounds, asked, limit = bounds[goes_on], queries[goes_on], threshold[goes_on]
            by_bound = np.argsort(bounds, axis=1, kind="stable")
            summed = np.cumsum(np.take_along_axis(bounds, by_bound, 1), axis=1)
            started = np.isfinite(limit)
            allowed = np.where(started, SLACK * np.where(started, limit, 0), -1)
            spared = (summed <= allowed[:, None]).sum(1)  # non-essential terms
            spare = np.where(spared > 0, np.take_along_axis(summed, np.maximum(spared - 1, 0)[:, None], 1)[:, 0], 0)
            place = np.argsort(by_bound, axis=1)  # of each term in its query's order
            essential = np.where(place >= spared[:, None], asked, 0)
            used = np.flatnonzero(essential.any(0))  # lists that no query needs are not traversed
            partial = essential[:, used] @ lists[used]
            partial[query_ids[goes_on][:, None] == self.ids[None, start : start + lists.shape[1]]] = -np.inf
            rows, at = np.nonzero((partial + spare[:, None] > limit[:, None]) & started[:, None])
            if not started.all():  # without a threshold all terms are essential, so the scores are whole
                new = np.flatnonzero(~started)
                first, where = _first_best(partial[new], k)
                rows, at = np.append(rows, new[first]), np.append(at, where)
            found, left = partial[rows, at], spare[rows]
            for step in range(int(spared.max(initial=0)), 0, -1):
                due = spared[rows] >= step  # queries with that many non-essential terms
                term = by_bound[rows, step - 1]
                found = found + np.where(due, asked[rows, term] * lists[term, at], 0)
                left = left - np.where(due, bounds[rows, term], 0)
                stays = found + left > limit[rows]
                rows, at, found, left = rows[stays], at[stays], found[stays], left[stays]
            stays = found > limit[rows]
            of = np.concatenate([of, goes_on[rows[stays]]])
            scores = np.concatenate([scores, found[stays].astype(np.int64)])
            places = np.concatenate([places, at[stays] + start])
            order = np.lexsort((places, -scores, of))
            of, scores, places = of[order], scores[order], places[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            of, scores, places = of[rank < k], scores[rank < k], places[rank < k]
            last = np.flatnonzero(rank[rank < k] == k - 1)
            threshold[of[last]] = scores[last]
        return of, scores, places


def _first_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row (ties: the first ones); -inf takes no part."""
    rows, size = scores.shape
    if size <= k:
        return np.nonzero(scores > -np.inf)
    border = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    tied = scores == border
    room = k - (scores > border).sum(1, keepdims=True)
    return np.nonzero(((scores > border) | tied & (np.cumsum(tied, 1) <= room)) & (scores > -np.inf))


def integer_vector(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    bad = F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


def max_score(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, terms array<long>) twice -> (query_id, rank, vec_id, score)."""
    small_batches(vectors)
    queries = queries.groupBy("vec_id").agg(F.min("terms").alias("terms"))
    vectors = vectors.groupBy("vec_id", "terms").agg(F.count("*").alias("copies"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "terms", place(blocks).alias("block"), every(shards).alias("shard"))
    spread = F.pmod(F.xxhash64("vec_id", "terms"), F.lit(shards)).cast("int")  # so that an id of many vectors splits
    found = vectors.select("vec_id", "terms", "copies", spread.alias("shard"), every(blocks).alias("block"))

    def search(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({n: np.empty(0, np.int64) for n in ("query_id", "vec_id", "score", "copies")})]
        for length, part in found.groupby(found["terms"].map(len)) if len(asked) and len(found) else ():
            # exact in doubles; sums beyond 2^53 would need vectors of length 2^26
            copies = part["copies"].to_numpy(np.int64)
            shard = Shard(part["vec_id"].to_numpy(np.int64), np.stack(part["terms"].to_numpy()).astype(float))
            wanted = asked[asked["terms"].map(len) == length]
            for start in range(0, len(wanted), STEP_QUERIES):
                some = wanted.iloc[start : start + STEP_QUERIES]
                ids = some["vec_id"].to_numpy(np.int64)
                of, scores, places = shard.best(ids, np.stack(some["terms"].to_numpy()).astype(float), k)
                out.append(pd.DataFrame({"query_id": ids[of], "vec_id": shard.ids[places], "score": scores, "copies": copies[shard.order[places]]}))
        return pd.concat(out)

    best = (
        asked.groupBy("shard", "block")
        .cogroup(found.groupBy("shard", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score long, copies long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    copy = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))
    return best.select("query_id", "vec_id", "score", copy.alias("copy")).withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(vec_id, embedding) -> the k best other vectors of each row that ``is_query`` picks."""
    vectors = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        integer_vector(F.col("embedding"), scale).alias("terms"),
    )
    return max_score(vectors.filter(is_query), vectors, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS t
  FROM embeddings WHERE embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.t, v.t) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
