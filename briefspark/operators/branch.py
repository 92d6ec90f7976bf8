"""The active branch of a conversation tree.

``walk`` works inside one row (a payload holds its own tree, so no shuffle).
``active_branch`` and ``linear_branch`` work on a table of nodes: usual trees
are folded per conversation, trees above ``FOLD_NODES`` by pointer doubling,
whose joins are keyed by (conversation, node) and so spread a single giant
conversation over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions import text as T
from briefspark.operators.ordered import block_of, checkpoint_folder, dense_ordinal, last_wins, running

FOLD_NODES = 2_000


def walk(ids: Column, parents: Column, leaf: Column) -> Column:
    """Positions (from 0) of the nodes from the root to the leaf.

    The last entry of a repeated id counts, a missing parent ends the walk, a
    repeated node ends it too.  NULL when the leaf is missing or unknown.
    """

    def place(backwards: Column, key: Column) -> Column:  # place of the last such id, -1 if none
        found = F.coalesce(F.array_position(backwards, key), F.lit(0)).cast("int")
        return T.let(found, lambda p: F.when(p > 0, F.size(backwards) - p).otherwise(F.lit(-1)))

    def follow(s: Column) -> Column:
        """s: struct(up, start); after as many steps as there are nodes any cycle has
        closed, so the distinct places in order are the walk up to a repetition."""
        up = s["up"]
        path = F.aggregate(
            up,
            F.array(s["start"]),
            lambda acc, _: T.let(
                F.element_at(acc, -1),
                lambda at: F.when(at < 0, acc).otherwise(F.concat(acc, F.array(F.get(up, at)))),
            ),
        )
        return F.when(
            s["start"] >= 0, F.reverse(F.array_distinct(F.filter(path, lambda p: p >= 0)))
        )

    return T.let(
        F.reverse(ids),
        lambda back: T.let(
            F.struct(F.transform(parents, lambda p: place(back, p)).alias("up"), place(back, leaf).alias("start")),
            follow,
        ),
    )


def active_branch(nodes: DataFrame, leaf: DataFrame, fold_nodes: int = FOLD_NODES) -> DataFrame:
    """nodes(conv_key, pos, node, parent), leaf(conv_key, leaf) -> + branch_ord.

    Without a known leaf every node is kept in its raw order.
    """
    path, known = _path(nodes, leaf, fold_nodes)
    raw = nodes.join(known, "conv_key", "left_anti")
    return nodes.join(path, ["conv_key", "pos"]).unionByName(
        dense_ordinal(raw, ["conv_key"], "pos", "branch_ord")
    )


def linear_branch(nodes: DataFrame, leaf: DataFrame, fold_nodes: int = FOLD_NODES) -> DataFrame:
    """As ``active_branch`` for nodes(.., create_time, has_message): without a known
    leaf the nodes that carry a message are kept, by (create_time, pos)."""
    path, known = _path(nodes, leaf, fold_nodes)
    raw = nodes.filter("has_message").join(known, "conv_key", "left_anti")
    return nodes.join(path, ["conv_key", "pos"]).unionByName(_by_time(raw))


def _path(nodes: DataFrame, leaf: DataFrame, fold_nodes: int) -> tuple[DataFrame, DataFrame]:
    keys = nodes.select("conv_key", "pos", "node", "parent")
    known = (
        keys.join(
            leaf.select("conv_key", F.col("leaf").alias("node")), ["conv_key", "node"], "left_semi"
        )
        .select("conv_key")
        .distinct()
    )
    sizes = keys.groupBy("conv_key").agg(F.count("*").alias("n")).join(known, "conv_key", "left_semi")
    small = sizes.filter(F.col("n") <= fold_nodes).select("conv_key")
    large = sizes.filter(F.col("n") > fold_nodes)
    path = (
        keys.join(small, "conv_key", "left_semi")
        .groupBy("conv_key")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "node", "parent"))).alias("t"))
        .join(leaf, "conv_key")
        .select(
            "conv_key",
            "t",
            F.posexplode(
                walk(
                    F.transform("t", lambda x: x["node"]),
                    F.transform("t", lambda x: x["parent"]),
                    F.col("leaf"),
                )
            ).alias("branch_ord", "at"),
        )
        .select(
            "conv_key",
            F.get("t", F.col("at"))["pos"].alias("pos"),
            F.col("branch_ord").cast("bigint").alias("branch_ord"),
        )
    )
    deepest = large.agg(F.max("n")).first()[0]  # one number: does any tree need doubling
    if deepest:
        path = path.unionByName(_doubling(keys, large, leaf, int(deepest)))
    return path, known


def _by_time(raw: DataFrame) -> DataFrame:
    """Rank by (create_time, pos): rows without a time are cut by position, the
    others by hour, so that no window spans a whole conversation."""
    timed = (
        raw.withColumn("__time", F.coalesce("create_time", F.lit(0.0)))
        .withColumn("__hour", F.floor(F.col("__time") / 3_600).cast("bigint"))
        .withColumn("__block", block_of("pos"))
    )
    inside = running(
        timed, ["conv_key", "__hour"], ["__time", "__block"], ["pos"], sums={"__n": F.lit(1).cast("bigint")}
    )
    hours = timed.groupBy("conv_key", "__hour").agg(F.count("*").alias("__in_hour"))
    earlier = Window.partitionBy("conv_key").orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hours.select(
        "conv_key", "__hour", F.coalesce(F.sum("__in_hour").over(earlier), F.lit(0)).alias("__off")
    )
    return inside.join(offsets, ["conv_key", "__hour"]).select(
        *raw.columns, (F.col("__n") + F.col("__off") - 1).alias("branch_ord")
    )


def _doubling(keys: DataFrame, large: DataFrame, leaf: DataFrame, deepest: int) -> DataFrame:
    tree = last_wins(
        keys.join(large.select("conv_key"), "conv_key", "left_semi"), ["conv_key", "node"], ["pos"]
    )
    jump = tree.select("conv_key", "node", F.col("parent").alias("to"))
    # a parent that is no node ends the walk
    jump = jump.join(
        tree.select("conv_key", F.col("node").alias("to")), ["conv_key", "to"], "left_semi"
    ).select("conv_key", "node", "to")
    reached = tree.join(
        leaf.select("conv_key", F.col("leaf").alias("node")), ["conv_key", "node"], "left_semi"
    ).select("conv_key", "node", F.lit(0).cast("bigint").alias("depth"))
    can_cut = bool(checkpoint_folder(keys.sparkSession))
    for k in range(math.ceil(math.log2(deepest + 1)) + 1):
        ahead = reached.join(jump, ["conv_key", "node"]).select(
            "conv_key", F.col("to").alias("node"), (F.col("depth") + 2**k).alias("depth")
        )
        reached = (
            reached.unionByName(ahead).groupBy("conv_key", "node").agg(F.min("depth").alias("depth"))
        )
        nxt = jump.select("conv_key", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = jump.join(nxt, ["conv_key", "to"]).select("conv_key", "node", F.col("far").alias("to"))
        if can_cut:
            reached, jump = reached.checkpoint(), jump.checkpoint()
    height = reached.groupBy("conv_key").agg(F.max("depth").alias("h"))
    return (
        reached.join(height, "conv_key")
        .join(tree.select("conv_key", "node", "pos"), ["conv_key", "node"])
        .select("conv_key", "pos", (F.col("h") - F.col("depth")).alias("branch_ord"))
    )
