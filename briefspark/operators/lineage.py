"""Collapse drafts of one document to the latest version.

The rule is an ordered greedy: each artifact joins the first kept slot whose
current version shares enough words, and then becomes that slot's version.  It
depends on everything before it in its conversation, so it runs as a stream over
the sorted artifacts of a conversation.  What keeps that stream small:

* only word fingerprints travel, never the contents (they are joined back);
* artifacts under three words can never merge and do not enter the stream;
* of copies that follow each other only the last one enters, since each of them
  would land on the slot of the one before.

``by_groups`` is for conversations with very many drafts.  An artifact only joins a version that
it is alike, so artifacts of different connected groups of the graph of alike pairs never meet:
pairs are found by rare words (as in ``similar_drafts``), groups by least labels and pointer
doubling, and the greedy runs inside a group, on pair rows instead of words.  Groups, not
conversations, are dealt out to tasks; the result is the same.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.operators.ordered import block_of, fold_sorted, hold, previous


def draft_similarity(artifacts: DataFrame) -> DataFrame:
    """Jaccard similarity of each artifact to the one before it in its conversation."""
    sets = artifacts.select("conv_key", "ordinal", T.token_set(F.col("content")).alias("tokens"))
    linked = previous(sets, ["conv_key"], "ordinal").filter(F.col("prev").isNotNull())
    return linked.select(
        "conv_key",
        F.col("prev.ordinal").alias("prev_ordinal"),
        "ordinal",
        T.jaccard(F.col("prev.tokens"), F.col("tokens")).alias("sim"),
    )


def similar_drafts(artifacts: DataFrame, threshold: float = K.LINEAGE_THRESHOLD) -> DataFrame:
    """(conv_key, ordinal_a, ordinal_b, sim): all pairs of a conversation's artifacts, of three
    words or more each, with at least that Jaccard similarity.

    Sets that are so alike share a word among the first n - ceil(threshold * n) + 1 of each,
    in any fixed order of words.  With the rarest words first, few sets meet at a word; the
    pairs that meet are verified.  Artifacts of equal word sets are one set throughout and
    come as pairs with the first of them only.
    """
    sets = artifacts.select("conv_key", "ordinal", T.token_set(F.col("content")).alias("tokens")).filter(
        F.size("tokens") >= K.TOKEN_SET_MIN
    )
    keyed = sets.withColumn("tokens", F.array_sort("tokens")).withColumn("set_key", F.xxhash64("tokens"))
    firsts = keyed.groupBy("conv_key", "set_key").agg(F.min(F.struct("ordinal", "tokens")).alias("f"))
    firsts = firsts.select("conv_key", "set_key", F.col("f.ordinal").alias("ordinal"), F.col("f.tokens").alias("tokens"))
    near = _alike(firsts, threshold)
    same = keyed.select("conv_key", "set_key", F.col("ordinal").alias("ordinal_b")).join(
        firsts.select("conv_key", "set_key", F.col("ordinal").alias("ordinal_a")), ["conv_key", "set_key"]
    )
    equal = same.filter("ordinal_a < ordinal_b").select("conv_key", "ordinal_a", "ordinal_b", F.lit(1.0).alias("sim"))
    return near.unionByName(equal)


def _alike(firsts: DataFrame, threshold: float) -> DataFrame:
    """(conv_key, ordinal, tokens), different sets -> (conv_key, ordinal_a, ordinal_b, sim) of the
    pairs with at least that similarity."""
    words = firsts.select("conv_key", "ordinal", F.size("tokens").alias("n"), F.explode("tokens").alias("word"))
    often = words.groupBy("conv_key", "word").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("conv_key", "ordinal").orderBy("often", "word"))
    heads = (
        words.join(often, ["conv_key", "word"])
        .filter("often > 1")
        .withColumn("place", place)
        .filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
        .select("conv_key", "word", "ordinal", "n")
    )
    one = heads.withColumnsRenamed({"ordinal": "ordinal_a", "n": "n_a"})
    two = heads.withColumnsRenamed({"ordinal": "ordinal_b", "n": "n_b"})
    sizes_allow = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))
    met = (
        one.join(two, ["conv_key", "word"])
        .filter((F.col("ordinal_a") < F.col("ordinal_b")) & sizes_allow)
        .select("conv_key", "ordinal_a", "ordinal_b")
        .distinct()
    )
    of = lambda end: firsts.select("conv_key", F.col("ordinal").alias(f"ordinal_{end}"), F.col("tokens").alias(end))
    return (
        met.join(of("a"), ["conv_key", "ordinal_a"])
        .join(of("b"), ["conv_key", "ordinal_b"])
        .select("conv_key", "ordinal_a", "ordinal_b", T.jaccard(F.col("a"), F.col("b")).alias("sim"))
        .filter(F.col("sim") >= threshold)
    )


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(conv_key, a, b) -> (conv_key, node, root): the least node that each node of a pair reaches.

    A round gives every node the least label of itself and its neighbours, then the label of that
    label, so that the rounds grow with the logarithm of a group's width.
    """
    both = hold(pairs.select("conv_key", "a", "b").union(pairs.select("conv_key", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = hold(both.groupBy("conv_key", F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        of = lambda name: labels.select("conv_key", F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        heard = both.join(of("b"), ["conv_key", "b"]).groupBy("conv_key", F.col("a").alias("node")).agg(F.min("b_root").alias("heard"))
        least = labels.join(heard, ["conv_key", "node"]).select("conv_key", "node", "root", F.least("root", "heard").alias("b"))
        after = least.join(of("b"), ["conv_key", "b"]).select("conv_key", "node", F.col("root").alias("before"), F.col("b_root").alias("root"))
        after = hold(after)
        labels = after.drop("before")
        if after.filter("root <> before").isEmpty():
            return labels


class _Group:
    """The slots of one group, told by pairs of alike sets."""

    def __init__(self) -> None:
        self.alike: dict = defaultdict(set)
        self.holders: dict = defaultdict(set)  # set -> slots whose version has it
        self.kept: list[tuple] = []  # (slot ordinal, ordinal of the current version)
        self.sets: list = []

    def add(self, ordinal, kind, of_set, other) -> None:
        if kind == 0:  # a pair, of which this is the later set
            self.alike[of_set].add(other)
            self.alike[other].add(of_set)
            return
        homes = set(self.holders[of_set]).union(*(self.holders[s] for s in self.alike[of_set]))
        if homes:
            home = min(homes)
            self.holders[self.sets[home]].discard(home)
            self.sets[home], self.kept[home] = of_set, (self.kept[home][0], ordinal)
        else:
            home = len(self.kept)
            self.sets.append(of_set)
            self.kept.append((ordinal, ordinal))
        self.holders[of_set].add(home)

    def rows(self) -> list[tuple]:
        return self.kept


def _kept_by_groups(artifacts: DataFrame, worded: DataFrame, threshold: float) -> DataFrame:
    """(conv_key, ordinal, tokens) -> (conv_key, slot, ordinal) of the kept versions."""
    keyed = worded.withColumn("tokens", F.array_sort("tokens")).withColumn("set_key", F.xxhash64("tokens"))
    keyed = hold(keyed)
    firsts = keyed.groupBy("conv_key", "set_key").agg(F.min(F.struct("ordinal", "tokens")).alias("f"))
    firsts = hold(firsts.select("conv_key", "set_key", F.col("f.ordinal").alias("ordinal"), F.col("f.tokens").alias("tokens")))
    pairs = _alike(firsts, threshold).select("conv_key", F.col("ordinal_a").alias("a"), F.col("ordinal_b").alias("b"))
    pairs = hold(pairs)
    sets = firsts.select("conv_key", "set_key", F.col("ordinal").alias("of_set"))
    versions = keyed.select("conv_key", "set_key", "ordinal").join(sets, ["conv_key", "set_key"])
    none = F.lit(None).cast(dict(artifacts.dtypes)["ordinal"])
    versions = versions.select("conv_key", "ordinal", F.lit(1).alias("kind"), "of_set", none.alias("other"))
    told = pairs.select("conv_key", F.col("b").alias("ordinal"), F.lit(0).alias("kind"), F.col("b").alias("of_set"), F.col("a").alias("other"))
    roots = connected_groups(pairs).withColumnRenamed("node", "of_set")
    rows = versions.unionByName(told).join(roots, ["conv_key", "of_set"], "left")
    rows = rows.withColumn("root", F.coalesce("root", "of_set")).select("conv_key", "root", "ordinal", "kind", "of_set", "other")
    types = dict(artifacts.dtypes)
    schema = f"conv_key {types['conv_key']}, root {types['ordinal']}, slot {types['ordinal']}, ordinal {types['ordinal']}"
    return fold_sorted(rows, ["conv_key", "root"], ["ordinal", "kind"], schema, _Group).drop("root")


class _Slots:
    """The kept versions of one conversation, with the slots that hold each word."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.sets: list[frozenset] = []
        self.kept: list[tuple] = []  # (slot ordinal, ordinal of the current version)
        self.holders: dict[int, set[int]] = defaultdict(set)

    def _home(self, words: frozenset) -> int | None:
        shared = Counter(s for w in words for s in self.holders.get(w, ()))
        alike = [
            s for s, n in shared.items() if n / (len(words) + len(self.sets[s]) - n) >= self.threshold
        ]
        return min(alike, default=None)

    def add(self, ordinal, tokens) -> None:
        words = frozenset(tokens.tolist())
        home = self._home(words)
        if home is None:
            home = len(self.sets)
            self.sets.append(words)
            self.kept.append((ordinal, ordinal))
        else:
            for w in self.sets[home]:
                self.holders[w].discard(home)
            self.sets[home] = words
            self.kept[home] = (self.kept[home][0], ordinal)
        for w in words:
            self.holders[w].add(home)

    def rows(self) -> list[tuple]:
        return self.kept


def collapse_lineage(artifacts: DataFrame, threshold: float = K.LINEAGE_THRESHOLD, by_groups: bool = False) -> DataFrame:
    """artifacts(conv_key, ordinal, content, ..) -> kept rows, + slot.

    ``slot`` gives the order of the result: the ordinal at which the lineage first
    appeared (the last one of a run of copies there).
    """
    tokens = T.token_set(F.col("content"))
    prints = artifacts.select(
        "conv_key",
        "ordinal",
        F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens"),
        F.xxhash64("content").alias("copy_of"),
        F.length("content").alias("size"),
    )
    # of copies that follow each other only the last goes on; runs are cut at block
    # borders, which only keeps a few copies more
    nxt = F.lead(F.struct("copy_of", "size")).over(
        Window.partitionBy("conv_key", block_of("ordinal")).orderBy("ordinal")
    )
    worded = (
        prints.withColumn("__next", nxt)
        .filter((F.size("tokens") >= K.TOKEN_SET_MIN) & ~F.col("__next").eqNullSafe(F.struct("copy_of", "size")))
        .select("conv_key", "ordinal", "tokens")
    )
    if by_groups:
        kept = _kept_by_groups(artifacts, worded, threshold)
    else:
        kept = fold_sorted(worded, ["conv_key"], ["ordinal"], _schema(artifacts), lambda: _Slots(threshold))
    tiny = prints.filter(F.size("tokens") < K.TOKEN_SET_MIN).select(
        "conv_key", "ordinal", F.col("ordinal").alias("slot")
    )
    return artifacts.join(kept.unionByName(tiny), ["conv_key", "ordinal"])


def _schema(artifacts: DataFrame) -> str:
    types = dict(artifacts.dtypes)
    return f"conv_key {types['conv_key']}, slot {types['ordinal']}, ordinal {types['ordinal']}"
