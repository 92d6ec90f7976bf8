"""Reconcile the model's sections with the extracted facts."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.functions import text as T
from briefspark.operators.extract import (
    FILES,
    NOW_LISTED,
    NOW_RULES,
    VERBATIM,
    dedupe_files_by_stem,
    name_units,
    opening_units,
)
from briefspark.operators.lineage import connected_groups
from briefspark.operators.ordered import assemble, first_wins, fold_sorted, hold

MODEL_FIRST = 1_000  # order offset that puts added facts after the model's items
ROUNDS = 8  # rounds in which tables are settled side by side; what is left then is settled group by group


def reconcile_files(deterministic: DataFrame, model: DataFrame) -> DataFrame:
    """Extracted files first, then the model's; one list by the stem rules."""
    later = model.withColumn("src", F.col("src") + MODEL_FIRST)
    return dedupe_files_by_stem(deterministic.select(*FILES).unionByName(later.select(*FILES)))


def is_meta(c: Column) -> Column:
    """True for remarks about the brief itself rather than about the work."""
    return F.coalesce(c.rlike(K.edged(K.SELF_REFERENCE)), F.lit(False))


def drop_meta(items: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        items = items.filter(~is_meta(F.col(name)))
    return items


def guarantee_images(model: DataFrame, deterministic: DataFrame) -> DataFrame:
    """The model's verbatim items plus every extracted image they lack."""
    key = F.lower(T.js_trim(F.col("value")))
    have = model.filter(F.col("kind") == "image").select("conv_key", key.alias("key")).distinct()
    images = deterministic.filter(F.col("kind") == "image").withColumn("key", key)
    missing = first_wins(
        images.join(have, ["conv_key", "key"], "left_anti"), ["conv_key", "key"], ["src", "ordinal", "pos"]
    )
    return model.select(*VERBATIM).unionByName(
        missing.withColumn("src", F.col("src") + MODEL_FIRST).select(*VERBATIM)
    )


def table_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller of two token sets; 0 when one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.when(small == 0, F.lit(1)).otherwise(small)
    )


class _Covered:
    """Token sets of the tables a conversation has, and which extracted ones it lacked."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.known: list[frozenset] = []
        self.holders: dict[int, list[int]] = defaultdict(list)
        self.added: list[tuple] = []

    def add(self, turn, src, ordinal, pos, tokens) -> None:
        words = frozenset(tokens.tolist())
        if turn == 1:
            shared = Counter(k for w in words for k in self.holders.get(w, ()))
            if any(n / min(len(words), len(self.known[k])) >= self.threshold for k, n in shared.items()):
                return
            self.added.append((src, ordinal, pos))
        for w in words:
            self.holders[w].append(len(self.known))
        self.known.append(words)

    def rows(self) -> list[tuple]:
        return self.added


def overlapping_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """sets(conv_key, node, tokens) -> (conv_key, early, late): the pairs of nodes of a conversation
    with at least that overlap, early < late.  ``tokens`` are distinct and no two sets are equal.

    A pair shares ceil(threshold * n) tokens at least, n the size of the smaller set, so any
    n - ceil(threshold * n) + 1 tokens of the smaller one hold a shared one: its rarest tokens look
    for the sets, no smaller than it, that have them.
    """
    size = F.size("tokens")
    words = sets.select("conv_key", "node", size.alias("n"), F.explode("tokens").alias("word"))
    often = words.groupBy("conv_key", "word").agg(F.count("*").alias("often"))
    counted = words.join(often, ["conv_key", "word"])
    place = F.row_number().over(Window.partitionBy("conv_key", "node").orderBy("often", "word"))
    # a little less, since the product of two doubles may come out above the whole number
    rarest = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    heads = counted.withColumn("place", place).filter((F.col("place") <= rarest) & (F.col("often") > 1))
    smaller = heads.select("conv_key", "word", F.col("node").alias("a"), F.col("n").alias("n_a"))
    larger = counted.filter("often > 1").select("conv_key", "word", F.col("node").alias("b"), F.col("n").alias("n_b"))
    met = (
        smaller.join(larger, ["conv_key", "word"])
        .filter("n_a < n_b OR (n_a = n_b AND a < b)")
        .select("conv_key", F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))
        .distinct()
    )
    of = lambda end: sets.select("conv_key", F.col("node").alias(end), F.col("tokens").alias(f"{end}_tokens"))
    both = met.join(of("early"), ["conv_key", "early"]).join(of("late"), ["conv_key", "late"])
    alike = table_overlap(F.col("early_tokens"), F.col("late_tokens")) >= threshold
    return both.filter(alike).select("conv_key", "early", "late")


class _Rest:
    """Settles the nodes of one group, whose pairs come in order of their later node."""

    def __init__(self) -> None:
        self.covered: dict[str, None] = {}

    def add(self, late, early) -> None:
        if early not in self.covered:
            self.covered[late] = None

    def rows(self) -> list[tuple]:
        return [(node,) for node in self.covered]


def covered_nodes(pairs: DataFrame, conv_type: str, rounds: int = ROUNDS) -> DataFrame:
    """(conv_key, early, late) -> (conv_key, node) of the nodes that the ordered greedy leaves out:
    those with a pair to an earlier node that it does not leave out.

    In each round, nodes that are later in no pair stay for good, and their later partners go, with
    all their pairs.  A chain of pairs gives up one link a round; after ``rounds`` the rest is settled
    by a stream of pairs for each connected group.
    """
    out: list[DataFrame] = []
    left = hold(pairs)
    for _ in range(rounds):
        if left.isEmpty():
            break
        waiting = left.select("conv_key", F.col("late").alias("early")).distinct()
        gone = left.join(waiting, ["conv_key", "early"], "left_anti").select("conv_key", F.col("late").alias("node")).distinct()
        gone = hold(gone)
        out.append(gone)
        for end in ("early", "late"):
            left = left.join(gone.withColumnRenamed("node", end), ["conv_key", end], "left_anti")
        left = hold(left)
    else:
        if not left.isEmpty():
            roots = connected_groups(left.withColumnsRenamed({"early": "a", "late": "b"})).withColumnRenamed("node", "late")
            grouped = left.join(roots, ["conv_key", "late"]).select("conv_key", "root", "late", "early")
            schema = f"conv_key {conv_type}, root string, node string"
            out.append(fold_sorted(grouped, ["conv_key", "root"], ["late", "early"], schema, _Rest).drop("root"))
    covered = left.select("conv_key", F.col("late").alias("node")).limit(0)
    for more in out:
        covered = covered.unionByName(more)
    return covered


def _added_in_rounds(prints: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """(conv_key, turn, src, ordinal, pos, tokens) -> (conv_key, src, ordinal, pos) of the tables to add.

    Of equal sets only the first counts, since whatever covers or keeps it covers the others.  A
    table without tokens overlaps with nothing.
    """
    # one sortable name: the model's tables come first
    node = F.concat(*[F.lpad(F.col(c).cast("string"), 19, "0") for c in ("turn", "src", "ordinal", "pos")])
    place = F.struct(node.alias("node"), "turn", "src", "ordinal", "pos")
    named = prints.select("conv_key", place.alias("place"), F.array_sort("tokens").alias("tokens"))
    firsts = named.filter(F.size("tokens") > 0).groupBy("conv_key", "tokens").agg(F.min("place").alias("place"))
    firsts = hold(firsts.select("conv_key", "tokens", "place.*"))
    pairs = overlapping_sets(firsts.select("conv_key", "node", "tokens"), threshold)
    pairs = pairs.filter(~F.col("late").startswith("0" * 19))  # the model's own tables all stay
    gone = covered_nodes(pairs, dict(prints.dtypes)["conv_key"], rounds)
    place_of = ("conv_key", "src", "ordinal", "pos")
    stay = firsts.filter("turn = 1").join(gone, ["conv_key", "node"], "left_anti").select(*place_of)
    return stay.unionByName(prints.filter((F.col("turn") == 1) & (F.size("tokens") == 0)).select(*place_of))


def guarantee_tables(
    model: DataFrame,
    deterministic: DataFrame,
    threshold: float = K.TABLE_OVERLAP,
    in_rounds: bool = False,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The model's verbatim items plus the extracted tables they do not cover.

    A table is covered when it shares enough tokens with a table of the model or
    one added before it.  The adds depend on each other, so token fingerprints
    (not the tables) run through an ordered stream per conversation.

    ``in_rounds`` is for conversations with very many tables: pairs that overlap enough are found by
    rare tokens, and the tables added are the first independent set of these pairs in table order, which
    rounds of joins find without bringing a conversation together.  The result is the same.
    """
    key = dict(deterministic.dtypes)["conv_key"]

    def prints(df: DataFrame, turn: int) -> DataFrame:
        return df.filter(F.col("kind") == "table").select(
            "conv_key",
            F.lit(turn).alias("turn"),
            "src",
            "ordinal",
            "pos",
            F.transform(T.overlap_tokens(F.col("value")), lambda t: F.xxhash64(t)).alias("tokens"),
        )

    both = prints(model, 0).unionByName(prints(deterministic, 1))
    if in_rounds:
        added = _added_in_rounds(both, threshold, rounds)
    else:
        schema = f"conv_key {key}, src int, ordinal bigint, pos int"
        added = fold_sorted(both, ["conv_key"], ["turn", "src", "ordinal", "pos"], schema, lambda: _Covered(threshold))
    tables = deterministic.filter(F.col("kind") == "table").join(added, ["conv_key", "src", "ordinal", "pos"])
    return model.select(*VERBATIM).unionByName(
        tables.withColumn("src", F.col("src") + MODEL_FIRST).select(*VERBATIM)
    )


def count_units(now: DataFrame, files: DataFrame) -> DataFrame:
    """The state line of now(conv_key, now) as ordered text units.

    All produced files are listed after it when there are at least two and one of
    them is not named in it.
    """
    produced = files.filter(F.col("source") == "chat").select("conv_key", "src", "ordinal", "pos", "name")
    verdict = (
        produced.join(now, "conv_key")
        .groupBy("conv_key")
        .agg(
            F.count("*").alias("n"),
            F.bool_and(F.contains(F.lower("now"), F.lower("name"))).alias("all_named"),
        )
    )
    short = verdict.filter((F.col("n") >= 2) & ~F.col("all_named")).select("conv_key", "n")
    listing = F.concat(
        F.lit("Files produced in this chat ("), F.col("n").cast("string"), F.lit("): ")
    )
    openings = now.join(short, "conv_key", "left").select(
        "conv_key",
        F.when(F.col("n").isNull(), F.col("now"))
        .otherwise(F.concat_ws(" ", F.nullif(T.js_trim(F.col("now")), F.lit("")), listing))
        .alias("text"),
    )
    listed = files.join(short.select("conv_key"), "conv_key", "left_semi")
    return opening_units(openings).unionByName(name_units(listed, NOW_LISTED))


def guarantee_count(now: DataFrame, files: DataFrame) -> DataFrame:
    """(conv_key, part, now): the state line that names every produced file."""
    return assemble(count_units(now, files), NOW_RULES).select("conv_key", "part", F.col("text").alias("now"))
