"""Replay of chats whose commands tie paths together, without one task for a whole chat.

Moves of the working folder and moves of files are maps that compose, so both are scanned
in blocks of ``BLOCK`` ordinals.

1. The ``cd`` commands of a block are one move; the moves of a chat, one after the other,
   give the folder in which each block starts, and so the absolute path of every operation.
2. A block maps every path it touches to where its file comes from: a list of sources of
   which the first that exists counts, each a path at the start of the block or a creation
   inside it.  ``cp a b`` puts the sources of a before those of b, ``rm`` leaves none.  Maps
   are put in one after the other; what a block finds at its start are creations.
3. With that, each operation knows the creation of the file it works on.  Files of one
   creation are replayed together, different creations apart from each other.

What one task sees of a whole chat are narrow rows without texts (a path and its sources
for each path and block), read as a stream against the list of live files.  A single file
that is edited all the time, with its copies, stays one fold: whether an edit applies
depends on the text before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.operators.ordered import BLOCK_BITS, fold_sorted
from briefspark.operators.sandbox import Files, call_of, joined, operations, stamp_of

#: Ordinal of what is known at the start of a block: it sorts before every event.
START = -(1 << 63)
OPERATION = "conv_key {key}, block bigint, ord bigint, n bigint, kind string, path string, target string, input string"


def _operations(events: DataFrame, block_bits: int, texts: bool) -> DataFrame:
    """events -> one row per operation; only those that write keep their input, if at all."""
    ddl = OPERATION.format(key=dict(events.dtypes)["conv_key"])
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, at, name, text in zip(pdf["conv_key"], pdf["ord"], pdf["name"], pdf["input"]):
                for n, (kind, path, target) in enumerate(operations(name, call_of(text))):
                    held = text if texts and kind in ("put", "edit", "insert") else None
                    out.append((conv, int(at) >> block_bits, int(at), n, kind, path, target, held))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return events.select("conv_key", "ord", "name", "input").mapInPandas(run, ddl)


def _scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, make: Callable[[], Any]) -> DataFrame:
    """As ``fold_sorted``, but ``add`` returns rows that go out at once."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    names = [part.split()[0] for part in schema.split(", ")]
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c] for c in columns)):
                if key != row[:width]:
                    key, state = row[:width], make()
                out.extend((key[0], *r) for r in state.add(*row[width:]))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _start_row(rows: DataFrame, kind: str, path: str, target: str) -> DataFrame:
    """What is known at the start of a block, as the first operations of it."""
    fixed = {"ord": F.lit(START), "n": F.lit(-1).cast("bigint"), "kind": F.lit(kind), "input": F.lit(None).cast("string")}
    known = rows.withColumns(fixed)
    return known.select("conv_key", "block", "ord", "n", "kind", F.expr(path).alias("path"), F.expr(target).alias("target"), "input")


# -- 1: the working folder ----------------------------------------------------------------


class _Moves:
    """The ``cd`` commands of a block as one move."""

    def __init__(self) -> None:
        self.move = "."

    def add(self, at, n, path) -> None:
        self.move = joined(self.move, path)

    def rows(self) -> list[tuple]:
        return [(self.move,)]


class _Folders:
    """The folder in which each block of a chat starts."""

    def __init__(self) -> None:
        self.cwd = K.HOME_DIR

    def add(self, block, move) -> list[tuple]:
        here, self.cwd = self.cwd, joined(self.cwd, move)
        return [(int(block), here)]


def block_folders(events: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_key, block, cwd) for every block that has an event."""
    key = dict(events.dtypes)["conv_key"]
    likely = F.contains("input", F.lit("cd")) | F.contains("input", F.lit("\\u"))  # letters can be escaped
    changes = _operations(events.filter(likely), block_bits, texts=False).filter("kind = 'cd'")
    moves = fold_sorted(
        changes.select("conv_key", "block", "ord", "n", "path"),
        ["conv_key", "block"],
        ["ord", "n"],
        f"conv_key {key}, block bigint, move string",
        _Moves,
    )
    still = events.select("conv_key", F.shiftright("ord", block_bits).alias("block"), F.lit(None).cast("string").alias("move"))
    move = F.coalesce(F.max("move"), F.lit(".")).alias("move")  # a block has one move at most
    blocks = still.unionByName(moves).groupBy("conv_key", "block").agg(move)
    return _scan(blocks, ["conv_key"], ["block"], f"conv_key {key}, block bigint, cwd string", _Folders)


# -- 2: where files come from -----------------------------------------------------------------


def _first_of(first: list, then: list) -> list:
    """Sources in order; after a creation, which always exists, none counts."""
    out: list = []
    for source in [*first, *then]:
        if source not in out:
            out.append(source)
        if isinstance(source, int):
            break
    return out


class _Sources:
    """The map of a block: path -> sources, paths at its start (str) or creations (int)."""

    def __init__(self) -> None:
        self.cwd, self.sources = K.HOME_DIR, {}

    def of(self, path: str) -> list:
        return self.sources.setdefault(path, [path])

    def add(self, at, n, kind, path, target) -> None:
        if kind in ("cwd", "cd"):
            self.cwd = joined(self.cwd, path)
            return
        path, made = joined(self.cwd, path), stamp_of(int(at), int(n))
        before = self.of(path)
        if kind == "put":
            self.sources[path] = [made]
        elif kind == "insert":
            self.sources[path] = _first_of(before, [made])
        elif kind == "rm":
            self.sources[path] = []
        elif kind in ("cp", "mv"):
            target = joined(self.cwd, target)
            self.sources[target] = _first_of(before, self.of(target))
            if kind == "mv":
                self.sources[path] = []

    def rows(self) -> list[tuple]:
        return [(path, json.dumps(sources)) for path, sources in self.sources.items()]


class _Creations:
    """The creation of every file that a block touches and finds at its start."""

    def __init__(self) -> None:
        self.live: dict[str, int] = {}
        self.block, self.after = None, {}

    def add(self, block, path, sources) -> list[tuple]:
        if block != self.block:
            for name, made in self.after.items():
                if made is None:
                    self.live.pop(name, None)
                else:
                    self.live[name] = made
            self.block, self.after = block, {}
        found = (s if isinstance(s, int) else self.live.get(s) for s in json.loads(sources))
        self.after[path] = next((made for made in found if made is not None), None)
        return [(int(block), path, str(self.live[path]))] if path in self.live else []


def block_files(operations: DataFrame, folders: DataFrame) -> DataFrame:
    """(conv_key, block, path, made): the files that a block touches and finds at its start."""
    key = dict(operations.dtypes)["conv_key"]
    steps = operations.filter("kind <> 'show'").unionByName(_start_row(folders, "cwd", "cwd", "''"))
    maps = fold_sorted(
        steps.select("conv_key", "block", "ord", "n", "kind", "path", "target"),
        ["conv_key", "block"],
        ["ord", "n"],
        f"conv_key {key}, block bigint, path string, sources string",
        _Sources,
    )
    return _scan(maps, ["conv_key"], ["block", "path"], f"conv_key {key}, block bigint, path string, made string", _Creations)


# -- 3: the operations on the files of one creation ----------------------------------------


class _Resolved:
    """Operations of a block -> (made, stamp, kind, path, target, input) with absolute paths.

    An operation on a file that is not there has no row; one that puts a file in the place
    of one of another creation takes that one away.
    """

    def __init__(self) -> None:
        self.cwd, self.live = K.HOME_DIR, {}

    def add(self, at, n, kind, path, target, text) -> list[tuple]:
        if kind in ("cwd", "cd"):
            self.cwd = joined(self.cwd, path)
        elif kind == "at":
            self.live[path] = int(target)
        elif kind == "show":
            return [(0, stamp_of(int(at), int(n)), kind, path, "", False, None)]
        else:
            target = joined(self.cwd, target) if kind in ("cp", "mv") else ""
            return self.step(stamp_of(int(at), int(n)), kind, joined(self.cwd, path), target, text)
        return []

    def step(self, stamp: int, kind: str, path: str, target: str, text: str | None) -> list[tuple]:
        if path not in self.live and kind not in ("put", "insert"):
            return []
        written = target or path
        made = self.live.get(path) if kind != "put" else None
        made = stamp if made is None else made
        before = self.live.get(written)
        out = [(made, stamp, kind, path, target, before is None, text)]
        if before not in (None, made):
            out.append((before, stamp, "rm", written, "", False, None))
        if kind != "rm":
            self.live[written] = made
        if kind in ("rm", "mv"):
            del self.live[path]
        return out


class _FilesFold:
    """The files of one creation, live ones with their text, and when each path came to be."""

    def __init__(self) -> None:
        self.files, self.born = Files(), {}

    def add(self, stamp, kind, path, target, born, text) -> None:
        if born and kind != "show":
            self.born[target or path] = int(stamp)
        self.files.do(int(stamp), kind, path, target, call_of(text))

    def rows(self) -> list[tuple]:
        text, written = self.files.text, self.files.written
        shown = [(p, None, None, None, i) for i, p in enumerate(self.files.manifest)]
        return shown + [(p, text.get(p), self.born.get(p), written.get(p), None) for p in {**self.born, **text}]


def resolved(events: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """events -> (conv_key, made, stamp, kind, path, target, born, input): what happens to the
    files of each creation.  ``made`` is 0 for lists of files to present."""
    key = dict(events.dtypes)["conv_key"]
    folders = block_folders(events, block_bits)
    found = block_files(_operations(events, block_bits, texts=False), folders)
    steps = (
        _operations(events, block_bits, texts=True)
        .unionByName(_start_row(folders, "cwd", "cwd", "''"))
        .unionByName(_start_row(found, "at", "path", "made"))
    )
    return _scan(
        steps,
        ["conv_key", "block"],
        ["ord", "n"],
        f"conv_key {key}, made bigint, stamp bigint, kind string, path string, target string, born boolean, input string",
        _Resolved,
    )


def replay_tied(events: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The same rows as one fold over each chat.

    events(conv_key, ord, name, input) -> (conv_key, path, content, place, write_ord, manifest_ord)
    """
    key = dict(events.dtypes)["conv_key"]
    parts = fold_sorted(
        resolved(events, block_bits),
        ["conv_key", "made"],
        ["stamp"],
        f"conv_key {key}, made bigint, path string, content string, place bigint, write_ord bigint, manifest_ord bigint",
        _FilesFold,
    )
    # a path that files of several creations held came to be when the last of them that found none did
    live = F.max(F.when(F.col("write_ord").isNotNull(), F.struct("write_ord", "content")))
    whole = parts.groupBy("conv_key", "path", "manifest_ord").agg(F.max("place").alias("place"), live.alias("live"))
    return whole.filter("live IS NOT NULL OR manifest_ord IS NOT NULL").select(
        "conv_key", "path", F.col("live.content").alias("content"), "place", F.col("live.write_ord").alias("write_ord"), "manifest_ord"
    )
