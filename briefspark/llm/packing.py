"""Sum-of-squares online packing of tokenized documents into windows.

``counts[h]`` is the number of open windows that hold h tokens.  A piece of s tokens goes
into a window of that level h (0: a new one) for which the sum of counts[h]^2 over the
partially filled levels becomes smallest; of equal levels, the fullest.  Keeping the levels
evenly used keeps a match for most later pieces.  Documents longer than a window give whole
windows first; what is left of them is placed like a short document.

Each task packs the documents of its partition as they come, so there is no shuffle and a
lost task is simply run again.  Windows still open at the end are topped up with pieces of
the emptiest ones, cut where needed; the last one is cut into sequences whose lengths are
powers of two, which need no padding.  The same is done before more than ``max_open``
windows are open, so memory does not depend on the partition.

Tokens: those of the tokenizers library without special tokens, then id 0.  They are made by
tiktoken from the same vocabulary; texts with characters about whose classes the two
libraries could differ, or with an added token's string, go through tokenizers itself.

Defined cases: null text is empty and gives one piece, the end token; a null doc_id stays
null; rows of one doc_id are packed as documents of their own; columns other than doc_id and
text are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from briefspark.llm.bpe import COMMON, default_path
from briefspark.llm.common import map_batches, table

WINDOW = 1024
END_ID = 0
MAX_OPEN = 4096
RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


class Encoder:
    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        added = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        common = "[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in COMMON) + "]"
        self.odd = re.compile("|".join([common, *added]))

    def ids(self, text: str) -> np.ndarray:
        """The document's ids with the end token."""
        if self.odd.search(text):
            found = self.exact.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_to_numpy(text, disallowed_special=())
        out = np.empty(len(found) + 1, "<u4")
        out[:-1], out[-1] = found, END_ID
        return out


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str) -> Encoder:
    return Encoder(path, ranks_path)


class Piece:
    """A span of a document's ids."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens),
            Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens),
        )


def fill_of(pieces: list[Piece]) -> int:
    return sum(len(p.ids) for p in pieces)


def split_at(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces of the first ``at`` tokens, and the others."""
    first: list[Piece] = []
    rest = list(pieces)
    while at:
        piece = rest.pop(0)
        if len(piece.ids) > at:
            piece, later = piece.cut(at)
            rest.insert(0, later)
        first.append(piece)
        at -= len(piece.ids)
    return first, rest


class Packer:
    """Windows of one task; finished sequences go to ``done``."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.done: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """The level at which a piece raises the sum of squares least."""
        fits = self.window - size
        counts = self.counts
        change = 2 * counts[size:] + 1  # the level that the window reaches
        change[fits] = 0  # a full window no longer counts
        leaves = counts[: fits + 1]
        change -= np.where(leaves > 0, 2 * leaves - 1, -(1 << 40))
        change[0] = 2 * counts[size] + 1 if fits else 0
        return fits - int(np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.done.append([Piece(doc_id, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.place(Piece(doc_id, whole, ids[whole:], len(ids)))

    def place(self, piece: Piece) -> None:
        size = len(piece.ids)
        level = self.level_for(size)
        if level:
            window = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.window:
            self.done.append(window)
            return
        self.levels[level + size].append(window)
        self.counts[level + size] += 1
        self.open += 1
        if self.open > self.max_open:
            self.top_up()

    def top_up(self) -> None:
        """Fill the fullest windows from the emptiest; at most one stays open."""
        windows = [w for level in self.levels for w in level]  # emptiest first
        self.levels = [[] for _ in self.levels]
        self.counts[:] = 0
        self.open = first = 0
        last = len(windows) - 1
        while first < last:
            missing = self.window - fill_of(windows[last])
            given = min(missing, fill_of(windows[first]))
            moved, windows[first] = split_at(windows[first], given)
            windows[last].extend(moved)
            if given == missing:
                self.done.append(windows[last])
                last -= 1
            if not windows[first]:
                first += 1
        for window in windows[first : last + 1]:
            if level := fill_of(window):
                full = level == self.window
                (self.done if full else self.levels[level]).append(window)
                self.counts[level] += not full
                self.open += not full

    def close(self) -> None:
        self.top_up()
        for level, windows in enumerate(self.levels):
            for window in windows:
                rest = window
                for power in (1 << b for b in reversed(range(self.window.bit_length()))):
                    if power & level:
                        sequence, rest = split_at(rest, power)
                        self.done.append(sequence)
        self.levels = [[] for _ in self.levels]
        self.counts[:] = 0
        self.open = 0


def pack(
    documents: DataFrame,
    path: str | None = None,
    ranks_path: str | None = None,
    window: int = WINDOW,
    max_open: int = MAX_OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, text) -> one row per piece; ``with_ids`` adds the token ids themselves."""
    path, ranks_path = path or default_path(), ranks_path or default_ranks()

    def rows_of(packer: Packer, first_sequence: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        for n, pieces in enumerate(packer.done):
            offset = 0
            for p in pieces:
                row = (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, first_sequence + n, offset, p.ids)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += len(p.ids)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if with_ids:
            arrays.append(pa.array([i.astype(np.int32) for i in columns[7]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = encoder(path, ranks_path), Packer(window, max_open)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, tokens.ids(text or ""))
                if len(packer.done) >= 1024:
                    yield rows_of(packer, sequence)
                    sequence += len(packer.done)
                    packer.done.clear()
        packer.close()
        yield rows_of(packer, sequence)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    narrow = documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text")
    return map_batches(narrow, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
