"""Byte-level BPE of a rank file by backtracking over Aho-Corasick matches.

The bytes of a piece are read as Latin-1 characters, so that pyahocorasick finds the longest token
that starts at a place.  It is tried first, then its longest prefix that is a token, and so on.  A
token may follow another one if merges leave the two as they are; this is told from the two alone:

* Look at the border between them and go back in time.  The later made of the two (higher
  rank; the right one of two equal ones, as merges go from left to right) is taken apart into
  its halves, which leaves an older pair at the border, and so on down to two bytes.
* If a pair on the way makes a token of lower rank than the merge that has just been undone, it
  would have merged first, so the two tokens never stand side by side.

The answer is remembered for pairs of recent use.  A sequence in which every two neighbours
may stand side by side is the one that merges produce, so at most one leads to each place: a place
from which no token leads on is closed for good, and a piece of n bytes takes at most n places
times the number of tokens that start at one.

A piece that is a token as a whole is that token, whether or not merges make it; what no
merges make is never a part of a longer piece.

Texts are cut by the pattern of the rank file.  The members of its classes \\p{L}, \\p{N} and \\s
are asked of the installed tiktoken library, since regex engines differ in their Unicode versions.

Decoding joins the bytes of the tokens.

Defined cases: null text is empty and has no token; any length works; repeated rows and null ids
stay; unknown ids raise; other columns are ignored.  A rank table raises if it lacks one of the 256
bytes, or if merges would make a token out of tokens of higher rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from briefspark.llm.bpe import Recent
from briefspark.llm.common import map_batches, table

FILE = "byte_bpe_50k.tiktoken"
NEVER = sys.maxsize
#: Words whose tokens, and pairs whose compatibility, a worker remembers: twice this many at most.
WORDS, PAIRS = 1 << 18, 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


# -- the pattern ----------------------------------------------------------------


@lru_cache(maxsize=8)
def members(kind: str) -> tuple[tuple[int, int], ...]:
    """The code points that tiktoken counts to a class, as ranges."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    bytes_only = {bytes([b]): b for b in range(256)}
    reader = tiktoken.Encoding("class", pat_str=f"{kind}+", mergeable_ranks=bytes_only, special_tokens={})
    runs: list[list[int]] = []
    for code in map(ord, reader.decode(reader.encode_ordinary(every))):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return tuple((a, b) for a, b in runs)


def spelt_out(pattern: str, last: int) -> str:
    """The pattern with its classes as ranges of code points up to ``last``."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = re.compile(r"\\[pP]\{\w+\}|\\[sS]|\\.|[\[\]]").match(pattern, at)
        item = found[0] if found else pattern[at]
        if item in "[]":
            inside = item == "["
        elif item[0] == "\\" and item[1] in "pPsS":
            ranges = "".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in members(item.lower()) if a <= last)
            if inside and item[1] in "PS":
                raise ValueError(f"{item} within a class is not supported")
            item = ranges if inside else f"[{'^' * (item[1] in 'PS')}{ranges}]"
        out.append(item)
        at += len(found[0]) if found else 1
    return "".join(out)


class Splitter:
    """The pieces of a text."""

    def __init__(self, pattern: str):
        self.wide = re.compile("[\U00010000-\U0010ffff]")
        self.of_plane, self.of_all = (re.compile(spelt_out(pattern, last)) for last in (0xFFFF, sys.maxunicode))

    def __call__(self, text: str) -> list[str]:
        """Most texts have no character beyond 16 bits and need fewer ranges."""
        return (self.of_all if self.wide.search(text) else self.of_plane).findall(text)


# -- tokens ---------------------------------------------------------------------


class BytePairs:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.labels = ranks, {rank: token for token, rank in ranks.items()}
        #: when a token is made: its rank, -1 for a byte; tokens that merges never make are not in it
        self.made = {ranks[bytes([b])]: -1 for b in range(256)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, token in sorted(self.labels.items()):
            if len(token) > 1:
                self.add(token, rank)
        for rank, token in self.labels.items():
            if rank not in self.made and any(self.apart(*x) for x in self.cuts(token)):
                raise ValueError(f"token {rank} would be made of tokens of higher rank")
        self.compatible = Recent(lambda pair: self.apart(*pair), PAIRS)
        self.tokens_of = Recent(lambda piece: self.path(piece.encode()), WORDS)
        self.size = {rank: len(self.labels[rank]) for rank in self.made}
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for rank in self.made:
            self.tree.add_word(self.labels[rank].decode("latin-1"), rank)
        self.tree.make_automaton()
        self.shorter = {rank: self.prefix_of(self.labels[rank]) for rank in self.made}

    def add(self, token: bytes, rank: int) -> None:
        """The halves of a token are the two tokens that earlier merges leave of it."""
        for left, right in self.cuts(token):
            if self.apart(left, right):
                self.halves[rank], self.joined[left, right], self.made[rank] = (left, right), rank, rank
                return

    def cuts(self, token: bytes) -> Iterator[tuple[int, int]]:
        """Pairs of tokens made so far that spell a token."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left in self.made and right in self.made:
                yield left, right

    def apart(self, left: int, right: int) -> bool:
        """Whether merges leave the two tokens side by side."""
        made, halves, joined, limit = self.made, self.halves, self.joined, NEVER
        while joined.get((left, right), NEVER) >= limit:
            if made[left] > made[right]:
                left, limit = halves[left][1], made[left]
            elif made[right] >= 0:
                right, limit = halves[right][0], made[right] + 1
            else:
                return True
        return False

    def prefix_of(self, token: bytes) -> int | None:
        """The longest token that is a shorter prefix of this one."""
        return next((x for n in range(len(token) - 1, 0, -1) if (x := self.ranks.get(token[:n])) in self.made), None)

    def path(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        line, end_of_line, size, shorter, compatible = piece.decode("latin-1"), len(piece), self.size, self.shorter, self.compatible
        longest = self.tree.iter_long
        tokens: list[int] = []
        closed: set[int] = set()
        at, last = 0, None
        while at < end_of_line:
            _, token = next(longest(line, at))
            while token is None or at + size[token] in closed or (last is not None and not compatible[last, token]):
                if token is not None:
                    token = shorter[token]
                    continue
                closed.add(at)  # back to the place before, where a shorter token is next
                at -= size[last]
                token = shorter[tokens.pop()]
                last = tokens[-1] if tokens else None
            tokens.append(token)
            at, last = at + size[token], token
        return tuple(tokens)

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.tokens_of.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """Built once in each Python worker."""
    return BytePairs(read_ranks(path))


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids, decoded): token ids and the bytes that they decode to."""
    return _tokens(documents, path, pattern, _plain, "ids array<int>, decoded binary")


def encode_digests(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return _tokens(documents, path, pattern, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(ids: list[list[int]], decoded: list[bytes]) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]


def _digests(ids: list[list[int]], decoded: list[bytes]) -> list[pa.Array]:
    decimal = Recent(str, 1 << 16)
    coded = [hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
    sizes = pa.array([len(x) for x in ids], pa.int64())
    return [sizes, pa.array(coded, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]


def _tokens(documents: DataFrame, path: str | None, pattern: str | None, columns, schema: str) -> DataFrame:
    path, pattern = path or default_path(), pattern or default_pattern()
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, split = byte_pairs(path), splitter(pattern)
        for batch in batches:
            ids = [pairs.encode_pieces(split(text or "")) for text in batch.column(1).to_pylist()]
            found = columns(ids, [pairs.decode(x) for x in ids])
            yield pa.record_batch([batch.column(0), *found], names)

    narrow = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"])
    return map_batches(narrow, run, f"doc_id long, {schema}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
