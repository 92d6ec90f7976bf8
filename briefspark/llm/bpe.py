"""Byte-level BPE by a deterministic automaton, without running merges over a text.

The automaton reads tokens.  Its state after a token is that token, and arc y leaves state x
if y can follow x in the output of the merge procedure.  It starts as one state with a loop
for each byte; merge k = (u, v) -> w adds a gadget:

* state w gets the arcs into u (something that could precede u now precedes w) and the arcs
  out of v (what could follow v now follows w), as they are at that moment;
* the arc v out of state u is cut, as the pair would have merged.

Written out, the automaton of 50,000 merges has some 10^8 arcs, nearly all of them copies.
So each gadget is stored as its own three entries (left, right, rank; cut), and an arc is
resolved by following the gadgets down to where it came from, then remembered.  The result
is deterministic: every byte string has exactly one path, and the token that ends at each
place depends only on the places before it.  A word of n bytes takes at most
n places times the length of the longest token, also where every byte is the same.

A text is first cut at added tokens and then into words, as the tokenizer file prescribes.
Words of common scripts are cut by a pattern; a text with any other character goes through
the splitter of the tokenizers library, whose character classes are of its own Unicode
version.  Paths of recent words are kept in a table of bounded size.

Decoding emits the labels (byte strings) of the arcs.  Byte sequences that are no UTF-8
become U+FFFD.

Defined cases: null text is empty and has no token; any length works; unknown ids raise.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from briefspark.llm.common import map_batches, table

FILE = "byte_bpe_50k.json"
NEVER = sys.maxsize
#: Words whose paths a worker remembers: twice this many at most.
WORDS = 1 << 17
ARCS = 1 << 18

#: White space of the splitter's pattern, and the ranges of characters about
#: whose classes all Unicode versions agree.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
COMMON = [(0x0, 0x52F), (0x2000, 0x2027), (0x202F, 0x205F), (0x20A0, 0x20BF)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the file: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


def _of_class(kinds: str) -> str:
    """The common characters whose category starts with a letter of ``kinds``, as ranges."""
    found = [c for a, b in COMMON for c in range(a, b + 1) if unicodedata.category(chr(c))[0] in kinds]
    runs: list[list[int]] = []
    for c in found:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def _common_words() -> re.Pattern:
    letter, number = _of_class("L"), _of_class("N")
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+"
        f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


class Recent(dict):
    """make(key), remembered for the last ``size`` to 2 * ``size`` different keys."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class MergeAutomaton:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError(f"{path}: byte-level BPE without a prefix space is expected")
        letters = byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in white space are not supported")
        self.labels = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in added}
        self.arc_of = {label: i for i, label in self.labels.items()}
        self.labels |= {i: t.encode() for t, i in added.items()}
        # gadgets: state -> (left, right), state -> rank, cut arc -> rank
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.arc_of.values(), -1)
        self.cut: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            self.add_gadget(k, model["vocab"][u], model["vocab"][v], model["vocab"][u + v])
        # only a token that merges make can stand in their output
        self.arc_of = {x: i for x, i in self.arc_of.items() if i in self.halves or len(x) == 1}
        self.longest = max(map(len, self.arc_of))
        self.labels_tree: dict = {}  # byte -> (node, arc whose label ends here)
        for label, arc in sorted(self.arc_of.items()):  # a prefix comes before what goes on
            node = self.labels_tree
            for byte in label[:-1]:
                if byte not in node:
                    node[byte] = ({}, None)
                node = node[byte][0]
            node[label[-1]] = ({}, arc)
        self.ends = Recent(lambda arc: self.end_of(*arc), ARCS)
        self.words = Recent(lambda word: self.path(word.encode()), WORDS)
        self.added = added
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.common = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in COMMON) + "]")
        self.common_words = _common_words()
        self.splitter = Tokenizer.from_file(path).pre_tokenizer

    def add_gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.halves:
            raise ValueError(f"token {w} is made by two merges")
        self.halves[w], self.rank[w], self.cut[u, v] = (u, v), k, k

    def end_of(self, x: int, y: int) -> int:
        """The merge that cuts arc y out of state x: NEVER if none, -2 if it never is there."""
        rx, ry = self.rank[x], self.rank[y]
        if rx > ry:  # copied from the right half, before the gadget's own cut
            there = self.ends[self.halves[x][1], y] >= rx
        elif ry >= 0:  # copied from the arcs into the left half, after that cut
            there = self.ends[x, self.halves[y][0]] > ry
        else:
            there = True
        return self.cut.get((x, y), NEVER) if there else -2

    def starting(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(end, arc) of the labels that the word has at this place, shorter ones first."""
        found, node = [], self.labels_tree
        for byte in word[at : at + self.longest]:
            hop = node.get(byte)
            if hop is None:
                break
            node, arc = hop
            at += 1
            if arc is not None:
                found.append((at, arc))
        return found

    def path(self, word: bytes) -> tuple[int, ...]:
        """The arcs of the one path that spells ``word``.

        Longer labels are tried first.  At most one path leads to each place, so a place
        from which no arc leads on is closed for good.
        """
        arcs: list[int] = []
        places, waiting, closed = [0], [self.starting(word, 0)], set()
        ends, size = self.ends, len(word)
        while True:
            options, last = waiting[-1], arcs[-1] if arcs else None
            while options:
                end, arc = options.pop()
                if end not in closed and (last is None or ends[last, arc] == NEVER):
                    break
            else:
                closed.add(places.pop())
                waiting.pop()
                arcs.pop()
                continue
            arcs.append(arc)
            if end == size:
                return tuple(arcs)
            places.append(end)
            waiting.append(self.starting(word, end))

    def split(self, text: str) -> list[str]:
        if self.common.search(text) is None:
            return self.common_words.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        if self.cut_added is None or self.cut_added.search(text) is None:
            return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))
        ids: list[int] = []
        for n, part in enumerate(self.cut_added.split(text)):
            if n % 2:
                ids.append(self.added[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.words.__getitem__, self.split(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    """Compiled once in each Python worker."""
    return MergeAutomaton(path)


def encode_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        decimal = Recent(str, 1 << 16)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = machine.encode(text or "")
                sizes.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(
        documents.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
