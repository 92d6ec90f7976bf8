"""Files that hold one JSON array of chats, read in many tasks.

An export is often one array in one line, which a reader of lines or whole files takes as one row.
Here Spark's text source reads it with ``}`` as line separator, so a file is split by byte ranges like
any other text and comes as fragments in order; a block is the part of a file that one split has.
Whether a ``,`` separates chats depends on all that stands before it in the file, in two ways: it may
be inside a string, and it may be inside a chat.  Both are settled by a prefix sum over blocks:

1. Each block tells the parity of its quotes and the brackets that it opens and closes, once
   for its parts between even quotes and once for those between odd ones.  So nothing has to be known
   of what came before.  (A block ends after ``}``, so no escape goes over a border.)
2. Sums over the blocks before, per file, give for each block whether it starts inside a string, and
   at which depth.
3. Each block is read again with that knowledge and cut at the commas of the outermost array.  Chats
   within one block are rows at once.  The pieces at block borders, two for each block, are
   numbered by a second prefix sum and put together by (file, number).

Between the steps there is a row for each block, which is some 10^-8 of the data.  These rows go to all
tasks if they are few (BLOCKS, checked); beyond that, fragments are shuffled to meet theirs.

Defined cases: white space around chats goes; an empty array and an empty file give no row; an
element that is no object is a row as it stands, as is text outside the array and an element that
the end of the file cuts off (without a ``}`` at its very end): its normalizer makes an error row of
it.  A quote or bracket that is never closed makes the rest of its file one such row.  A compressed
file is one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefspark.operators.ordered import checkpoint_folder

SEPARATOR = "}"
#: Blocks whose rows may go to all tasks: 64 MB of them.
BLOCKS = 1 << 20

ESCAPED = re.compile(r"\\.", re.DOTALL)
#: Outside strings: what changes the depth or separates elements.
MARKS = re.compile(r"[\[\]{},]")
#: An escaped character or a quote.
QUOTES = re.compile(r'\\.|"', re.DOTALL)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("fragment")
    )


def _opened(part: str) -> int:
    return part.count("{") + part.count("[") - part.count("}") - part.count("]")


def _blocks(batches: Iterator[pa.RecordBatch], of: int = 2) -> Iterator[tuple[tuple, list[str]]]:
    """(the first ``of`` columns, fragments) of rows that follow each other in a block; a block
    may come in several such pieces."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys, begin = list(zip(*columns[:of])), 0
        for n in range(1, len(keys) + 1):
            if n == len(keys) or keys[n][:2] != keys[begin][:2]:
                yield keys[begin], columns[-1][begin:n]
                begin = n


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, fragment) -> (file, start, quotes, even, odd) of each block: the parity of
    its quotes, and the depth gained between even and between odd ones."""
    found: dict[tuple, list[int]] = {}
    for key, fragments in _blocks(batches):
        sums = found.setdefault(key, [0, 0, 0])
        parts = ESCAPED.sub("", SEPARATOR.join(fragments) + SEPARATOR).split('"')
        for n, part in enumerate(parts):
            sums[1 + (sums[0] + n) % 2] += _opened(part)
        sums[0] = (sums[0] + len(parts) - 1) % 2
    rows = [(*key, *sums) for key, sums in found.items()]
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.string(), *[pa.int64()] * 4))]
    yield pa.record_batch(columns, ["file", "start", "quotes", "even", "odd"])


class Cutter:
    """Cuts a text that comes in pieces at the commas of its outermost array."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.open: list[str] = []  # pieces of the element that is not finished

    def cut(self, text: str) -> list[str]:
        """The elements that end in this piece."""
        done, begin, at = [], 0, 0
        while at < len(text):
            if self.inside:
                for found in QUOTES.finditer(text, at):
                    if found[0] == '"':
                        self.inside, at = False, found.end()
                        break
                else:
                    break
            quote = text.find('"', at)
            end = quote if quote >= 0 else len(text)
            for found in MARKS.finditer(text, at, end):
                mark, place = found[0], found.start()
                if mark == "," and self.depth == 1 or mark == "[" and self.depth == 0 or mark == "]" and self.depth == 1:
                    done.append("".join([*self.open, text[begin:place]]))
                    self.open, begin = [], place + 1
                self.depth += (mark in "[{") - (mark in "]}")
            self.inside, at = quote >= 0, end + 1
        self.open.append(text[begin:])
        return done


def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, inside, depth, fragment) -> (file, start, number, whole, piece).

    number: how many elements of the block ended before; the first and the last piece of a block
    are not whole.
    """
    names, kinds = ["file", "start", "number", "whole", "piece"], (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    batch_of = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names)
    key, cutter, number = None, None, 0
    for (file, start, inside, depth), fragments in _blocks(batches, 4):
        rows = []
        if (file, start) != key:
            if cutter:
                rows.append((*key, number, False, "".join(cutter.open)))
            key, cutter, number = (file, start), Cutter(inside, depth), 0
        for element in cutter.cut(SEPARATOR.join(fragments) + SEPARATOR):
            rows.append((*key, number, number > 0, element))
            number += 1
        yield batch_of(rows)
    if cutter:
        yield batch_of([(*key, number, False, "".join(cutter.open))])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(payload, url): the elements of the JSON arrays in the files at ``path``."""
    fragments = _fragments(spark, path)
    blocks = fragments.mapInArrow(measure, "file string, start long, quotes long, even long, odd long")
    in_file = Window.partitionBy("file").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside")
    entered = blocks.select("*", inside).withColumn("gained", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    entered = entered.select("file", "start", "inside", F.coalesce(F.sum("gained").over(before), F.lit(0)).alias("depth"))
    entered = entered.checkpoint() if checkpoint_folder(spark) else entered.persist()
    if entered.count() <= BLOCKS:
        known = fragments.join(F.broadcast(entered), ["file", "start"])  # keeps the order of fragments
    else:
        placed = fragments.withColumn("place", F.monotonically_increasing_id()).join(entered, ["file", "start"])
        known = placed.repartition("file", "start").sortWithinPartitions("file", "start", "place")
    pieces = known.select("file", "start", "inside", "depth", "fragment").mapInArrow(
        cut_blocks, "file string, start long, number long, whole boolean, piece string"
    )
    whole = pieces.filter("whole").select("file", F.col("piece").alias("payload"))
    border = pieces.filter("not whole")
    # a block's last piece has as number how many elements ended in it
    ended = border.groupBy("file", "start").agg(F.max("number").alias("ended"))
    earlier = ended.select("file", "start", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("earlier"))
    numbered = border.join(earlier, ["file", "start"]).withColumn("element", F.col("earlier") + F.col("number"))
    joined = numbered.groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("start", "number", "piece"))).alias("parts"))
    # the separator at the end of a file was added to it, or ends nothing of an array
    last = F.col("element") == F.max("element").over(Window.partitionBy("file"))
    text = F.concat_ws("", "parts.piece")
    joined = joined.select("file", F.when(last, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("payload"))
    rows = whole.union(joined).select(F.regexp_replace("payload", r"^[\s\x{FEFF}]+|\s+$", "").alias("payload"), F.col("file").alias("url"))
    return rows.filter(F.col("payload") != "")
