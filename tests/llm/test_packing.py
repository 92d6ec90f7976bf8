import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from briefspark.llm import packing
from briefspark.llm.bpe import default_path
from tests.llm.cases import documents, edge_texts


def expected(rows):
    exact = Tokenizer.from_file(default_path())
    return [(i, exact.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


@pytest.mark.parametrize("max_open", [2, 4096])
def test_every_id_lies_in_one_piece(spark, max_open):
    rows = edge_texts()
    got = packing.pack(documents(spark, rows).repartition(2), max_open=max_open, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, ids in expected(rows):
        want[i, len(ids)].append(ids)
    assert {k: sorted(sum((ids for _, ids in v), [])) for k, v in pieces.items()} == {k: sorted(sum(v, [])) for k, v in want.items()}
    for key, whole in want.items():
        if len(whole) == 1:
            assert sum((ids for _, ids in sorted(pieces[key], key=lambda p: p[0])), []) == whole[0]
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0


def test_level_has_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.Packer(window=32, max_open=10**6)
    for size in rng.integers(1, 32, 400):
        def total(counts):
            return sum(int(c) ** 2 for c in counts[1:32])

        choices = {}
        for level in range(0, 33 - size):
            if level == 0 or packer.counts[level]:
                after = packer.counts.copy()
                after[level] -= level > 0
                after[level + size] += 1
                choices[level] = total(after)
        level = packer.level_for(int(size))
        assert choices[level] == min(choices.values())
        packer.add(1, np.arange(size, dtype="<u4"))
    assert sum(packer.counts[1:]) == packer.open


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_fast_ids_are_those_of_tokenizers():
    made = packing.encoder(default_path(), packing.default_ranks())
    for _, ids in zip(edge_texts(), expected(edge_texts())):
        assert made.ids(_[1] or "").tolist() == ids[1]
