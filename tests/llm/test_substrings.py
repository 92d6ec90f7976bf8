import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from briefspark.llm import substrings as s
from tests.llm.cases import CLASHING, documents, edge_texts


def slow(rows, window):
    docs, first = [(i, (t or "").encode().split()) for i, t in rows], {}
    place = lambda i, n: (i is not None, i or 0, n)
    for i, words in docs:
        for n in range(len(words) - window + 1):
            span = tuple(words[n : n + window])
            first[span] = min(first.get(span, place(i, n)), place(i, n))
    out = []
    for i, words in docs:
        gone = set()
        for n in range(len(words) - window + 1):
            if first[tuple(words[n : n + window])] < place(i, n):
                gone.update(range(n, n + window))
        kept = [w for n, w in enumerate(words) if n not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    base = [rng.choice("abcd") for _ in range(400)]
    out = []
    for n in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(380)
            words += base[at : at + rng.randrange(3, 45)] + [rng.choice("xyz")] * rng.randrange(30)
        out.append((rng.choice([n, n, n, 7, None]), " ".join(words)))
    return out + out[:5] + [(501, "z " * 3000)]


@pytest.mark.parametrize("window, block, chunk", [(20, 10, 1 << 21), (20, 10, 300), (7, 4, 50)])
def test_against_all_windows(spark, window, block, chunk):
    got = s.remove_repeats(documents(spark, rows()).repartition(3), window, block, chunk)
    assert sorted((tuple(r)[:4] for r in got.drop("kept", "row").collect()), key=str) == slow(rows(), window)


def test_awkward_rows(spark):
    got = s.remove_repeats(documents(spark))
    assert sorted((tuple(r)[:4] for r in got.drop("kept", "row").collect()), key=str) == slow(edge_texts(), 20)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[9]["kept"] == "front" and by_id[8]["kept"] == dict(edge_texts())[8]
    assert all(by_id[8]["row"][name] == "clash" for name in CLASHING)


def test_block_has_to_fit(spark):
    with pytest.raises(ValueError):
        s.remove_repeats(documents(spark), window=10, block=8)


def test_empty_table(spark):
    assert s.remove_repeats(documents(spark, [])).count() == 0


def test_chunks_hold_hashes_instead_of_words():
    texts = ["a b  c a", None, " d"]
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(texts)], ["uid", "text"])
    (rows,) = s.chunks(iter([batch]), 100)
    assert [uid for uid, _ in rows] == [1, 2, 3]
    for (_, held), text in zip(rows, texts):
        assert held.dtype == np.uint64 and held.tolist() == [xxhash.xxh64_intdigest(w) for w in s.words_of(text)]
