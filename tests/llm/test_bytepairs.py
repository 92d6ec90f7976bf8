import hashlib
import random

import pytest
import tiktoken

from briefspark.llm import bytepairs
from tests.llm.cases import documents, edge_texts, prose


@pytest.fixture(scope="module")
def ranks():
    return bytepairs.read_ranks(bytepairs.default_path())


@pytest.fixture(scope="module")
def exact(ranks):
    return tiktoken.Encoding("own", pat_str=bytepairs.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    pairs = bytepairs.byte_pairs(bytepairs.default_path())
    return pairs.encode_pieces(bytepairs.splitter(bytepairs.default_pattern())(text))


def test_rows_against_the_library(spark, exact):
    got = sorted(map(tuple, bytepairs.encode_digests(documents(spark)).collect()), key=str)
    want = []
    for i, t in edge_texts():
        ids = exact.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(exact.decode_bytes(ids)).hexdigest()))
    assert got == sorted(want, key=str)
    plain = {(r["doc_id"], r["decoded"].decode()): r["ids"] for r in bytepairs.encode(documents(spark)).collect()}
    assert plain == {(i, t or ""): exact.encode_ordinary(t or "") for i, t in edge_texts()}


def test_code_points_of_all_planes(exact):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3500 or c % 17 == 0)]
    for a in range(0, len(codes), 8192):
        text = "".join(f"x{chr(c)}1{chr(c)}!{chr(c)} " for c in codes[a : a + 8192])
        assert ids_of(text) == exact.encode_ordinary(text)


def test_odd_and_long_pieces(exact):
    rng = random.Random(11)
    texts = ["'s 'LL ''ve  \n\n a\n", "aaa" * 9999, "ab" * 5000, " " * 5000 + "x", "\n" * 3000, "<|endoftext|>", "漢字" * 4000]
    texts += ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    texts += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x3000), rng.randrange(0x1F000, 0x20000)])) for _ in range(400)) for _ in range(60)]
    texts += [prose(n, 300) for n in range(20)]
    for text in texts:
        assert ids_of(text) == exact.encode_ordinary(text)


def test_random_rank_tables_with_tokens_that_merges_never_make():
    rng, tried, unmade = random.Random(3), 0, 0
    while tried < 60:
        order = [bytes([b]) for b in range(256)]
        parts = [b"a", b"b", b"c"]
        for _ in range(rng.randrange(3, 40)):
            token = rng.choice(parts) + rng.choice(parts)
            if token not in order and len(token) < 9:
                order.append(token)
                parts.append(token)
        ranks = {token: n for n, token in enumerate(order)}
        try:
            pairs = bytepairs.BytePairs(ranks)
        except ValueError:  # made of tokens of higher rank
            continue
        tried, unmade = tried + 1, unmade + len(ranks) - len(pairs.made)
        exact = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            piece = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 130)))
            assert list(pairs.path(piece.encode())) == exact.encode_ordinary(piece)
    assert unmade > 20


def test_bytes_that_are_no_utf8():
    pairs = bytepairs.byte_pairs(bytepairs.default_path())
    rng = random.Random(5)
    for _ in range(200):
        piece = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 60)))
        assert pairs.decode(pairs.path(piece)) == piece


def test_errors_and_empty_table(spark, ranks):
    with pytest.raises(ValueError):
        bytepairs.BytePairs({b"a": 0})
    with pytest.raises(KeyError):
        bytepairs.byte_pairs(bytepairs.default_path()).decode([50256])
    assert bytepairs.encode_digests(documents(spark, [])).count() == 0
