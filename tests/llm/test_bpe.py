import hashlib

from tokenizers import Tokenizer

from briefspark.llm import bpe
from tests.llm.cases import documents, edge_texts


def test_ids_and_round_trip(spark):
    exact = Tokenizer.from_file(bpe.default_path())
    got = sorted(map(tuple, bpe.encode_decode(documents(spark)).collect()), key=str)
    want = []
    for i, t in edge_texts():
        ids = exact.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_every_common_character_and_pairs_of_odd_ones():
    exact, machine = Tokenizer.from_file(bpe.default_path()), bpe.automaton(bpe.default_path())
    texts = ["".join(f"x{chr(c)} 1{chr(c)}{chr(c)}" for c in range(a, a + 32)) for a in range(0, 0x3400, 32)]
    texts += ["'s 'LL ''ve  \n\n a\n", " ", "​​", "aaa" * 999, "ab" * 500 + "<|endoftext|>" * 2]
    for text in texts:
        ids = exact.encode(text, add_special_tokens=False).ids
        assert machine.encode(text) == ids and machine.decode(ids) == text


def test_arcs_are_the_pairs_that_merges_leave():
    exact, machine = Tokenizer.from_file(bpe.default_path()), bpe.automaton(bpe.default_path())
    words = [w for w in machine.labels.values() if w.isalpha() and w.isascii() and len(w) < 5][:60]
    for a in words:
        for b in words:
            left = [machine.arc_of[a], machine.arc_of[b]]
            stays = exact.encode((a + b).decode(), add_special_tokens=False).ids == left
            assert stays == (machine.ends[left[0], left[1]] == bpe.NEVER)


def test_bytes_that_are_no_utf8_are_replaced():
    machine = bpe.automaton(bpe.default_path())
    lone = machine.arc_of[b"\xc3"]
    assert machine.decode([lone]) == Tokenizer.from_file(bpe.default_path()).decode([lone], skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode_decode(documents(spark, [])).count() == 0
