import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from briefspark.llm import divergence
from tests.llm.cases import CLASHING, edge_texts, prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, top=200):
    """All rows of the audit for (text, lang, source), without any short cut."""
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    found, of_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found[lang, source].update(terms_of(text))
        of_docs[lang].update(set(terms_of(text)))
    out = []
    for lang, source in found:
        kept = [t for t, n in of_docs[lang].items() if n >= least]
        group = lambda s: {t: found[lang, s][t] for t in kept}
        whole = Counter()
        for other in (s for x, s in found if x == lang):
            whole.update(group(other))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        own, p, q = group(source), share(group(source)), share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = {s: sum(f(p[t], x[t]) for t in kept) for l2, s in found if l2 == lang and s != source for x in [share(group(s))]}
        terms = {t: f(p[t], q[t]) for t in kept if own[t] and p[t] > q[t]}
        for part, values, limit in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, n + 1) for n, (item, value) in enumerate(order)]
    return sorted(out)


def audited(spark, rows, extra=True, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in [*CLASHING, "term", "n", "p", "item", "value", "part", "rank"]})
    return sorted(map(tuple, divergence.divergences(df, **options).collect()))


def awkward():
    rng = random.Random(13)
    rows = [(t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "", "Ä"])) for _, t in edge_texts() * 3]
    rows += [(prose(n % 30, n % 50) + " " + "z" * (n % 9) * 40, rng.choice(["en", "fr"]), f"s{n % 7}") for n in range(200)]
    rows += [("x" * 20_000 + str(n) + "y" * 20_000, "en", "s1") for n in range(3)]
    rows += [(None, "xx", "alone"), ("seldom words", "yy", "one"), ("", "yy", "two"), ("one's own", "zz", "u"), ("one's own", "zz", "u"), ("one's own", "zz", "v")]
    return rows


def test_against_brute_force(spark):
    got = audited(spark, awkward())
    assert got == brute(awkward())
    assert [r for r in got if r[0] == "yy"] == [("yy", "one", "pair", "two", 0, 1), ("yy", "two", "pair", "one", 0, 1)]
    assert not [r for r in got if r[0] == "xx"]


def test_small_slices_and_blocks(spark, monkeypatch):
    for name in ("SLICE_BYTES", "ROWS", "PAIRS"):
        monkeypatch.setattr(divergence, name, 5)
    rows = awkward()[:150]
    assert audited(spark, rows, top=3, least_docs=2) == brute(rows, 2, 3)


@pytest.mark.parametrize("small", [1, 3, 4096])
def test_pointer_sort(small, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", small)
    rng = random.Random(small)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["é", "ab" * 50, "ab" * 50 + "c"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(30)]
    texts.append("\x00".join(words))
    raw = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, stops, docs = divergence.term_pointers(divergence.LOWER[np.frombuffer(raw, np.uint8)], offsets)
    spelt = [raw[a:b].decode() for a, b in zip(starts, stops)]
    assert spelt == [w for t in texts for w in terms_of(t)]
    assert docs.tolist() == [n for n, t in enumerate(texts) for _ in terms_of(t)]
    order, new = divergence.Pointers(np.frombuffer(raw, np.uint8), starts, stops).sort()
    assert order.tolist() == sorted(range(len(spelt)), key=lambda n: (spelt[n].encode(), n))
    runs = [spelt[n] for n in order]
    assert new.tolist() == [n == 0 or runs[n] != runs[n - 1] for n in range(len(runs))]


def test_runs_of_a_slice_of_an_array():
    texts = pa.array([b"no", b"A b a", b"", b"b a", b"a\xc3\xa9"], pa.large_binary()).slice(1)
    terms, term, group, n, docs = divergence.counted_runs(texts, np.array([1, 0, 0, 1]))
    got = {(terms[t], g): (k, d) for t, g, k, d in zip(term.tolist(), group.tolist(), n.tolist(), docs.tolist())}
    assert got == {(b"a", 1): (2, 1), (b"a", 0): (1, 1), (b"b", 1): (1, 1), (b"b", 0): (1, 1), (b"a\xc3\xa9", 1): (1, 1)}


def test_terms_without_letters_and_empty_table(spark):
    assert audited(spark, [("1 2 3", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, [], extra=False) == []


def test_counts_are_dealt_out_once(spark):
    df = spark.createDataFrame([("a b", "en", "s")], "text string, lang string, source string")
    counts = divergence.term_counts(df)
    of_term = divergence.Window.partitionBy("lang", "term")
    plan = counts.withColumn("all", F.sum("n").over(of_term))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
