from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from briefspark.llm import language
from tests.llm.cases import documents, prose

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = language.query(spark, SF).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(found) > 250 and (found.lang_pred == found.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_awkward_rows(spark):
    profiles = language.learned_from(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r["doc_id"], r["text"]): r for r in language.predict(documents(spark), profiles).collect()}
    assert len({k for k in got}) == len(got) and all(0 <= r["score"] <= 1 for r in got.values())
    for key in [(1, None), (2, ""), (3, " \t\n"), (14, "12 34 %%%"), (None, None)]:
        assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
    assert got[(5, "other text of one id")]["lang_pred"] in profiles.languages
    others = ["漢字だけ", "مرحبا بالعالم", "हिन्दी भाषा", "ᄒᆞᆫ글 한국어", "𝒜𝓑 𐍈", "😀 漢字 ё ١٢٣ 中文", "漢"]
    for r in language.predict(documents(spark, list(enumerate(others))), profiles).collect():
        assert r["lang_pred"] in profiles.languages and r["score"] == 0


def test_nothing_to_learn_from(spark):
    empty = documents(spark, [])
    profiles = language.learned_from(empty)
    assert language.predict(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language.predict(documents(spark), profiles).collect()} == {"und"}


def spelt(ngram: int) -> str:
    out = ""
    while ngram:
        code = ngram & ((1 << language.BITS) - 1)
        out = (" " if code == language.BLANK else chr(code - 2)) + out
        ngram >>= language.BITS
    return out


def plain_ngrams(text: str) -> list[str]:
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = [f" {w} " for w in words]
    return [p[a : a + n] for p in padded for n in (1, 2, 3) for a in range(len(p) - n + 1) if p[a : a + n] != " "]


def test_profile_against_plain_counting():
    for seed in range(20):
        text = prose(seed, 200) + "X_y2z " + "".join(chr(0x3041 + (seed * k) % 80) for k in range(90)) + "\U0001f600a"
        counts = Counter(plain_ngrams(text))
        ngrams, times = language.counts_of(text)
        assert {spelt(g): n for g, n in zip(ngrams.tolist(), times.tolist())} == counts
        profile = [spelt(g) for g in language.profile_of(text).tolist()]
        assert [counts[g] for g in profile] == sorted(counts.values(), reverse=True)[:300]


def test_distance_is_out_of_place():
    number = {c: ord(c) + 2 for c in "abcq"}
    p = language.Profiles({"x": [number[c] for c in "abc"], "y": [number[c] for c in "cba"]})
    lang, score = p.nearest(np.array([number[c] for c in "abq"]))
    assert lang == "x" and score == 1 - (0 + 0 + 300) / 900
    assert p.nearest(np.array([number["q"]])) == ("x", 0.0)  # equally far from both
    assert p.nearest(np.array([], np.int64)) == ("und", 0.0)


def test_every_document_counts_in_profiles_and_limits(spark, monkeypatch):
    monkeypatch.setattr(language, "SLICE_CHARS", 500)
    docs = [(n, prose(n, 12), "xy"[n % 2]) for n in range(14_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    train = [r["doc_id"] for r in df.filter(~language.held_out(F.col("doc_id"))).collect()]
    profiles = language.learned_from(df)
    for at, lang in enumerate(profiles.languages):
        counts = Counter()
        for n in train:
            if docs[n][2] == lang:
                counts.update(dict(zip(*(x.tolist() for x in language.counts_of(docs[n][1])))))
        expected = sorted(counts, key=lambda g: (-counts[g], g))[: language.PROFILE]
        own = profiles.places[:, at]
        assert profiles.ngrams[own >= 0][np.argsort(own[own >= 0])].tolist() == expected

    found = []  # the limits, from all rows at once
    for n in set(range(14_000)) - set(train):
        scores = profiles.scores(language.profile_of(docs[n][1]))
        own = profiles.languages.index(docs[n][2])
        if own == scores.argmax():
            found.append((round(float(scores[own]), 3), float(scores[own] - np.delete(scores, own).max())))
    scores, leads = np.array(found).T
    judged = np.array([len(language.profile_of(docs[n][1])) >= language.JUDGED for n in range(14_000)])
    assert judged.all()
    within, least = np.ones(len(scores), bool), -1
    while (bound := scores[within].mean() - language.SPREADS * scores[within].std()) > least + 1e-12:
        least, within = bound, scores >= bound
    got = language.limits(df, profiles)
    assert np.isclose(got.lead, leads[within].mean() / 2) and np.isclose(got.score, least)
