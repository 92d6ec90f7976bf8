import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from briefspark.llm import substrings
from tests.llm.cases import CLASHING, documents, prose
from tests.llm.test_simhash import near_rows


def test_stages_are_those_of_the_order():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "packing"]


def rows():
    shared = prose(77, 70)
    out = near_rows()
    out += [(9000, "98 76 %%%"), (9001, "only front words here " + prose(78, 60)[::-1] + " " + shared), (9002, shared + " and a back"), (9002, shared + " and a back")]
    out += [(9003, " ".join(f"u{n}" for n in range(300)))]
    return out


def stage(spark, name, docs):
    return dict(pipeline.STAGES)[name](spark, docs, "")


def test_language_stage_drops_only_what_has_no_language(spark):
    docs = documents(spark, rows())
    got = stage(spark, "language_id", docs)
    assert got.columns == list(pipeline.COLUMNS)
    gone = docs.select("doc_id", "text").exceptAll(got.select("doc_id", "text")).collect()
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in gone) and any(r["doc_id"] == 9000 for r in gone)


def test_language_stage_rejects_foreign_texts_and_noise_and_rights_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*pipeline.COLUMNS)
    clean = docs.filter("n_chars > 1000 and doc_id % 5 = 0").orderBy("doc_id").limit(60)
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    wrong = clean.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", other.alias("lang"), "source", "n_chars")
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(40)) for _ in range(10)]
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    ]
    planted = [(2_000_000 + n, text, "en" if n % 2 else None) for n, text in enumerate(noise + foreign)]
    planted += [(2_500_000, "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。", None)]
    short = [(3_000_000, "the", None), (3_000_001, "a", "en"), (3_000_002, "漢字 ё", "en")]
    added = spark.createDataFrame([(*r, None, None) for r in planted + short], docs.schema)
    got = {r["doc_id"]: r["lang"] for r in stage(spark, "language_id", docs.union(wrong).union(added)).collect()}
    assert not [n for n, *_ in planted if n in got]
    assert got[3_000_000] in ("de", "en", "es", "fr") and got[3_000_001] == got[3_000_002] == "en"
    before = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sum(got.get(n) == lang for n, lang in before.items()) >= len(before) - 2
    righted = [got.get(r["doc_id"] + 1_000_000) == r["lang"] for r in clean.collect()]
    assert len(righted) == 60 and sum(righted) >= 58


def test_near_stage_keeps_one_of_each_group(spark):
    docs = documents(spark, rows())
    got = stage(spark, "near_dedup", docs)
    assert got.columns == list(pipeline.COLUMNS)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and {9000, 9001, 9002, 9003} <= set(ids)
    assert all(1000 + 50 * n in ids and 1000 + 50 * n + 1 not in ids for n in range(12))


def test_substring_stage_cuts_repeats_and_keeps_rows(spark):
    docs = documents(spark, [r for r in rows() if r[0] and r[0] >= 9000])
    got = {r["doc_id"]: r for r in stage(spark, "substring_dedup", docs).collect()}
    assert got[9002]["text"] == "and a back" and got[9002]["n_chars"] == 10
    assert got[9001]["text"].startswith("only front") and got[9001]["n_chars"] is None


def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    table = documents(spark, rows(), extra=False)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, f) in enumerate(pipeline.STAGES):
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/after-{n}")
        docs = spark.read.parquet(f"{tmp_path}/after-{n}")
    kept = spark.read.parquet(f"{tmp_path}/after-2")
    assert substrings.remove_repeats(kept).agg({"n_removed": "sum"}).first()[0] == 0
    got = pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()), key=str)
    assert key(got) == key(docs)


def test_empty_table_and_clashing_names(spark):
    docs = documents(spark, [])
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, "")
        assert docs.count() == 0
        docs = documents(spark, [])
    assert set(CLASHING) <= set(docs.columns)
