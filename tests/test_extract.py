from __future__ import annotations

import re

from pyspark.sql import functions as F

from briefspark.functions import constants as K
from briefspark.operators import chunk as C
from briefspark.operators import extract as X
from briefspark.operators import lineage as D
from briefspark.operators.ordered import Rule, assemble, text_blocks

MESSAGES = "conv_key string, ordinal bigint, role string, text string, images array<string>"


def messages(spark, *texts, conv="a"):
    return spark.createDataFrame([(conv, i, "human", t, None) for i, t in enumerate(texts)], MESSAGES)


def values(df, column="value"):
    return [r[column] for r in df.orderBy("src", "ordinal", "pos").collect()]


def test_tables_need_a_body_and_skip_bad_separators(spark):
    m = messages(
        spark,
        "t\n| a | b |\n|---|:-:|\n| 1 | 2 |\nend",
        "| only | head |\n|---|---|\n\nx",
        "a|b\n|---| no\n|---|---|\n|1|2|",
    )
    assert values(X.tables_verbatim(m)) == ["| a | b |\n|---|:-:|\n| 1 | 2 |", "|---| no\n|---|---|\n|1|2|"]


def test_long_table_does_not_overflow_the_stack(spark):
    body = "\n".join(f"| {i} | x |" for i in range(30_000))
    m = messages(spark, "| a | b |\n|---|---|\n" + body)
    assert X.tables_verbatim(m).selectExpr("length(value)").first()[0] == len("| a | b |\n|---|---|\n" + body)


def reference_formulas(texts):
    blank = "[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m.group(1).zfill(4), K.BLANK) + "]"
    pattern = K.FORMULA.replace("[" + K.BLANK + "]", blank)
    joined = "\n".join(texts)
    found = [re.sub(blank, "", m.group(0)) for m in re.finditer(pattern, joined, re.ASCII)]
    return set(dict.fromkeys(found))


def test_formulas_across_message_borders(spark):
    cases = [
        ["total B12=B5", "+B6 ok", "x"],
        ["=A1+B1", "", "+C1", "*D4 end"],
        ["xB1=B2+B3", "C1", "=C2/C3"],
        ["a =", "B2/C3 and -", "D4"],
        ["B1=B2+B3 then", "B4=B5+B6"],
        ["sum A1", "-B2", "C3"],
    ]
    for texts in cases:
        got = {r.value for r in X.formulas(messages(spark, *texts)).collect()}
        assert got == reference_formulas(texts), texts


def test_endpoint_across_message_border(spark):
    m = messages(spark, "use GET /a-GET", "/not", "then DELETE ", " /b/c now")
    assert values(X.endpoints(m)) == ["GET /a-GET", "DELETE /b/c"]


def test_ascii_word_boundary(spark):
    assert values(X.referenced_files(messages(spark, "see éx.py and src/main.rs2")), "name") == ["x.py"]


def test_links_sandbox_paths_and_produced_stems_are_no_references(spark):
    m = messages(spark, "www.host.org/a.html host.org/foods/x.html /tmp/a.py essay.md ./lib/util.ts util.js")
    art = spark.createDataFrame([("a", "outputs/Essay.txt")], "conv_key string, filename string")
    assert values(X.referenced_files(m, art), "name") == ["lib/util.ts"]


def test_files_by_stem_is_idempotent(spark):
    rows = [
        ("a", 0, 0, 0, "report.docx", "w", "chat"),
        ("a", 0, 1, 0, "Report.docx", "w", "chat"),
        ("a", 0, 2, 0, "report.pdf", "w", "chat"),
        ("a", 3, 0, 0, "docs/report.md", "w", "referenced"),
        ("a", 3, 1, 0, "x/plan.md", "w", "referenced"),
        ("a", 3, 2, 0, "plan.txt", "w", "referenced"),
        ("a", 0, 3, 0, "sandbox:/mnt/data/q.csv", "w", "chat"),
    ]
    df = spark.createDataFrame(rows, "conv_key string, src int, ordinal bigint, pos int, name string, why string, source string")
    once = X.dedupe_files_by_stem(df)
    assert values(once, "name") == ["report.docx", "report.pdf", "q.csv", "x/plan.md"]
    assert values(X.dedupe_files_by_stem(once), "name") == values(once, "name")


def test_facts_do_not_depend_on_partitioning(spark):
    m = messages(spark, *[f"B{i}=C{i}+D{i} https://x.io/{i % 7} f_{i % 5}.py" for i in range(60)])
    runs = {
        tuple(sorted(map(tuple, X.conversation_facts(m.repartition(n), images=False).collect()), key=repr))
        for n in (1, 3, 16)
    }
    assert len(runs) == 1 and len(next(iter(runs))) == 60 + 7 + 5


def fold_lineage(texts, threshold=0.5):
    kept = []
    for i, t in enumerate(texts):
        words = set(re.findall("[a-z0-9]+", t.lower()))
        for slot in kept:
            other = slot[2]
            if len(words) >= 3 and len(other) >= 3 and len(words & other) / len(words | other) >= threshold:
                slot[1], slot[2] = i, words
                break
        else:
            kept.append([i, i, words])
    return [k[1] for k in kept]


def test_lineage_equals_the_greedy_rule(spark):
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(80):
        if texts and rng.random() < 0.5:
            texts.append(rng.choice([texts[-1], texts[-1] + f" w{rng.randrange(9)}", rng.choice(texts) + " v"]))
        else:
            texts.append(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 8))))
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "conv_key string, ordinal bigint, content string")
    got = [r.ordinal for r in D.collapse_lineage(df.repartition(5)).orderBy("slot").collect()]
    assert got == fold_lineage(texts)


def test_chunks_equal_the_greedy_rule_over_many_blocks(spark):
    import random

    rng = random.Random(5)
    texts = ["x" * rng.choice([1, 5, 40, 90, 300]) for _ in range(400)]
    m = messages(spark, *texts)
    units = C.transcript_units(m)
    whole = C.render_transcript(units).first().text
    for block_chunks in (1, 2, 1024):
        got = [r.text for r in C.chunk_transcript(units, 120, block_chunks).orderBy("chunk_ord").collect()]
        want, current, load = [], [], 0
        for t in texts:
            unit = "### User\n" + t
            if load + len(unit) + 2 > 120 and current:
                want.append("\n\n".join(current))
                current, load = [], 0
            current.append(unit)
            load += len(unit) + 2
        want.append("\n\n".join(current))
        assert got == want
        assert "\n\n".join(got) == whole
    assert C.transcript_chars(units).first().full_chars == len(whole)


def test_only_conversations_of_several_blocks_are_chained(spark):
    long = ["word " * (n % 23) + str(n) for n in range(300)]
    units = C.transcript_units(messages(spark, "x" * 50, "short", conv="b").unionByName(messages(spark, *long, conv="a")))
    assert "FlatMapGroupsInPandas" not in C.chunk_numbers(units, 120, 1)._jdf.queryExecution().executedPlan().toString()
    for conv, texts in {"a": long, "b": ["x" * 50, "short"]}.items():
        alone = C.transcript_units(messages(spark, *texts, conv=conv))
        expected = [tuple(r) for r in C.chunk_transcript(alone, 120, 1024).orderBy("chunk_ord").collect()]
        got = C.chunk_transcript(units, 120, 1).filter(F.col("conv_key") == conv).orderBy("chunk_ord")
        assert [tuple(r) for r in got.collect()] == expected


def test_no_units_no_chunks(spark):
    assert C.chunk_transcript(C.transcript_units(messages(spark, ""))).count() == 0


def test_long_text_comes_in_parts_that_read_on(spark):
    rows = [("a", c, 0, i, 0, f"{c}:{i}") for c in (1, 2) for i in range(5000)]
    units = spark.createDataFrame(rows, "conv_key string, code int, src int, ordinal bigint, pos int, text string")
    rules = {1: Rule(group=1, sep=", ", heading="A ", end="."), 2: Rule(group=2, sep="; ", heading="B ", end="!")}
    parts = [r.text for r in assemble(units, rules, "\n", part_chars=20_000).orderBy("part").collect()]
    want = "A " + ", ".join(f"1:{i}" for i in range(5000)) + ".\nB " + "; ".join(f"2:{i}" for i in range(5000)) + "!"
    assert len(parts) > 1 and "".join(parts) == want


def test_blocks_of_long_texts_are_closed_by_size(spark, monkeypatch):
    rows = [("a", c, 0, i, 0, f"{c}:{i} " + "x" * (i % 50)) for c in (1, 2) for i in range(1500)] + [("b", 1, 0, 0, 0, "y" * 9000), ("b", 1, 0, 1, 0, "z")]
    units = spark.createDataFrame(rows, "conv_key string, code int, src int, ordinal bigint, pos int, text string")
    rules = {1: Rule(group=1, sep=", ", heading="A ", end="."), 2: Rule(group=2, sep="; ", heading="B ", end="!")}

    def texts():
        return {r["conv_key"]: r["text"] for r in assemble(units, rules, "\n").collect()}

    whole, few = texts(), text_blocks(units, rules).count()
    monkeypatch.setattr("briefspark.operators.ordered.BLOCK_CHARS", 1000)
    assert texts() == whole and few == 5
    sizes = [len(r["text"].replace(", ", "").replace("; ", "")) for r in text_blocks(units, rules).filter("conv_key = 'a'").collect()]
    assert len(sizes) > 80 and max(sizes) < 1000 + 60 and text_blocks(units, rules).filter("conv_key = 'b'").count() == 2
