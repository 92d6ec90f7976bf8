import json
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefspark.operators import replay as RP
from briefspark.operators import replay_blocks as RB
from briefspark.operators.sandbox import Sandbox, call_of, joined

EVENTS = "conv_key string, ord bigint, name string, input string"
STATE = ("path", "content", "place", "write_ord", "manifest_ord")


def fold(events):
    boxes = {}
    for conv, at, name, text in sorted(events, key=lambda e: e[:2]):
        boxes.setdefault(conv, Sandbox()).apply(at, name, call_of(text))
    return {(conv, *(entry[n] for n in STATE)) for conv, box in boxes.items() for entry in box.state()}


def replayed(df):
    rows = df.select("conv_key", *STATE).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def chat(conv, n, seed):
    """Calls at random that move the folder, copy, overwrite, remove and edit a few files."""
    draw = random.Random(seed)
    names = ["a.md", "b.md", "sub/c.md", "../d.md", "/tmp/e", "./a.md", "/home/claude/b.md", "'f g.md'"]
    word = lambda: draw.choice(names)
    quoted = lambda: draw.choice([w for w in names if "'" not in w] + ['"f g.md"'])
    for at in range(n):
        call = draw.choice(["put", "edit", "edit", "insert", "cp", "mv", "rm", "cd", "line", "show"])
        text = {
            "put": ("create_file", {"path": word(), "file_text": f"x{at}\nx"}),
            "edit": ("str_replace", {"path": word(), "old_str": draw.choice("xyq"), "new_str": draw.choice(["y", "xx", ""])}),
            "insert": ("edit", {"command": "insert", "path": word(), "insert_line": draw.randrange(4), "new_str": f"i{at}"}),
            "cp": ("bash", {"command": f"cp -f {quoted()} {quoted()}"}),
            "mv": ("bash", {"command": f"mv {quoted()} {quoted()}"}),
            "rm": ("bash", {"command": f"rm -f {quoted()} {quoted()}"}),
            "cd": ("bash", {"command": f"cd {draw.choice(['..', 'sub', '/tmp', '/home/claude', '-x', '../../..', '#y/./z'])}"}),
            "line": ("bash", {"command": f"cd sub && cp {quoted()} {quoted()}; mv {quoted()} {quoted()}\ncd .."}),
            "show": ("present_files", {"filepaths": draw.sample(names, 2)}),
        }[call]
        yield conv, at * 3, text[0], json.dumps(text[1])


def test_blocks_give_the_rows_of_the_fold(spark):
    events = [e for k in range(30) for e in chat(f"c{k}", 10 + 10 * k, k)]
    df = spark.createDataFrame(events, EVENTS).repartition(5)
    want = fold(events)
    for bits in (3, 6):
        assert replayed(RB.replay_tied(df, bits)) == want
    assert replayed(RP.replay_files(df)) == want


def test_awkward_calls(spark):
    events = [
        ("a", 0, "bash", json.dumps({"command": "mv x y; cp y y; rm ''; cd"})),
        ("a", 1, "create_file", json.dumps({"path": "x", "file_text": ""})),
        ("a", 2, "bash", json.dumps({"command": "mv x x"})),
        ("a", 3, None, None),
        ("a", 4, "bash", "{broken"),
        ("b", -5, "insert", json.dumps({"path": "new", "insert_text": "t"})),
        ("b", 1 << 40, "bash", '{"command": "\\u0063d .. && cp claude/new kept"}'),
        ("b", (1 << 40) + 1, "present_files", json.dumps({"file_paths": ["kept", "kept", None, "/z"]})),
        ("c", 0, "bash", json.dumps({"command": "rm gone"})),
    ]
    df = spark.createDataFrame(events, EVENTS).withColumn("extra", F.lit(1))
    got = replayed(RP.replay_files(df))
    assert got == fold(events)
    assert {r[1:3] for r in got if r[0] == "b" and r[5] is None} == {("/home/claude/new", "t\n"), ("/home/kept", "t\n")}
    assert replayed(RB.replay_tied(df.filter("false"))) == set()


def test_a_long_tied_chat_is_many_tasks(spark):
    n = 50_000
    kinds = F.pmod("id", F.lit(5))
    path = F.concat(F.lit("f"), F.floor(F.col("id") / 50).cast("string"))
    call = (
        F.when(kinds == 0, F.to_json(F.struct(path.alias("path"), F.lit("old text").alias("file_text"))))
        .when(kinds == 1, F.to_json(F.struct(path.alias("path"), F.lit("o").alias("old_str"), F.lit("oo").alias("new_str"))))
        .when(kinds == 2, F.to_json(F.struct(F.concat(F.lit("cp "), path, F.lit(" ../copy"), path).alias("command"))))
        .when(kinds == 3, F.to_json(F.struct(F.concat(F.lit("cd ../x"), F.floor(F.col("id") / 5_000).cast("string")).alias("command"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("mv ../copy"), path, F.lit(" /moved")).alias("command"))))
    )
    name = F.when(kinds == 0, "create_file").when(kinds == 1, "str_replace").otherwise("bash")
    df = spark.range(n).select(F.lit("hot").alias("conv_key"), F.col("id").alias("ord"), name.alias("name"), call.alias("input"))
    want = fold([tuple(r) for r in df.collect()])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        begin = time.time()
        assert replayed(RP.replay_files(df)) == want
        assert time.time() - begin < 120
        tasks = RB.resolved(df).select(F.spark_partition_id().alias("p"), "made").distinct().groupBy("p").count().collect()
        assert len(tasks) == 8 and sum(r["count"] for r in tasks) >= 1_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


STEP = st.sampled_from(["..", ".", "", "a", "b", "..a", "-c"])
PATH = st.builds(lambda root, steps: root + "/".join(steps), st.sampled_from(["", "", "/"]), st.lists(STEP, max_size=5))


@settings(max_examples=500, deadline=None)
@given(PATH, PATH, PATH)
def test_moves_compose(first, second, third):
    assert joined(joined(first or ".", second), third) == joined(first or ".", joined(second or ".", third))
    start = joined("/home/claude", first)
    assert joined(joined(start, second), third) == joined(start, joined(joined(".", second), third))
