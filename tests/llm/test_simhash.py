from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from briefspark.llm import simhash as s
from briefspark.llm.components import components
from tests.llm.cases import documents, edge_texts, least_reachable, prose


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_documents(spark):
    rows = [(i, t) for i, t in edge_texts() if not t or len(t) < 5000]
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in s.components_of(documents(spark, rows)).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = least_reachable(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    assert got == sorted([(i, f, least[r]) for (i, _), f, r in zip(rows, fps, root)], key=str)


def test_links_in_dense_buckets(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = {int(x) for x in rng.integers(0, 1 << 63, 50, dtype=np.uint64)}
    for base in list(values)[:4]:
        chain = [base]
        for _ in range(150):
            x = chain[rng.integers(max(0, len(chain) - 20), len(chain))]
            for _ in range(rng.integers(1, 4)):
                x ^= 1 << int(rng.integers(0, 64))
            chain.append(x)
        values |= set(chain)
    values |= {list(values)[0] ^ m for m in rng.choice(1 << 18, 600, replace=False).tolist()}
    fps = np.array(sorted(values), np.uint64)
    monkeypatch.setattr(s, "PAIRWISE", 64)  # so that large buckets are cut again
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)).tolist()
    want = least_reachable(len(fps), near)
    links = s.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    place = {int(x): n for n, x in enumerate(fps.view(np.int64))}
    found = [(place[r["a"]], place[r["b"]]) for r in links.collect()]
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() >= 1 for a, b in found)
    assert least_reachable(len(fps), found) == want
    again = s.bucket_links(fps, list(range(64)))
    assert least_reachable(len(fps), [(place[int(a)], place[int(b)]) for x, y in again for a, b in zip(x.view(np.int64), y.view(np.int64))]) == want


def test_pivot_distances_bound_hamming_distances():
    fps = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    table = s.pivot_table(fps)
    for a, b in combinations(range(40), 2):
        assert np.abs(table[a] - table[b]).max() <= (int(fps[a]) ^ int(fps[b])).bit_count()


def test_chain_of_components(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, 100), (7, 3), (3, 7), (60, 50), (50, 55)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(41)} | {n: 50 for n in (50, 55, 60)}


def near_rows():
    """Originals with copies on both sides of a similarity of 0.8, and short texts."""
    rows = [(n, t) for n, (_, t) in enumerate(edge_texts())]
    for n in range(12):
        words = [f"w{(n * 7919 + k * 31) % 9973}" for k in range(200)]
        rows.append((1000 + 50 * n, " ".join(words)))
        for edits in range(1, 14):
            copy = list(words)
            for e in range(edits):
                copy[(e * 17 + n) % 200] = f"new{n}-{edits}-{e}"
            rows.append((1000 + 50 * n + edits, " ".join(copy)))
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in s.near_duplicates(documents(spark, rows)).collect()}
    sets = []
    for _, t in rows:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))})
    linked = [(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = least_reachable(len(rows), linked)
    for (i, _), r in zip(rows, root):
        assert got[i]["group_id"] == rows[r][0] and got[i]["stays"] == (i == rows[r][0])


def shingles_of(text):
    words = text.split()
    return {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))}


def groups_of(rows, got):
    """The groups by brute force, and the groups found: each as the least doc_id of a document's."""
    sets = [shingles_of(t) for _, t in rows]
    linked = [(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return [rows[r][0] for r in least_reachable(len(rows), linked)], [got[i] for i, _ in rows]


def family(pairs, template=170, shared=10, own=20):
    """Pairs of similar documents out of one template that makes no two others similar."""
    head = [f"t{k}" for k in range(template)]
    return [(2 * p + q, " ".join([*head, *(f"s{p}-{k}" for k in range(shared)), *(f"o{p}-{q}-{k}" for k in range(own))])) for p in range(pairs) for q in (0, 1)]


def test_pairs_of_a_template_family(spark):
    rows = family(300)
    got = {r["doc_id"]: r["group_id"] for r in s.near_duplicates(documents(spark, rows)).collect()}
    want, found = groups_of(rows, got)
    assert len(set(want)) == 300 and found == want


def test_meeting_at_rare_shingles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 8)  # so that crowded shingles are dealt out in blocks
    rng = np.random.default_rng(3)
    rows = family(25) + [(1000 + n, f"{family(1)[0][1]} {' '.join(f'x{n}-{k}' for k in range(n % 40))}") for n in range(80)]
    rows += [(2000 + n, " ".join(f"v{k}" for k in rng.integers(0, 3, rng.integers(1, 60)))) for n in range(40)]
    docs = spark.createDataFrame(rows, "uid long, text string")
    sets = {r["uid"]: set(np.frombuffer(r["shingles"], "<u4").tolist()) for r in s.shingle_sets(docs, 5).collect()}
    for root in (F.col("uid"), F.when(F.col("uid") < 1040, F.lit(0)).otherwise(F.col("uid"))):
        roots = docs.select("uid", root.cast("long").alias("root"))
        of = {r["uid"]: r["root"] for r in roots.collect()}
        want = {(a, b) for a, b in combinations(sorted(sets), 2) if of[a] != of[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        pairs = [(r["a"], r["b"]) for r in s.prefix_pairs(s.shingle_sets(docs, 5), roots, 0.8).collect()]
        assert want and want <= set(pairs) and len(pairs) == len(set(pairs)) and all(of[a] != of[b] for a, b in pairs)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(5, prose(1, 50)), (5, prose(1, 50)), (None, prose(1, 50)), (None, None), (3, None)]
    got = s.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["group_id"], r["stays"]) for r in got) == [(0, 3, False), (0, 5, False), (3, 3, True), (5, 5, True), (5, 5, True)]
    assert s.near_duplicates(documents(spark, [])).count() == 0
    assert s.components_of(documents(spark, [])).count() == 0
    assert s.components_of(documents(spark).select("doc_id", "text", F.lit(1).alias("component_id"))).count() == len(edge_texts())
