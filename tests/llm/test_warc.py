import base64
import gzip
import hashlib
import itertools
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from briefspark.llm import warc
from tests.llm.cases import CLASHING, prose

ROWS = [
    (1, "http://a/\r\nx", None), (2, None, ""), (3, "http://www.b.com:8080/P?q=1", None), (None, "http://[bad", "\r\n\r\nWARC/1.1\r\n"),
    (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (1, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "é\r\n\r\nWARC/1.1\r\n"),
    (9, "http://x.org/long", prose(4, 40_000)), (2**62, "http://x.org/long", "far"), (-5, "http://x.org/long", "below"), (2**63 - 1, "u", "far"), (-(2**63), "u", "least"),
]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({name: F.lit(1) for name in [*CLASHING, "payload", "newest", "record", "archive"]})


def expected(rows):
    newest = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        newest[payload] = max([x for x in (newest.get(payload), i) if x is not None], default=None)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        revisit = i != newest[payload]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "revisit" if revisit else "response", newest[payload] if revisit else None))
    return sorted(out, key=str)


def test_records_are_read_back(spark):
    got = warc.capture_history(pages(spark, ROWS).repartition(3)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_records_out_of_any_pieces():
    ends = ["", "\r", "\r\n", "\r\n\r", "\r\n\r\n", "x\r\n\r\n\r\n\r\n", "\r\nWARC/1.1\r\n\r\n", "\n\r\n"]
    file, want = b"", []
    for i, payload in enumerate(end.encode() for end in ends + [prose(1, 50) + e for e in ends]):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        digest = base64.b32encode(hashlib.sha1(payload).digest())
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:capture:%d>\r\nWARC-Date: t\r\nWARC-Target-URI: u\r\n" % i
        head += b"WARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (digest, len(block))
        want.append((i, len(payload), len(file)))
        file += head + block + b"\r\n\r\n"
        archive = warc.Archive("a")
        pieces = file.split(b"\r\n\r\n")
        for piece in pieces if pieces[-1] else pieces[:-1]:
            archive.add(piece)
        assert [(e[2], e[4], e[9]) for e in archive.run()] == want
    cut = warc.Archive("a")
    cut.add(head[:-4])
    for broken in (cut.run, lambda: warc.Archive("b").add(b"no record")):
        with pytest.raises(ValueError):
            broken()


def test_a_payload_of_fifty_megabytes(spark):
    rows = [(1, "http://a/", ("é" * 1_000 + "\r\n\r\n") * 25_000 + "end"), (2, "http://a/", "x"), (3, "http://a/", "x")]
    big = spark.createDataFrame([(i, u, h[-3:], len(h)) for i, u, h in rows], "page_id long, url string, tail string, n long")
    body = F.when(F.col("n") > 9, F.concat(F.repeat(F.lit("é" * 1_000 + "\r\n\r\n"), F.lit(25_000)), F.lit("end"))).otherwise(F.col("tail"))
    got = warc.capture_history(big.select("page_id", "url", body.alias("html")).coalesce(1))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)


def test_small_payloads_are_always_responses(spark):
    got = warc.capture_history(pages(spark, ROWS), min_bytes=5).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] < 5} == {"response"}
    assert {r["record_type"] for r in got if r["payload_bytes"] == 16} <= {"response", "revisit"}


def test_history_is_globally_ordered(spark):
    rows = [(i, f"http://h{i % 7}.org/p{i % 11}", f"text {i % 5}") for i in range(400)]
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages(spark, rows), folder, archive_records=30)
    got = warc.merged_index(warc.kept(warc.read_runs(spark, folder)), ranges=5).toPandas().sort_values(["range", "position"])
    keys = [warc.sort_key(x) for x in zip(got.url_key, got.time, got.page_id)]
    assert keys == sorted(keys) and len(keys) == 400 and got.archive.nunique() > 5 and got.range.nunique() > 1


def test_archives_are_plain_warc(spark):
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages(spark, [(1, "http://a/", "x")]).coalesce(1), folder)
    path = folder.removeprefix("file:")
    name = next(x for x in os.listdir(path) if x.startswith("part-"))
    content = gzip.open(f"{path}/{name}").read()
    assert content.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and content.endswith(b"\r\n\r\nx\r\n\r\n")


def test_loser_tree_merges_any_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 17):
        runs = [sorted([(f"u{rng.randrange(9)}", "t", rng.randrange(99)) for _ in range(rng.randrange(9))], key=warc.sort_key) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs), key=warc.sort_key)


def test_empty_table(spark):
    assert warc.capture_history(pages(spark, [])).count() == 0
