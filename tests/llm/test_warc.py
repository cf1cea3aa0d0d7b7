"""Archives and their index: whole records back, from their places, by URL key."""

import base64
import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from emulon.llm import warc
from emulon.runtime import scratch_path

COPIED = "<p>the same page</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [Row(page_id=i, url=f"http://www{i % 3}.Host{i % 7}.example.com:80/a/{i % 11}?q={i}", html=f"<p>{i}</p>\r\n\r\nWARC/1.1\r\nx: {i}", first=i) for i in range(200)]
    rows += [Row(page_id=1000 - i, url="http://hot.example.org/", html=COPIED, first=0) for i in range(300)]
    rows += [Row(page_id=2000, url=None, html=None, first=0), Row(page_id=2001, url="", html="", first=0), Row(page_id=None, url="no host", html="alone", first=0),
             Row(page_id=None, url="http://a b.example/ü\r\nX: y", html=COPIED, first=0), Row(page_id=5, url="http://again/", html="<p>5</p>\r\n\r\nWARC/1.1\r\nx: 5", first=0),
             Row(page_id=2002, url="https://u:p@x.example:8443/é#frag", html="é🙂" * 50_000, first=0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, first long").withColumns(
        {c: F.lit("clash") for c in ("payload", "digest", "same", "page", "date", "n", "is_hot", "key")})


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    payloads = [(r["html"] or "").encode() for r in rows]
    first = {}
    for r, p in zip(rows, payloads):
        if r["page_id"] is not None and len(p) >= least:
            first[p] = min(first.get(p, r["page_id"]), r["page_id"])
    out = []
    for r, p in zip(rows, payloads):
        again = p in first and r["page_id"] != first[p]
        out.append((r["page_id"], len(p), b32(p), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark, pages):
    saved, warc.FILE_BYTES = warc.FILE_BYTES, 60_000  # several files
    path, index = scratch_path(spark, "warc"), scratch_path(spark, "captures")
    warc.write_archive(pages, path)
    warc.build_index(spark, path, index, block_lines=16)
    warc.FILE_BYTES = saved
    return path, index


def found(records):
    return sorted((tuple(r) for r in warc.resolve(records).collect()), key=str)


@pytest.mark.parametrize("ranged", [True, False])
def test_every_page_comes_back_by_its_key(spark, pages, archive, ranged):
    path, index = archive
    captures = warc.lookup(spark, index, pages.select(warc.url_key_of("url").alias("key")))
    assert found(warc.fetch(spark, path, captures, ranged)) == brute(pages.collect())


def test_whole_files_are_indexed_alike(spark, archive):
    path, _ = archive
    index = scratch_path(spark, "captures")
    warc.build_index(spark, path, index, block_lines=1000, ranged=False)
    one, other = (sorted(map(str, warc.lookup(spark, i, spark.read.parquet(f"{i}/directory").select(F.col("first_key").alias("key"))).select("key").distinct().collect()))
                  for i in (index, archive[1]))
    assert set(one) <= set(other) and one


def test_a_key_finds_all_its_captures_over_many_blocks(spark, archive):
    path, index = archive
    keys = spark.createDataFrame([("org,example,hot)/",), ("org,example,hot)/",), ("zz",), ("",), (None,), ("org,example)/",), ("a",)], "key string")
    got = warc.lookup(spark, index, keys).collect()
    assert sum(r["key"] == "org,example,hot)/" for r in got) == 300 and sum(r["key"] == "" for r in got) == 2 and len(got) == 302
    blocks = spark.read.parquet(f"{index}/blocks")
    assert blocks.where("first_key = 'org,example,hot)/'").count() > 10
    assert spark.read.parquet(f"{index}/directory").count() == blocks.count()


def test_records_are_warc(spark, archive):
    path, _ = archive
    whole = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect())
    at, types = 0, []
    while at < len(whole):
        assert whole.startswith(b"WARC/1.1\r\n", at)
        end = whole.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in whole[at:end].decode().split("\r\n")[1:])
        at = end + 4 + int(head["Content-Length"])
        assert whole[at : at + 4] == b"\r\n\r\n"
        at += 4
        types.append(head["WARC-Type"])
        assert ("WARC-Refers-To" in head) == (head["WARC-Type"] == "revisit")
    assert len(types) == 506


def test_small_payloads_are_not_revisited(spark, pages):
    path, index = scratch_path(spark, "warc"), scratch_path(spark, "captures")
    warc.write_archive(pages, path, least_bytes=len(COPIED) + 1)
    warc.build_index(spark, path, index)
    captures = warc.lookup(spark, index, pages.select(warc.url_key_of("url").alias("key")))
    assert found(warc.fetch(spark, path, captures)) == brute(pages.collect(), len(COPIED) + 1)


def test_url_keys():
    assert warc.url_key("http://www.Example.com/a?b=c#d") == "com,example)/a?b=c"
    assert warc.url_key("https://www2.a.example.com:443") == "com,example,a)/"
    assert warc.url_key("http://u@x.org:8080/p q") == "org,x:8080)/p%20q"
    assert warc.url_key(None) == "" and warc.url_key("mailto:x") == "mailto:x"


def test_empty_table(spark, pages):
    path, index = scratch_path(spark, "warc"), scratch_path(spark, "captures")
    warc.write_archive(pages.limit(0), path)
    warc.build_index(spark, path, index)
    captures = warc.lookup(spark, index, pages.select(warc.url_key_of("url").alias("key")))
    assert warc.resolve(warc.fetch(spark, path, captures)).collect() == []
