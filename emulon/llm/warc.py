"""WARC archives of pages, with a two-level capture index.

``write_archive`` writes one WARC 1.1 record per page.  Of pages with equal payloads of at least ``least_bytes`` bytes, that with the
smallest key is a response, the others revisit it and hold no payload.  The files are plain WARC: records one after another, each closed by two
line ends, which Spark's text writer puts in as its line separator; so the files are committed like any other output.

``build_index`` walks through the files from header to header and sorts what it finds by reversed-host URL key
(``com,example)/path?query``) into compressed blocks of ``block_lines`` lines.  Above them is a sparse directory: one first key
per block.  ``lookup`` searches the first keys of the shards (one per range of the sort, so at most
as many as shuffle partitions), then the directory of a shard, both by bisection, and opens only the blocks that may hold a wanted key.  What it
finds says where records lie; ``fetch`` reads these byte ranges in the order of the files.  Where the store of the
archive is not one that tasks can open at an offset, Spark reads the files that are wanted, and the ranges are cut from them.

Payloads are equal if their SHA-256 are.  Pages whose payload may occur twice meet in a join, with keys that hold a thousandth of the rows or
more (a thousand at most) broadcast; all others are written where they are read.

Nulls and oddities: a null payload counts as empty; a null URL has the empty key and no target header; white space in a URL is percent-encoded;
without a key a page has an empty record number, and it is a revisit where a page with a key has its payload; rows that share payload and
smallest key are all responses; an empty table gives an empty archive and index; keys that the index does not hold find nothing; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emulon.llm.common import column, hot_join
from emulon.llm.lines import _flags
from emulon.runtime import cut_lineage

END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20  # about the size of a file, by the mean size of records
READ = 4 << 20  # bytes of neighbouring records read at once
GAP = 64 << 10  # bytes between records that are read along with them

BLOCKS = "shard int, block int, first_key string, last_key string, n_lines int, payload binary"
CAPTURES = "key string, url string, record_id string, record_type string, digest string, file string, offset long, length long"


# ----------------------------------------------------------------------------- keys and digests


def _one_line(url: str) -> str:
    return re.sub(r"[\s\x00-\x20\x7f]", lambda m: quote(m.group()), url)


def url_key(url: str | None) -> str:
    """Reversed host, then port unless it is the scheme's own, path and query; a URL without a host is its own key."""
    if url is None:
        return ""
    url = _one_line(url)
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", url)
    if not found:
        return url
    scheme, site, path, query = (g or "" for g in found.groups())
    host, colon, port = site.rpartition("@")[2].lower().partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    own = {"http": "80", "https": "443"}.get(scheme.lower())
    return ",".join(reversed(host.split("."))) + (f":{port}" if colon and port != own else "") + ")" + (path or "/") + query


@F.pandas_udf(StringType())
def url_key_of(url: pd.Series) -> pd.Series:
    return url.map(lambda u: url_key(None if pd.isna(u) else u))


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four letters."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


# ----------------------------------------------------------------------------- writing


def _record() -> Column:
    """The record of a row of page, url, payload, digest, first; without the two line ends after it."""
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    number = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       F.concat(F.lit("Content-Length: "), F.octet_length("payload")))
    block_bytes = F.octet_length(http) + len(END) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    head = F.concat_ws(
        "\r\n", F.lit(VERSION),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), number(F.col("page"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), number(F.col("first")))),
        F.when(revisit, f"WARC-Profile: {PROFILE}"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_bytes.cast("string")))
    return F.concat(head, F.lit(END), http, F.lit(END), F.when(revisit, "").otherwise(F.col("payload")))


@F.pandas_udf(StringType())
def _target(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if pd.isna(u) else _one_line(u))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """The pages as WARC files in a new folder."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    size = F.octet_length("payload")
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    repeated = cut_lineage(rows.where(size >= least_bytes).groupBy("same").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1"))
    n_repeated = repeated.count()
    if n_repeated:
        maybe = _flags(repeated, ["same"], min(26, max(12, (8 * n_repeated).bit_length())))
        meeting = hot_join(rows.where(maybe), repeated, "same", total)
        rows = rows.where(~maybe).withColumn("first", F.lit(None).cast("long")).unionByName(meeting.drop("n"))
    else:
        rows = rows.withColumn("first", F.lit(None).cast("long"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "date": F.lit(date), "url": _target("url")})
    per_file = max(1, FILE_BYTES * max(1, total) // max(1, n_bytes + 600 * total))
    rows.select(_record().alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


# ----------------------------------------------------------------------------- reading


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path) if ":/" in path else f"file://{path}"


def _ranged(path: str) -> bool:
    """Whether tasks can open the files of this store at an offset themselves."""
    try:
        pa.fs.FileSystem.from_uri(_uri(path))
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _opened(path: str) -> pa.NativeFile:
    store, inside = pa.fs.FileSystem.from_uri(_uri(path))
    return store.open_input_file(inside)


def _files(spark: SparkSession, path: str, ranged: bool) -> DataFrame:
    """path, length, and content where tasks cannot open files themselves."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", "length", (F.lit(None).cast("binary") if ranged else F.col("content")).alias("content"))


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def walk(source: pa.NativeFile, size: int, window: int = 2048) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and headers of each record, from header to header; payloads are not read."""
    at = 0
    while at < size:
        head, take = b"", window
        while (end := head.find(b"\r\n\r\n")) < 0:
            if at + len(head) >= size:
                raise ValueError(f"no end of the header that begins at {at}")
            head, take = source.read_at(min(take, size - at), at), 2 * take
        headers = _headers(head[:end])
        length = end + 4 + int(headers["content-length"])
        yield at, length, headers
        at += length + 4


def build_index(spark: SparkSession, archive: str, path: str, block_lines: int = 3000, ranged: bool | None = None) -> None:
    """``path/blocks`` and the sparse ``path/directory`` of the archive."""
    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = _opened(row["path"]) if row["content"] is None else pa.BufferReader(row["content"])
                name = row["path"].rpartition("/")[2]
                found = [(url_key(h.get("warc-target-uri")), h["warc-record-id"], json.dumps(
                    {"url": h.get("warc-target-uri"), "record_id": h["warc-record-id"], "record_type": h["warc-type"],
                     "digest": h["warc-payload-digest"], "file": name, "offset": offset, "length": length}, ensure_ascii=False))
                    for offset, length, h in walk(source, row["length"])]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in some], pa.string()) for i in range(3)], names=["key", "record_id", "line"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n_blocks, keys, lines = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal n_blocks, keys, lines
            payload = zlib.compress("\n".join(f"{k} {line}" for k, line in zip(keys, lines)).encode())
            row = pa.RecordBatch.from_pylist([{"shard": shard, "block": n_blocks, "first_key": keys[0], "last_key": keys[-1],
                                               "n_lines": len(keys), "payload": payload}], schema=schema)
            n_blocks, keys, lines = n_blocks + 1, [], []
            return row

        for batch in batches:
            for k, line in zip(column(batch, "key").to_pylist(), column(batch, "line").to_pylist()):
                keys.append(k)
                lines.append(line)
                if len(keys) == block_lines:
                    yield flush()
        if keys:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()),
                        ("n_lines", pa.int32()), ("payload", pa.binary())])
    files = _files(spark, archive, _ranged(archive) if ranged is None else ranged)
    found = cut_lineage(files.mapInArrow(captures, "key string, record_id string, line string"))
    ordered = found.repartitionByRange("key", "record_id").sortWithinPartitions("key", "record_id", "line")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    spark.read.schema(BLOCKS).parquet(f"{path}/blocks").drop("payload").write.parquet(f"{path}/directory")


def _spanning(first: list[str], key: str) -> range:
    """Places whose stretch, from its first key to the next one's, may hold the key; of the first stretch, too, as keys are many there."""
    return range(max(0, bisect_left(first, key) - 1), bisect_right(first, key))


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """The captures (see ``CAPTURES``) of the URL keys that the index holds; each wanted key counts once."""
    directory = spark.read.schema("shard int, block int, first_key string, last_key string, n_lines int").parquet(f"{path}/directory")
    shards = sorted(tuple(r) for r in directory.groupBy("shard").agg(F.min("first_key"), F.max("last_key")).collect())
    shards = [(low, high, s) for s, low, high in shards]
    shards.sort()
    lows = [s[0] for s in shards]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, shards[i][2]) for k in column(batch, "key").to_pylist() for i in _spanning(lows, k) if k <= shards[i][1]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["key", "shard"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The directory of a shard comes before the keys that are looked for in it."""
        shard, first, numbers, out = None, [], [], []
        for batch in batches:
            for row_shard, kind, k, block in zip(*(column(batch, c).to_pylist() for c in ("shard", "kind", "key", "block"))):
                if row_shard != shard:
                    shard, first, numbers = row_shard, [], []
                if kind == 0:
                    first.append(k)
                    numbers.append(block)
                else:
                    out += [(k, shard, numbers[i]) for i in _spanning(first, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                                  pa.array([o[2] for o in out], pa.int32())], names=["key", "shard", "block"])
                out = []

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block comes before the keys that are looked for in it, and is opened for the first of them."""
        held, payload, names, lines = None, b"", None, []
        for batch in batches:
            out = []
            for shard, block, kind, k, data in zip(*(column(batch, c).to_pylist() for c in ("shard", "block", "kind", "key", "payload"))):
                if kind == 0:
                    held, payload, names = (shard, block), data, None
                elif held == (shard, block):
                    if names is None:
                        lines = [line.partition(" ") for line in zlib.decompress(payload).decode().split("\n")]
                        names = [line[0] for line in lines]
                    for i in range(bisect_left(names, k), bisect_right(names, k)):
                        out.append({"key": k, **json.loads(lines[i][2])})
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[at : at + 10_000], schema=capture_schema)

    capture_schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in CAPTURES.split(", ")])
    wanted = keys.select(F.col(f"`{key}`").cast("string").alias("key")).where("key is not null").distinct()
    none = F.lit(None)
    at_shard = wanted.mapInArrow(to_shards, "key string, shard int").select("shard", F.lit(1).alias("kind"), "key", none.cast("int").alias("block"))
    both = at_shard.unionByName(directory.select("shard", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "block"))
    both = both.repartition("shard").sortWithinPartitions("shard", "kind", "key", "block")
    hits = cut_lineage(both.mapInArrow(to_blocks, "key string, shard int, block int"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(hits.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
    both = hits.select("shard", "block", F.lit(1).alias("kind"), "key", none.cast("binary").alias("payload")).unionByName(
        blocks.select("shard", "block", F.lit(0).alias("kind"), none.cast("string").alias("key"), "payload"))
    both = both.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "key")
    return both.mapInArrow(open_blocks, CAPTURES)


def _parsed(record: bytes) -> dict[str, object]:
    end = record.find(b"\r\n\r\n")
    h = _headers(record[:end])
    body = record.find(b"\r\n\r\n", end + 4) + 4  # after the HTTP header
    return {"record_id": h["warc-record-id"], "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": h.get("warc-refers-to"),
            "digest": h["warc-payload-digest"].partition(":")[2], "payload": record[body:] if h["warc-type"] == "response" else None}


RECORDS = "record_id string, url string, record_type string, refers_to string, digest string, payload binary"


def fetch(spark: SparkSession, archive: str, captures: DataFrame, ranged: bool | None = None) -> DataFrame:
    """The records (see ``RECORDS``) at ``file, offset, length``; a revisit has no payload of its own."""
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.string()) for c in RECORDS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length"))))
            at = 0
            while at < len(rows):
                file, start, length = rows[at]
                if file != name:
                    name, source = file, _opened(f"{archive.rstrip('/')}/{file}")
                to, end = at + 1, start + length
                while to < len(rows) and rows[to][0] == file and rows[to][1] - end <= GAP and rows[to][1] + rows[to][2] - start <= READ:
                    end = max(end, rows[to][1] + rows[to][2])
                    to += 1
                data = source.read_at(end - start, start)
                yield pa.RecordBatch.from_pylist([_parsed(data[o - start : o - start + n]) for _, o, n in rows[at:to]], schema=schema)
                at = to

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_parsed(r) for r in column(batch, "record").to_pylist()], schema=schema)

    places = captures.select("file", "offset", "length")
    if _ranged(archive) if ranged is None else ranged:
        places = cut_lineage(places)  # a range is found by sampling, which should not look up everything twice
        return places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)
    spans = places.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))  # no more than a file has records
    files = _files(spark, archive, False).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(spans, "file")
    cut = F.transform("spans", lambda s: F.substring(F.col("content"), (s["offset"] + 1).cast("int"), s["length"].cast("int")))
    return files.select(F.explode(cut).alias("record")).mapInArrow(parse, RECORDS)


def page_number(record_id: Column) -> Column:
    """The key of a record number; null where the page had none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; for a revisit those of the payload that it stands for, as read back."""
    rows = cut_lineage(records.select(
        page_number(F.col("record_id")).alias("page_id"), "record_type", page_number(F.col("refers_to")).alias("refers_to"), "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).alias("payload_digest")))
    revisits = rows.where("record_type = 'revisit'")
    responses = rows.where("record_type = 'response' and payload_digest = digest")
    first = responses.join(revisits.select(F.col("refers_to").alias("page_id"), "digest").distinct(), ["page_id", "digest"], "left_semi").select(
        F.concat_ws(" ", "page_id", "digest").alias("at"), "payload_bytes", "payload_digest").dropDuplicates(["at"])
    asked = revisits.select("page_id", "record_type", "refers_to", F.concat_ws(" ", "refers_to", "digest").alias("at"))
    found = hot_join(asked, first, "at", revisits.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*columns).unionByName(found.select(*columns))
