"""Token ids in files, compressed by Re-Pair grammars.

Documents are dealt to shards by ascending key.  A shard holds blocks of about ``block_tokens`` ids.
Within a block the most frequent pairs of neighbouring symbols are replaced by new symbols, again
and again.  The block stores the pair behind each new symbol (its rule) and the number of ids that
it stands for, so that any document, or any span of one, is decoded without the rest.

File format: a Parquet table ``shard int, block int, doc_ids array<long>, n_tokens long, payload
binary``.  The payload is little-endian: the four bytes ``RPG1``; unsigned 32-bit numbers of documents,
rules and symbols, the first rule's id and the number of bit planes; then unsigned 32-bit arrays: ids of each
document, symbols of each document, rules (left and right of each), expansion lengths; then the
lower 16 bits of the symbols; then their higher bits, one bit plane after another, eight symbols a byte.

Nulls and oddities: a null text is empty (only the end id); a null key sorts first; repeated keys keep all
rows, ordered by a hash of their text; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emulon.llm.common import column, ranges, texts
from emulon.llm.tokens import Encoder, before_words

BLOCKS = "shard int, block int, doc_ids array<long>, n_tokens long, payload binary"
MAGIC = b"RPG1"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20  # bits of the table of pair hashes


class Block(NamedTuple):
    doc_tokens: np.ndarray
    doc_symbols: np.ndarray
    first_rule: int
    rules: np.ndarray  # (n, 2)
    expansion: np.ndarray
    symbols: np.ndarray


def compress(ids: np.ndarray, doc_tokens: np.ndarray, first_rule: int, min_count: int = 32, rounds: int = 8) -> Block:
    """Re-Pair over one block; pairs never reach over the end of a document.

    A round replaces all pairs that are at least an eighth as frequent as the most frequent one.  Where
    two of them overlap, the more frequent is taken; the other may be taken in the next round.
    It ends when no pair occurs ``min_count`` times, or after ``rounds`` rounds.
    """
    seq = ids.astype(np.uint64)
    last = np.zeros(len(seq), dtype=bool)
    last[np.cumsum(doc_tokens)[doc_tokens > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    for _ in range(rounds):
        if len(seq) < 2:
            break
        keys = (seq[:-1] << np.uint64(32)) | seq[1:]
        slot = ((keys * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int32)
        inner = ~last[:-1]
        counts = np.bincount(slot[inner], minlength=1 << _SLOTS)
        limit = max(min_count, int(counts.max()) // 8)
        likely = (counts >= limit)[slot]
        likely &= inner
        where = np.flatnonzero(likely)
        if not len(where):
            break
        near = keys[where]
        pairs, exact = np.unique(near, return_counts=True)
        keep = exact >= limit if (exact >= limit).any() else exact >= min_count
        pairs, exact = pairs[keep], exact[keep]
        if not len(pairs):
            break
        order = np.argsort(-exact, kind="stable")
        pairs = pairs[order]
        owner = np.full(1 << _SLOTS, -1, dtype=np.int32)  # pairs that share a slot: the most frequent, others later
        home = ((pairs * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int32)
        owner[home[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        which = owner[slot[where]]
        hit = (which >= 0) & (pairs[which] == near)
        where, which = where[hit], which[hit]
        priority = np.zeros(len(seq) + 1, dtype=np.int32)  # at position + 1; larger is more frequent
        priority[where + 1] = len(pairs) - which
        beside = np.maximum(priority[where], priority[where + 2])
        free = beside <= priority[where + 1]  # a more frequent pair beside it goes first
        where, which = where[free], which[free]
        run = np.flatnonzero(np.diff(where, prepend=-2) > 1)  # what still touches is one pair repeated: every other one
        even = (np.arange(len(where)) - np.repeat(run, np.diff(run, append=len(where)))) % 2 == 0
        where, which = where[even], which[even]
        taken = np.bincount(which, minlength=len(pairs)) > 0
        used, which = np.flatnonzero(taken), (np.cumsum(taken) - 1)[which]
        rules.append(pairs[used])
        seq[where] = (first_rule + n_rules + which).astype(np.uint64)
        n_rules += len(used)
        last[where] |= last[where + 1]
        stay = np.ones(len(seq), dtype=bool)
        stay[where + 1] = False
        seq, last = seq[stay], last[stay]
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    table = np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    expansion = np.ones(n_rules, dtype=np.uint32)
    at = 0
    for group in rules:  # a round's rules only use older ones
        part = table[at : at + len(group)].astype(np.int64) - first_rule
        sizes = np.where(part >= 0, expansion[np.maximum(part, 0)] if n_rules else 1, 1)
        expansion[at : at + len(group)] = sizes.sum(axis=1)
        at += len(group)
    ends = np.flatnonzero(last)
    doc_symbols = np.zeros(len(doc_tokens), dtype=np.int64)
    doc_symbols[doc_tokens > 0] = np.diff(ends, prepend=-1)
    return Block(doc_tokens, doc_symbols, first_rule, table, expansion, seq.astype(np.uint32))


def to_bytes(block: Block) -> bytes:
    planes = max(0, int(block.first_rule + len(block.rules)).bit_length() - 16)
    head = np.array([len(block.doc_tokens), len(block.rules), len(block.symbols), block.first_rule, planes])
    arrays = (head, block.doc_tokens, block.doc_symbols, block.rules.ravel(), block.expansion)
    parts = [MAGIC, *(np.asarray(a).astype("<u4").tobytes() for a in arrays), block.symbols.astype("<u2").tobytes()]
    parts += [np.packbits((block.symbols >> np.uint32(16 + p)).astype(np.uint8) & 1).tobytes() for p in range(planes)]
    return b"".join(parts)


def from_bytes(payload: bytes) -> Block:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    docs, n_rules, n_symbols, first_rule, planes = np.frombuffer(payload, "<u4", 5, 4).tolist()
    at = 24
    arrays = []
    for n in (docs, docs, 2 * n_rules, n_rules):
        arrays.append(np.frombuffer(payload, "<u4", n, at).astype(np.int64))
        at += 4 * n
    symbols = np.frombuffer(payload, "<u2", n_symbols, at).astype(np.int64)
    at += 2 * n_symbols
    for p in range(planes):
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, (n_symbols + 7) // 8, at), count=n_symbols)
        symbols |= bits.astype(np.int64) << (16 + p)
        at += (n_symbols + 7) // 8
    return Block(arrays[0], arrays[1], first_rule, arrays[2].reshape(-1, 2), arrays[3], symbols)


class Expander:
    """Turns symbols of a block into ids; all rules are written out once, children before parents."""

    def __init__(self, block: Block):
        self.block = block
        self.starts = np.cumsum(block.expansion) - block.expansion
        self.flat = np.zeros(int(block.expansion.sum()), dtype=np.uint32)
        done = 0
        while done < len(block.rules):  # as many rules at once as use only rules already written out
            deep = block.rules[done:].max(axis=1) - block.first_rule
            stop = np.flatnonzero(deep >= done)
            upto = done + (int(stop[0]) if len(stop) else len(deep))
            pairs = block.rules[done:upto]
            self.flat[self.starts[done] : self.starts[done] + int(block.expansion[done:upto].sum())] = self._write(pairs.ravel())
            done = upto

    def _write(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.block.first_rule
        is_rule = rule >= 0
        lengths = np.ones(len(symbols), dtype=np.int64)
        lengths[is_rule] = self.block.expansion[rule[is_rule]]
        out = np.empty(int(lengths.sum()), dtype=np.uint32)
        at = np.cumsum(lengths) - lengths
        out[at[~is_rule]] = symbols[~is_rule]
        out[ranges(at[is_rule], lengths[is_rule])] = self.flat[ranges(self.starts[rule[is_rule]], lengths[is_rule])]
        return out

    def ids(self) -> np.ndarray:
        return self._write(self.block.symbols)

    def span(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document, found by expansion lengths; nothing else is decoded."""
        first = int(self.block.doc_symbols[:doc].sum())
        symbols = self.block.symbols[first : first + int(self.block.doc_symbols[doc])]
        rule = symbols - self.block.first_rule
        lengths = np.where(rule >= 0, self.block.expansion[np.maximum(rule, 0)] if len(self.block.rules) else 1, 1)
        ends = np.cumsum(lengths)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._write(symbols[a:b])[start - skipped : stop - skipped]


def encode_to_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, first_rule: int = 1 << 16,
                     block_tokens: int = 1 << 20, min_count: int = 32, rounds: int = 8) -> DataFrame:
    """The table of the file format, in ascending key order by shard and block; ``end_id`` closes each document.

    ``first_rule`` must be larger than any id of the tokenizer."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, before_words)
        shard = TaskContext.get().partitionId()
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = n_blocks = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, held, n_blocks
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            payload = to_bytes(compress(ids, sizes, first_rule, min_count, rounds))
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([n_blocks], pa.int32()), pa.array([keys], pa.list_(pa.int64())),
                pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                names=["shard", "block", "doc_ids", "n_tokens", "payload"])
            keys, parts, held, n_blocks = [], [], 0, n_blocks + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                for key, ids in zip(column(piece, "doc_id").to_pylist(), encoder.encode(column(piece, "text").to_pylist())):
                    keys.append(key)
                    parts.append(ids + tail)
                    held += len(ids) // 4 + 1
                    if held >= block_tokens:
                        yield flush()
        if keys:
            yield flush()

    # equal keys may be many: the hash of the text deals them to several shards
    ordered = texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    return ordered.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    encode_to_blocks(docs, tokenizer, **options).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def decode(blocks: DataFrame) -> DataFrame:
    """One row per document: shard, block, place, doc_id, local_start, n_tokens, ids (little-endian binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = from_bytes(row["payload"])
                raw = Expander(block).ids().astype("<u4").tobytes()
                ends = np.cumsum(block.doc_tokens)
                starts = ends - block.doc_tokens
                n = len(ends)
                for at in range(0, n, 2000):
                    to = min(n, at + 2000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["shard"]] * (to - at), pa.int32()), pa.array([row["block"]] * (to - at), pa.int32()),
                        pa.array(range(at, to), pa.int32()), pa.array(row["doc_ids"][at:to], pa.int64()),
                        pa.array(starts[at:to], pa.int64()), pa.array(block.doc_tokens[at:to], pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts[at:to].tolist(), ends[at:to].tolist())], pa.binary())],
                        names=["shard", "block", "place", "doc_id", "local_start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "shard int, block int, place int, doc_id long, local_start long, n_tokens long, ids binary")


def block_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each block.  One row per shard meets in one task, then one row per block in its shard."""
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return sizes.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("block_start"))


def digest(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all read from the files."""
    rows = decode(blocks).select("shard", "block", "doc_id", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(block_starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
