"""SimHash near-duplicates, found exactly by vantage-point trees.

A fingerprint has 64 bits; two link if they differ in at most ``max_bits``.  Equal fingerprints are one point.

The upper levels of the tree are shared by all tasks.  Level l measures the Hamming distance to a vantage point
over the l-th block of 16 bits, and each distance is a branch.  By the triangle inequality the distances of two
points to a vantage point differ by no more than the points do, and as the blocks are disjoint these
differences add up: branches whose distances differ by more than ``max_bits`` in total hold no links.  A
leaf of these levels is a shard.  Each point goes to its own shard, and as a query to those smaller shards that the
bound leaves: the boundary-overlapping ones.  The levels used, two to four, follow from the measured
sizes of the shards; a shard that is still large is dealt in parts.

Inside a shard a binary tree goes on: a vantage point from the shard, the median distance, and each half is searched by
the queries that come within ``max_bits`` of it.  Small leaves are compared in full.  A task returns no pairs but a
forest over its links, so a group of many near copies gives one row per member.

Nulls and oddities: a null or empty text, or one of white space only, has fingerprint zero and links like any
other; a null key counts as the largest when the smallest key of a component is sought; repeated rows fall in one
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulon.llm.common import column, spare, whole
from emulon.llm.components import components
from emulon.runtime import cut_lineage, opened, share

BLOCK = 16
LEVELS = 64 // BLOCK
#: Vantage points of the shared levels: any constant serves.
VANTAGE = 0x5BD1E995A3C59AC3
SHARD = 200_000  # points of a shard aimed at
LEAF = 1 << 21  # pairs compared in full


def fingerprint(texts: list[str], shingle: int) -> np.ndarray:
    """SimHash of each whole text: XXH64 (seed 42) of its word shingles, a bit set if it is in over half of them."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - 1].tolist()]
        stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 50_000):
            hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 50_000], stops[at : at + 50_000])], dtype="<u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(text: Column, shingle: int) -> Column:
    """The 64 bits, as a long, of each whole text."""

    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprint(texts.to_list(), shingle).view(np.int64))

    return bits(whole(text))


def distances(bits: np.ndarray) -> np.ndarray:
    """Distance to the vantage point of each shared level, one column per level."""
    differ = bits.view(np.uint64) ^ np.uint64(VANTAGE)
    return np.stack([np.bitwise_count((differ >> np.uint64(BLOCK * b)) & np.uint64(2**BLOCK - 1)) for b in range(LEVELS)],
                    axis=1).astype(np.int32)


def _shard(levels: np.ndarray, used: int) -> np.ndarray:
    number = np.zeros(len(levels), dtype=np.int32)
    for level in range(used):
        number = number * (BLOCK + 1) + levels[:, level]
    return number


class Shards:
    """The levels used, the non-empty shards and the parts of large ones: at most 17**4 numbers."""

    def __init__(self, sizes: dict[tuple[int, ...], int], max_bits: int, target: int):
        for used in range(2, LEVELS + 1):
            shards: dict[tuple[int, ...], int] = {}
            for branch, n in sizes.items():
                shards[branch[:used]] = shards.get(branch[:used], 0) + n
            if max(shards.values(), default=0) <= target:
                break
        self.used = used
        names = np.array(sorted(shards), dtype=np.int32).reshape(-1, used)
        self.parts = np.zeros((BLOCK + 1) ** used, dtype=np.int32)
        self.parts[_shard(names, used)] = [-(-shards[tuple(s)] // target) for s in names.tolist()]
        self.steps = [s for s in itertools.product(range(-max_bits, max_bits + 1), repeat=used)
                      if sum(map(abs, s)) <= max_bits and s <= (0,) * used]

    def deal(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """shard, part, bits, whether a point is at home there."""
        levels = distances(bits)[:, : self.used]
        mixed = (bits.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for step in self.steps:
            there = levels + np.array(step, dtype=np.int32)
            valid = ((there >= 0) & (there <= BLOCK)).all(axis=1)
            own, number = bits[valid], _shard(there[valid], self.used)
            parts = self.parts[number]
            home = not any(step)
            place = mixed[valid] % np.maximum(parts, 1)
            for part in range(int(parts.max(initial=0))):
                goes = (parts > part) & ((place >= part) if home else True)  # at home: earlier parts, as a query
                yield number[goes], np.full(int(goes.sum()), part, np.int32), own[goes], (place[goes] == part) & home


def forest(points: np.ndarray, queries: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest over all links between points and (points or queries): pairs (node, root)."""
    everyone = np.concatenate([points, queries])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def full(p: np.ndarray, q: np.ndarray) -> None:
        width = max(1, LEAF // len(p))
        for at in range(0, len(q), width):
            part = q[at : at + width]
            near = np.bitwise_count(p[:, None] ^ part[None, :]) <= max_bits
            near &= p[:, None] != part[None, :]
            if not near.any():
                continue
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            near = near[np.ix_(rows, columns)]
            label = np.arange(len(rows))  # the smallest row that a row reaches inside this block
            while True:
                over = np.where(near, label[:, None], len(rows)).min(axis=0)
                new = np.minimum(label, np.where(near, over[None, :], len(rows)).min(axis=1))
                if (new == label).all():
                    break
                label = new
            heads = p[rows]
            for x, y in itertools.chain(zip(heads.tolist(), heads[label].tolist()), zip(part[columns].tolist(), heads[over].tolist())):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)

    todo = [(points, everyone)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) * len(q) > LEAF and len(p) > 64:
            vantage = p[len(p) // 2]
            to_p, to_q = np.bitwise_count(p ^ vantage).astype(np.int16), np.bitwise_count(q ^ vantage).astype(np.int16)
            middle = int(np.median(to_p))
            if middle == to_p.max():
                middle -= 1
            inside = to_p <= middle
            if inside.any() and not inside.all():
                todo.append((p[inside], q[to_q <= middle + max_bits]))
                todo.append((p[~inside], q[to_q > middle - max_bits]))
                continue
        full(p, q)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def link_points(points: DataFrame, max_bits: int = 4, shard: int = SHARD) -> DataFrame:
    """``bits, root`` for every point (column bits, distinct, written) that links to another one."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = distances(np.array(column(batch, "bits").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(levels[:, b]) for b in range(LEVELS)], names=names)

    names = [f"d{b}" for b in range(LEVELS)]
    sizes = points.select("bits").mapInArrow(measure, ", ".join(f"{n} int" for n in names)).groupBy(*names).count()
    shards = Shards({tuple(r)[:-1]: r["count"] for r in sizes.collect()}, max_bits, shard)
    shared = share(points.sparkSession, shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Shards = opened(shared)
        for batch in batches:
            bits = np.array(column(batch, "bits").to_numpy(zero_copy_only=False))
            for at in range(0, len(bits), 4096):
                found = [np.concatenate(c) for c in zip(*own.deal(bits[at : at + 4096]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["shard", "part", "bits", "home"])

    def search(group: pa.Table) -> pa.Table:
        bits = np.array(group.column("bits").to_numpy()).view(np.uint64)
        home = np.array(group.column("home").to_numpy())
        pairs = forest(bits[home], bits[~home], max_bits)
        sides = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": sides[:, 0], "b": sides[:, 1]})

    dealt = points.select("bits").mapInArrow(deal, "shard int, part int, bits long, home boolean")
    links = dealt.groupBy("shard", "part").applyInArrow(search, "a long, b long")
    return components(links).select(F.col("node").alias("bits"), "root")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row."""
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), fingerprints(F.col("`text`"), shingle).alias("bits"))
    return group_rows(cut_lineage(rows), max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def group_rows(rows: DataFrame, max_bits: int) -> DataFrame:
    """Adds component_id to written rows of doc_id and bits."""
    points = cut_lineage(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = link_points(points, max_bits)
    rooted = points.join(linked, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("bits", "component_id")
    return rows.join(known, "bits")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, of each group of near copies only the row of the smallest key (null: last).

    Of rows that share it, the one read first stays."""
    bits, number = spare(docs, "__bits"), spare(docs, "__row")
    rows = docs.withColumns({bits: fingerprints(F.col(f"`{text}`"), shingle), number: F.monotonically_increasing_id()})
    rows = cut_lineage(rows)
    order = F.struct(F.col(f"`{key}`").isNull().alias("last"), F.col(f"`{key}`").alias("key"), F.col(number).alias("row"))
    points = cut_lineage(rows.groupBy(F.col(bits).alias("bits")).agg(F.min(order).alias("least")))
    linked = link_points(points, max_bits)
    rooted = points.join(linked, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(number))
    return rows.join(stay, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
