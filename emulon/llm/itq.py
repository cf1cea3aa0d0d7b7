"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors are rotated so that the signs of their components make balanced binary codes close to the vectors themselves; the
rotation is learned on a bounded sample (``fit_on`` vectors).  Codes of up to 64 bits are cut in ``tables`` equal substrings.
Each vector enters, for each table, the buckets of its substring and of those one bit away, so two vectors meet in some
bucket of a table if their substrings differ in two bits at most; hence all pairs within 3 * tables - 1 bits meet, and most
beyond.  A pair is taken from one bucket only: the first table and the smallest bucket where it meets.  Then the original
vectors decide by their cosine in double precision: no link below the threshold is kept.

Equal vectors of a label are one point with a count.  A bucket of more than ``part`` points is searched in parts: its points are
dealt over them, and all of them visit each part.  Links are pairs of different vectors; groups come from alternating stars.

Nulls and oddities: a null label, or a vector that is null, zero, or has null or non-finite components, links with nothing and is
its own component; vectors of different lengths do not link; a null key counts as a vector but is no component's smallest key
unless it is alone; repeated rows link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.llm.common import column, ranges
from emulon.llm.components import components
from emulon.llm.vectors import by_length, matrix, sample, usable
from emulon.runtime import cut_lineage, opened, share


STACK = 8  # bits of the buckets that share a group, where they are small
FEW = 256  # members of a bucket whose pairs are laid out at once
PAIRS = 1 << 20  # pairs laid out at once, at most


def learn_rotation(vectors: np.ndarray, bits: int = 64, turns: int = 40) -> np.ndarray:
    """A (components x bits) map whose signs are the code: principal directions, then the rotation that ITQ finds."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    centred = unit - unit.mean(axis=0) if len(unit) > 1 else unit
    _, directions = np.linalg.eigh(centred.T @ centred)  # components by components, whatever the sample's size
    directions = directions[:, ::-1][:, : min(bits, vectors.shape[1])]
    projected = unit @ directions
    rng = np.random.default_rng(8)
    rotation, _ = np.linalg.qr(rng.standard_normal((directions.shape[1],) * 2))
    for _ in range(turns):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ projected)
        rotation = (left @ right).T
    return directions @ rotation


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    signs = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation >= 0
    padded = np.zeros((len(signs), 64), dtype=np.uint8)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def _substrings(codes: np.ndarray, tables: int) -> np.ndarray:
    width = 64 // tables
    return np.stack([(codes >> np.uint64(width * t)) & np.uint64((1 << width) - 1) for t in range(tables)], axis=1).astype(np.int64)


def _meet(home: np.ndarray, visit: np.ndarray, bucket: int, table: int, tables: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (home, visitor) whose one bucket this is, codes at most ``far`` bits apart."""
    rows, columns = [], []
    step = max(1, (1 << 20) // max(1, len(home)))
    for at in range(0, len(visit), step):
        some = slice(at, at + step)
        near = np.bitwise_count(home[:, None] ^ visit[None, some]) <= far
        i, j = np.nonzero(near)
        j = j + at
        own = _theirs(home[i], visit[j], np.int64(bucket), table, tables, far)
        rows.append(i[own])
        columns.append(j[own])
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(columns) if columns else np.zeros(0, int)


def _theirs(a: np.ndarray, b: np.ndarray, bucket: np.ndarray, table: int, tables: int, far: int) -> np.ndarray:
    """Which pairs of codes that share a bucket belong to it: near enough, and met nowhere before."""
    one, other = _substrings(a, tables), _substrings(b, tables)
    good = np.bitwise_count(a ^ b) <= far
    for t in range(table):  # an earlier table has them
        good &= np.bitwise_count((one[:, t] ^ other[:, t]).astype(np.uint64)) > 2
    x, y = one[:, table], other[:, table]
    differ = x ^ y
    apart, low = np.bitwise_count(differ.astype(np.uint64)), differ & -differ
    first = np.where(apart == 0, x, np.where(apart == 1, np.minimum(x, y), np.minimum(x ^ low, y ^ low)))
    return good & (first == bucket)


def candidate_pairs(points: DataFrame, tables: int, far: int, part: int) -> DataFrame:
    """``a, b`` (a < b) of points ``node, label, size, code`` that meet, each pair once."""
    width = 64 // tables

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], 1 << np.arange(width)])
        for batch in batches:
            n = batch.num_rows
            codes = np.array(column(batch, "code").to_numpy(zero_copy_only=False)).view(np.uint64)
            sub = _substrings(codes, tables)
            buckets = (sub[:, :, None] ^ flips[None, None, :]).reshape(n, -1)
            repeat = np.repeat(np.arange(n), buckets.shape[1])
            table = np.tile(np.repeat(np.arange(tables), len(flips)), n)
            out = {c: column(batch, c).take(pa.array(repeat)) for c in ("space", "node", "code")}
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(table.astype(np.int32)), pa.array(buckets.ravel())],
                                             names=[*out, "tab", "bucket"])

    entered = points.select("space", "node", "code").mapInArrow(enter, "space long, node long, code long, tab int, bucket long")
    key = ["space", "tab", "bucket"]
    large = entered.groupBy(*key).count().where(F.col("count") > part).select(*key, F.ceil(F.col("count") / part).cast("int").alias("parts"))
    dealt = entered.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "home", F.pmod(F.xxhash64("node"), F.col("parts")) == F.col("part"))
    # most buckets are small: neighbours among them share a group, a large one has groups of its own
    dealt = dealt.withColumn("stack", F.when(F.col("parts") > 1, -1 - F.col("bucket")).otherwise(F.shiftright("bucket", STACK)))

    def search(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        sizes = np.diff(starts, append=len(order))
        if not (sizes > 1).any():
            return empty
        node = group.column("node").to_numpy()[order]
        code = group.column("code").to_numpy()[order].view(np.uint64)
        home = group.column("home").to_numpy()[order]
        bucket = bucket[order]
        table = group.column("tab")[0].as_py()
        found = []
        few = (sizes > 1) & (sizes <= FEW) & (group.column("parts")[0].as_py() == 1)
        rows = ranges(starts[few], sizes[few])
        after = np.repeat(starts[few] + sizes[few], sizes[few]) - 1 - rows  # partners that come later in the bucket
        for at in range(0, len(rows), PAIRS // FEW):
            some, n = rows[at : at + PAIRS // FEW], after[at : at + PAIRS // FEW]
            i, j = np.repeat(some, n), ranges(some + 1, n)
            good = _theirs(code[i], code[j], bucket[i], table, tables, far)
            found.append((i[good], j[good]))
        for start, size in zip(starts[(sizes > 1) & ~few], sizes[(sizes > 1) & ~few]):
            run = np.arange(start, start + size)
            own = run[home[run]]
            i, j = _meet(code[own], code[run], int(bucket[start]), table, tables, far)
            ahead = node[own[i]] < node[run[j]]
            found.append((own[i][ahead], run[j][ahead]))
        a, b = (np.concatenate([node[f[k]] for f in found]) for k in (0, 1))
        differ = a != b
        return pa.table({"a": np.minimum(a, b)[differ], "b": np.maximum(a, b)[differ]})

    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    return dealt.groupBy("space", "tab", "stack", "part").applyInArrow(search, "a long, b long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93,
                    tables: int = 4, far: int = 20, fit_on: int = 20_000, part: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = table.sparkSession
    rows = table.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"),
                        F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))  # no minus nought
    rows = rows.withColumn("good", usable(F.col("v")) & F.col("label").isNotNull())
    good = rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a point's number is its smallest key; points without any key get numbers of their own
    good = cut_lineage(good.withColumn("node", F.coalesce("least", F.xxhash64("label", "v"))).withColumn("space", F.xxhash64("label", F.size("v"))))
    lengths = sorted(r[0] for r in good.select(F.size("v")).distinct().collect())
    rotations = share(spark, {n: learn_rotation(s) for n in lengths if len(s := sample(good.where(F.size("v") == n), "v", fit_on))})

    @F.pandas_udf("long")
    def code(v: pd.Series) -> pd.Series:
        own, out = opened(rotations), np.zeros(len(v), dtype=np.uint64)
        sizes = v.map(len).to_numpy()
        for n in np.unique(sizes):
            out[sizes == n] = encode(np.stack(v[sizes == n].to_list()), own[int(n)])
        return pd.Series(out.view(np.int64))

    pairs = candidate_pairs(good.select("space", "node", code("v").alias("code")), tables, far, part)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.zeros(batch.num_rows)
            for rows, x in by_length(column(batch, "v_a")):
                y = matrix(column(batch, "v_b").take(pa.array(rows)))
                cosine[rows] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            kept = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(kept) for c in ("a", "b", "copies_a", "copies_b")],
                                             names=["a", "b", "copies_a", "copies_b"])

    sides = {s: good.select(F.col("node").alias(s), F.col("v").alias(f"v_{s}"), F.col("copies").alias(f"copies_{s}")) for s in "ab"}
    both = pairs.join(sides["a"], "a").join(sides["b"], "b").where(F.size("v_a") == F.size("v_b"))
    links = cut_lineage(both.mapInArrow(decide, "a long, b long, copies_a long, copies_b long"))
    counts = links.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).unionAll(links.select("b", "copies_a"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    points = good.join(counts, "node", "left").join(components(links.select("a", "b")), "node", "left").select(
        "label", "v", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    points = cut_lineage(points)
    least = points.groupBy("root").agg(F.min("least").alias("component_id"))
    points = points.join(least, "root").select("label", "v", "n_links", "component_id")
    linked = rows.where("good").join(points, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return linked.unionAll(rows.where("not good").select("vec_id", F.lit(0).cast("long"), "vec_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
