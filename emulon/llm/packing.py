"""Packing of documents into sequences of one capacity, shortest pack first over the length histogram.

A document's ids are cut into pieces: as many full ones as it has, and a rest.  The histogram of piece lengths has at
most ``capacity`` bars, so packing them is a small computation whatever the number of documents:
lengths are placed longest first, many pieces of a length at once, onto the packs with the most room.  The
outcome is a table of places: the pieces of rank a to b among those of their length go to these sequences,
at this offset.  Pieces join it by length and rank.

Nulls and oddities: a null text is empty, and its document is its end id alone; a null or repeated key is no
hindrance, each row is packed for itself; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emulon.llm.common import column, texts
from emulon.llm.tokens import Encoder, at_white_space
from emulon.runtime import cut_lineage, opened, share


class Places(NamedTuple):
    """Sorted by length and first rank; place i takes ranks from ``first_rank[i]`` up to the next place's."""

    length: np.ndarray
    first_rank: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> Places:
    """Where the pieces of each length go.

    Packs of the same content are one pattern with a count.  The next length goes to the pattern with the
    most room; if that has more packs than pieces are left, it is divided.
    """
    packs: list[tuple[int, int, int]] = []  # a heap by most room: (-room, first sequence, count)
    sequences = 0
    places: list[tuple[int, int, int, int]] = []
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit in {capacity}")
        rank, left = 0, histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, first, count = heapq.heappop(packs)
                used = min(count, left)
                if used < count:
                    heapq.heappush(packs, (room, first + used, count - used))
            else:  # nothing has room: new packs
                room, first, used = -capacity, sequences, left
                sequences += left
            places.append((length, rank, first, capacity + room))
            if -room > length:
                heapq.heappush(packs, (room + length, first, used))
            rank, left = rank + used, left - used
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 4)
    return Places(*table.T)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, and the piece's place among
    those of its length: a part (the task) and a rank in it, which hold once this is written."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, at_white_space)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                rows = []
                for key, ids in zip(column(piece, "doc_id").to_pylist(), encoder.encode(column(piece, "text").to_pylist())):
                    ids += tail
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        rows.append((key, start, length, ids[4 * start : 4 * (start + length)], total, part, rank))
                columns = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "rank_in_part"])

    return texts(docs).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, part int, rank_in_part long")


def pack(step: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to written pieces (columns length, part, rank_in_part; they are kept).

    Only the histogram, at most ``capacity`` rows, reaches the driver; the table of places depends on the
    capacity and not on the number of pieces.
    """
    counts = step.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = shortest_pack_first(histogram, capacity)
    shared = share(step.sparkSession, places)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = step.join(first, ["length", "part"]).withColumn("rank", F.col("first_rank") + F.col("rank_in_part"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        p = opened(shared)
        wide = int(max(p.first_rank.max(initial=0), ranks.max())) + 1
        i = np.searchsorted(p.length * wide + p.first_rank, lengths.to_numpy() * wide + ranks.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": p.first_sequence[i] + ranks.to_numpy() - p.first_rank[i], "offset": p.offset[i]})

    return ranked.withColumn("place", place("length", "rank")).select(
        *step.columns, F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def packed_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    cut = pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut_lineage(cut), capacity).drop("part", "rank_in_part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
