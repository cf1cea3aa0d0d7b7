"""Hard negatives by threshold joins on inner products, after the manner of L2AP.

Anchors look for the rows of largest inner product inside score windows.  Their positives are the first rows of their own label; each
positive opens a window, from ``low`` to ``high`` hundredths of its score, for rows of other labels.

A join has a threshold for each anchor.  Components are taken from those that weigh most in the anchors to those that weigh least.  The
inverted index of a batch of rows lists, per stretch of components, the rows with their values there, but omits a row's last
components if their norm times the longest anchor cannot reach any threshold.  Scores accumulate stretch by stretch; a pair is dropped as soon as
its partial score and the norms that remain fall short of the anchor's threshold.  What is left is scored exactly, in whole
numbers.  Thresholds are high at first, and rise as windows fill; anchors whose windows are not full come again with
lower ones, and at last with the window's own bound, so nothing is missed.

Anchors meet all rows in blocks of about ``block`` anchors; the rows of a block are dealt over ``lanes`` tasks, each of
which reads its rows as a stream and keeps no more than the first results of each window.

Nulls and oddities: rows without a key, label or vector, or with a null or non-finite component, take no part, nor do those whose components are so large that
scores may not fit a long; rows of different lengths do not meet; equal rows (key, label and vector) count once; rows that share a key but differ
are rows of their own, never partners of each other; ties go to the smaller key; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emulon.llm.common import column
from emulon.llm.vectors import matrix
from emulon.runtime import cut_lineage

STRETCH = 16  # components of one step
TOGETHER = 256  # anchors of one step
PAIRS = 1 << 16  # pairs scored exactly at once
FAR = 2**62  # beyond any score

FOUND = "anchor long, anchor_id long, place int, vec_id long, score long"


def whole_vectors(table: DataFrame, key: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, v: distinct rows that take part, components ``floor(scale * x)``."""
    rows = table.select(key.cast("long").alias("vec_id"), label.cast("string").alias("label"), vector.cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("x", lambda x: F.abs(x) * scale < F.sqrt(F.lit(float(FAR)) / F.greatest(F.size("x"), F.lit(1))) - 1)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & fits, F.lit(False)))
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


# ----------------------------------------------------------------------------- inside a task


class Anchors:
    """The anchors of a cell, their windows, and the first results of each."""

    def __init__(self, vectors: np.ndarray, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray,
                 owner: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.order = np.argsort(-(vectors.astype(float) ** 2).sum(axis=0), kind="stable")
        self.whole = vectors[:, self.order]
        self.vectors = self.whole.astype(float)
        self.numbers, self.ids, self.labels = numbers, ids, labels
        by = np.argsort(owner, kind="stable")
        self.owner, self.place, self.low, self.high = owner[by], place[by], low[by].copy(), high[by]
        self.first_window = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        self.k, self.same_label = k, same_label
        self.window, self.vec, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.cuts = np.arange(0, vectors.shape[1] + STRETCH, STRETCH)
        self.rest = self._rests(self.vectors)

    def _rests(self, x: np.ndarray) -> np.ndarray:
        """Norm of the components from each cut on; (cuts, rows)."""
        squares = x * x
        return np.sqrt(np.stack([squares[:, c:].sum(axis=1) for c in self.cuts]))

    def thresholds(self) -> np.ndarray:
        out = np.full(len(self.ids), FAR, dtype=np.int64)
        np.minimum.at(out, self.owner, self.low)
        return out

    def meet(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Take the rows of a batch into the windows."""
        whole = vectors[:, self.order]
        x = whole.astype(float)
        rest = self._rests(x)
        for at in range(0, len(self.ids), TOGETHER):
            some = slice(at, min(len(self.ids), at + TOGETHER))
            t = self.thresholds()[some].astype(float)
            # the index: rows stay listed up to the cut from which on their norm reaches no threshold
            reach = rest * self.rest[0, some].max(initial=0.0) * (1 + 1e-9) + 1
            listed = (reach >= t.min(initial=FAR)).sum(axis=0)  # norms shrink from cut to cut
            index = [np.flatnonzero(listed > c) for c in range(len(self.cuts) - 1)]
            touched = np.flatnonzero(listed > 0)
            if len(touched) == 0:
                continue
            i, j = self._join(some, t, x, rest, listed, index, touched, ids, labels)
            self._take(i + at, j, whole, ids)

    def _join(self, some: slice, t: np.ndarray, x: np.ndarray, rest: np.ndarray, listed: np.ndarray, index: list[np.ndarray],
              touched: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that may reach the anchor's threshold."""
        q, q_rest = self.vectors[some], self.rest[:, some]
        live = touched  # rows that some anchor may still want
        partial = np.zeros((len(q), len(live)))
        # partners of the kind asked for, never of the anchor's own key
        alive = (labels[live][None] == self.labels[some][:, None]) == self.same_label
        alive &= ids[live][None] != self.ids[some][:, None]
        for c, rows in enumerate(index):
            at = np.searchsorted(rows, live)
            has = np.flatnonzero((at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == live)) if len(rows) else np.zeros(0, int)
            cut = slice(self.cuts[c], self.cuts[c + 1])
            partial[:, has] += q[:, cut] @ x[live[has], cut].T
            left = np.minimum(c + 1, listed[live])  # the first cut that is not accumulated
            bound = partial + q_rest[left].T * rest[left, live] * (1 + 1e-9) + 1
            alive &= bound >= t[:, None]
            wanted = np.flatnonzero(alive.any(axis=0))
            if len(wanted) < 0.7 * len(live):
                live, partial, alive = live[wanted], partial[:, wanted], alive[:, wanted]
            if len(live) == 0:
                break
        i, j = np.nonzero(alive)
        return i, live[j]

    def _take(self, i: np.ndarray, j: np.ndarray, whole: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            score = np.einsum("ij,ij->i", self.whole[a], whole[b])
            n = self.first_window[a + 1] - self.first_window[a]
            w = np.repeat(self.first_window[a] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            s, vec = np.repeat(score, n), np.repeat(ids[b], n)
            good = (s >= self.low[w]) & (s <= self.high[w])
            self.window, self.vec, self.score = (np.concatenate(p) for p in (
                (self.window, w[good]), (self.vec, vec[good]), (self.score, s[good])))
            order = np.lexsort((self.vec, -self.score, self.window))
            w = self.window[order]
            rank = np.arange(len(w)) - np.searchsorted(w, w)
            order = order[rank < self.k]
            self.window, self.vec, self.score = self.window[order], self.vec[order], self.score[order]
            last = np.flatnonzero(rank[rank < self.k] == self.k - 1)  # full windows: only what is as good may enter
            self.low[self.window[last]] = np.maximum(self.low[self.window[last]], self.score[last])

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.window), 50_000):
            w = self.window[at : at + 50_000]
            a = self.owner[w]
            yield pa.RecordBatch.from_arrays([
                pa.array(self.numbers[a]), pa.array(self.ids[a]), pa.array(self.place[w].astype(np.int32)),
                pa.array(self.vec[at : at + 50_000]), pa.array(self.score[at : at + 50_000])],
                names=["anchor", "anchor_id", "place", "vec_id", "score"])


def _search(k: int, same_label: bool):
    """The task: in each cell anchors come before rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, anchors, names = None, [], None, {}

        def coded(labels: pa.Array) -> np.ndarray:
            kinds = labels.dictionary_encode()
            codes = np.array([names.setdefault(s, len(names)) for s in kinds.dictionary.to_pylist()], dtype=np.int64)
            return codes[kinds.indices.to_numpy()]

        def gathered() -> Anchors:
            table = pa.Table.from_batches(waiting).combine_chunks()
            windows = table.column("windows").combine_chunks()
            flat = windows.flatten()
            owner = np.repeat(np.arange(len(windows)), windows.value_lengths().to_numpy(zero_copy_only=False))
            return Anchors(_long_matrix(table.column("v").combine_chunks()), table.column("anchor").to_numpy(), table.column("vec_id").to_numpy(),
                           coded(table.column("label").combine_chunks()), owner,
                           *(flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("place", "low", "high")), k, same_label)

        for batch in batches:
            cells = column(batch, "cell").to_pylist()
            kinds = column(batch, "kind").to_numpy()
            ends = [i for i in range(1, len(cells)) if cells[i] != cells[i - 1] or kinds[i] != kinds[i - 1]] + [len(cells)]
            at = 0
            for end in ends if cells else []:
                if cells[at] != cell:
                    if anchors is not None:
                        yield from anchors.found()
                    cell, waiting, anchors, names = cells[at], [], None, {}
                part = batch.slice(at, end - at)
                if kinds[at] == 0:
                    waiting.append(part)
                elif waiting or anchors is not None:
                    if anchors is None:
                        anchors, waiting = gathered(), []
                    for lo in range(0, part.num_rows, 4096):
                        some = part.slice(lo, 4096)
                        anchors.meet(_long_matrix(column(some, "v")), column(some, "vec_id").to_numpy(), coded(column(some, "label")))
                at = end
        if anchors is not None:
            yield from anchors.found()

    return run


def _long_matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) and len(vectors.flatten()) else np.zeros((len(vectors), 0), dtype=np.int64)


# ----------------------------------------------------------------------------- joins


def _first(rows: DataFrame, windows: DataFrame, k: int, same_label: bool, block: int, lanes: int) -> DataFrame:
    """The first ``k`` rows of each window (see ``FOUND``) of ``anchor, vec_id, label, v, windows``."""
    blocks = -(-max(1, windows.count()) // block)
    space = [F.size("v").cast("string")]

    def cell(lane: Column, part: Column) -> Column:
        return F.concat_ws(" ", *space, part.cast("string"), lane.cast("string"), *([F.col("label")] if same_label else []))

    none = F.lit(None)
    asked = windows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(
        cell(F.col("lane"), F.pmod(F.xxhash64("anchor"), F.lit(blocks))).alias("cell"), F.lit(0).alias("kind"), "anchor", "vec_id", "label", "v", "windows")
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        cell(F.pmod(F.xxhash64("vec_id", "v"), F.lit(lanes)), F.col("part")).alias("cell"), F.lit(1).alias("kind"),
        none.cast("long").alias("anchor"), "vec_id", "label", "v", none.cast(windows.schema["windows"].dataType).alias("windows"))
    both = asked.unionByName(dealt).repartition("cell").sortWithinPartitions("cell", "kind")
    found = both.mapInArrow(_search(k, same_label), FOUND)
    rank = F.row_number().over(W.partitionBy("anchor", "anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def threshold_join(rows: DataFrame, windows: DataFrame, k: int, same_label: bool, starts: tuple[float, ...], block: int, lanes: int) -> DataFrame:
    """anchor, anchor_id, place, rank, vec_id, score: the first ``k`` rows of each window, highest scores first.

    ``windows`` is a table ``anchor, vec_id, label, v, windows``, these an array of ``place, low, high, start``.  Thresholds begin at the share
    ``starts`` of ``start``, one share a round, and end at ``low``; a round asks only for windows not yet full."""
    out = None
    for share in (*starts, None):
        tried = windows if share is None else windows.withColumn("windows", F.transform("windows", lambda w: F.struct(
            w["place"].alias("place"), F.greatest(w["low"], F.ceil(w["start"] * F.lit(share)).cast("long")).alias("low"), w["high"].alias("high"), w["start"].alias("start"))))
        found = cut_lineage(_first(rows, tried, k, same_label, block, lanes))
        if share is not None:
            full = found.groupBy("anchor", "anchor_id", "place").agg(F.count("*").alias("n")).where(F.col("n") == k).drop("n")
            found = found.join(full, ["anchor", "anchor_id", "place"], "left_semi")
            filled = full.groupBy("anchor", F.col("anchor_id").alias("vec_id")).agg(F.collect_set("place").alias("filled"))
            windows = windows.join(filled, ["anchor", "vec_id"], "left").withColumn("windows", F.filter(
                "windows", lambda w: ~F.coalesce(F.array_contains("filled", w["place"]), F.lit(False)))).drop("filled")
            windows = cut_lineage(windows.where(F.size("windows") > 0))
        out = found if out is None else out.unionByName(found)
    return out


def _window(place: Column, low: Column, high: Column, start: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), low.cast("long").alias("low"), high.cast("long").alias("high"), start.cast("long").alias("start"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         block: int = 16_384, lanes: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for ``vec_id, label, v`` (see ``whole_vectors``).

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's, both included."""
    rows = cut_lineage(rows)
    anchors = cut_lineage(rows.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "v")))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    own = anchors.withColumn("windows", F.array(_window(F.lit(1), F.lit(-FAR), F.lit(FAR), square)))
    first = cut_lineage(threshold_join(rows, own, positives, True, (0.5,), block, lanes).select(
        "anchor", "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole-number bounds of low * positive <= 100 * negative <= high * positive; none for a negative score
    score = F.col("positive_score").cast("decimal(38,0)")
    least, most = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    opened = first.where("positive_score >= 0").groupBy("anchor", F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(_window(F.col("place"), least, most, most)).alias("windows"))
    asked = cut_lineage(anchors.join(opened, ["anchor", "vec_id"]))
    found = threshold_join(rows, asked, negatives, False, (0.75,), block, lanes)
    return found.join(first, ["anchor", "anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
