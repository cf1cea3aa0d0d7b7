"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample (``fit_on`` vectors) by k-means with a charge on large clusters. They are held in a graph:
each centroid knows its nearest ones and a few far ones, and a best-first search finds the centroids near a vector. Every
vector is listed at its nearest centroid, and, if it lies near a boundary, at others: those at most ``(1 + border)`` times as far, unless
a centroid already chosen is nearer to them than the vector is.  A query reads the lists whose centroids are at most ``ratio``
times as far as the nearest, which counts as the median such distance at least (a group of copies is its own centroid); the ratio is the smallest that finds ``recall`` of the true neighbours within the sample.  The search for
them holds 64 centroids, and four times as many as long as all it holds lie within the ratio.  A query that so gets fewer neighbours
than asked for reads its next lists, four times as many in each turn, until it has them or has read all lists.

Lists near each other make a zone of ``part`` rows; a longer list is dealt over several zones, so none is read whole by one task.
A query goes to a zone once, with the names of the lists that it reads there, and its k nearest in the zone come back.  Zones
serve queries in lanes, so no group holds all queries.

Distances are Euclidean, in double precision, on the original vectors.

Nulls and oddities: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another length than
the most frequent one or rows without a key; rows that share a key are one candidate, by its nearest vector, and no candidate for that
key's query; with fewer candidates than asked for, all are returned; ties go to the smaller key; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emulon.llm.common import column, ranges
from emulon.llm.vectors import matrix, sample, usable
from emulon.runtime import cut_lineage, opened, share


class Index(NamedTuple):
    centroids: np.ndarray
    graph: np.ndarray  # (centroids, neighbours)
    border: float
    ratio: float
    copies: int
    scale: float = 0.0  # a nearest centroid counts as this far at least

    def near(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` centroids that best-first search in the graph finds for each vector, and their distances, nearest first.

        All vectors walk at once: each expands its nearest centroid not yet expanded, until there is none."""
        n, k = len(vectors), len(self.centroids)
        beam = min(beam, k)
        norms = (self.centroids**2).sum(axis=1)
        if 2 * beam >= k:  # a walk would see nearly all
            far = norms - 2 * vectors @ self.centroids.T + (vectors**2).sum(axis=1, keepdims=True)
            names = np.argsort(far, axis=1, kind="stable")
            return names[:, :beam], np.sqrt(np.maximum(0, np.take_along_axis(far, names, 1)))[:, :beam]
        rows = np.arange(n)
        start = np.unique(np.linspace(0, k - 1, min(k, beam, 8)).astype(int))
        held = np.full((n, beam), np.inf)
        names = np.full((n, beam), -1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, start] = True
        held[:, : len(start)] = norms[start] - 2 * vectors @ self.centroids[start].T
        names[:, : len(start)] = start
        open_ = np.isfinite(held)
        while True:
            nearest = np.where(open_, held, np.inf).argmin(axis=1)
            live = open_[rows, nearest]
            if not live.any():
                break
            r = rows[live]
            open_[r, nearest[live]] = False
            around = self.graph[names[r, nearest[live]]]
            fresh = ~seen[r[:, None], around]
            seen[r[:, None], around] = True
            to = np.where(fresh, norms[around] - 2 * np.einsum("rd,rgd->rg", vectors[r], self.centroids[around]), np.inf)
            all_d = np.concatenate([held[r], to], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            line = np.arange(len(r))[:, None]
            names[r] = np.concatenate([names[r], around], axis=1)[line, best]
            open_[r] = np.concatenate([open_[r], fresh], axis=1)[line, best]
            held[r] = all_d[line, best]
            open_ &= np.isfinite(held)
        order = np.argsort(held, axis=1, kind="stable")
        held, names = np.take_along_axis(held, order, 1), np.take_along_axis(names, order, 1)
        distance = np.sqrt(np.maximum(0, held + (vectors**2).sum(axis=1, keepdims=True)))
        return names, np.where(names >= 0, distance, np.inf)

    def lists(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector and list of each entry: the nearest centroid, and those across a near boundary."""
        names, distance = self.near(vectors, 4 * self.copies)
        chosen = [names[:, 0]]
        rows, where = [np.arange(len(vectors))], [names[:, 0]]
        taken = np.ones(len(vectors), dtype=int)
        for j in range(1, names.shape[1]):
            ok = (distance[:, j] <= (1 + self.border) * distance[:, 0]) & (taken < self.copies) & (names[:, j] >= 0)
            for other in chosen:
                gap = np.linalg.norm(self.centroids[names[:, j]] - self.centroids[np.maximum(other, 0)], axis=1)
                ok &= (other < 0) | (gap >= distance[:, j])
            rows.append(np.flatnonzero(ok))
            where.append(names[ok, j])
            taken += ok
            chosen.append(np.where(ok, names[:, j], -1))
        return np.concatenate(rows), np.concatenate(where)

    def probes(self, vectors: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Vector and list of each visit: those within the ratio, or, in a further turn, only those not read in the turns before."""
        if not turn:
            rows, lists, beam, left = [], [], 64, np.arange(len(vectors))
            while len(left):
                names, distance = self.near(vectors[left], beam)
                inside = (names >= 0) & (distance <= self.ratio * np.maximum(self.scale, distance[:, :1]))
                more = inside.all(axis=1) & (beam < len(self.centroids))
                who, places = np.nonzero(inside & ~more[:, None])
                rows.append(left[who])
                lists.append(names[who, places])
                left, beam = left[more], 4 * beam
            return np.concatenate(rows), np.concatenate(lists)
        names, distance = self.near(vectors, len(self.centroids))
        first = (distance <= self.ratio * np.maximum(self.scale, distance[:, :1])).sum(axis=1, keepdims=True)  # they are sorted
        place = np.arange(names.shape[1])
        start, end = (np.maximum(4, first) * 4**t if t else first for t in (turn - 1, turn))
        rows, places = np.nonzero((place >= start) & (place < end) & (names >= 0))
        return rows, names[rows, places]

    def unread(self, turn: int) -> bool:
        """Whether some list may be left for this turn."""
        return (4**turn if turn > 1 else 1) < len(self.centroids)


def balanced_means(vectors: np.ndarray, k: int, turns: int = 12, seed: int = 5) -> np.ndarray:
    """k-means whose clusters pay for being larger than the mean."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), k, replace=False)]
    charge = np.zeros(k)
    for _ in range(turns):
        far = (centroids**2).sum(axis=1) - 2 * vectors @ centroids.T
        own = (far + charge).argmin(axis=1)
        sizes = np.bincount(own, minlength=k)
        spread = far.std() / 4
        charge += spread * (sizes * k / len(vectors) - 1) * 0.1
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], vectors[rng.choice(len(vectors), k)])
    return centroids


def build(vectors: np.ndarray, n: int, list_rows: int, k: int, recall: float, border: float, copies: int, links: int) -> Index:
    """The index from the sample, for a table of ``n`` vectors; at most a sixteenth of the sample become centroids."""
    lists = int(min(max(1, n // list_rows), max(1, len(vectors) // 16)))
    centroids = balanced_means(vectors, lists)
    far = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2) if lists <= 512 else (
        (centroids**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * centroids @ centroids.T)
    nearest = np.argsort(far, axis=1, kind="stable")[:, 1 : links + 1] if lists > 1 else np.zeros((1, 1), int)
    ring = (np.arange(lists)[:, None] + np.array([1, max(1, lists // 3), max(1, lists // 2)])) % lists  # keeps the graph in one piece
    index = Index(centroids, np.concatenate([nearest, ring], axis=1), border, 1.0, copies)
    asked = vectors[:: max(1, len(vectors) // 200)]
    entry, where = index.lists(vectors)
    order = np.argsort(entry, kind="stable")
    starts, entry, where = np.searchsorted(entry[order], np.arange(len(vectors) + 1)), entry[order], where[order]
    needs = []  # the ratio at which each true neighbour is first reached
    names, distance = index.near(asked, lists)
    scale = float(np.median(distance[:, 0])) if len(asked) else 0.0
    for q, near, far in zip(asked, names, distance):
        wanted = np.argsort(((vectors - q) ** 2).sum(axis=1), kind="stable")[1 : k + 1]
        of = np.empty(lists)
        least = max(scale, far[0])
        of[near] = far / least if least > 0 else np.where(far > 0, 1e9, 1.0)
        needs += [of[where[starts[w] : starts[w + 1]]].min() for w in wanted]
    needs.sort()
    ratio = needs[max(0, int(np.ceil(recall * len(needs))) - 1)] if needs else 1.0
    return index._replace(ratio=max(1.0, ratio) * (1 + 1e-9), scale=scale)


def neighbourly(centroids: np.ndarray) -> np.ndarray:
    """An order of the centroids in which near ones are near: halves along the direction of the largest spread, again and again."""
    done, open_ = [], [np.arange(len(centroids))]
    while open_:
        own = open_.pop()
        if len(own) < 3:
            done.append(own)
            continue
        x = centroids[own]
        along = own[np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")]
        open_ += [along[len(own) // 2 :], along[: len(own) // 2]]
    return np.concatenate(done)


def zones_of(sizes: np.ndarray, order: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """First zone and number of zones of each list; several lists share a zone, or a list has several for itself."""
    first, count = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    zone, held = 0, 0
    for i in order:
        if held and held + sizes[i] > part:
            zone, held = zone + 1, 0
        first[i], held = zone, held + sizes[i]
        if held > part:
            count[i] = -(-held // part)
            zone, held = zone + count[i], 0
    return first, count


def search(table: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", fit_on: int = 8_000,
           list_rows: int = 256, recall: float = 0.97, border: float = 0.1, copies: int = 4, links: int = 24, part: int = 16_384,
           lane: int = 200_000) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row where ``queries`` holds."""
    rows = table.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                        F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    found = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return table.sparkSession.createDataFrame([], found)
    rows = rows.where(F.size("v") == sizes[0]["size"])
    index = build(sample(rows, "v", fit_on), sizes[0]["count"], list_rows, k, recall, border, copies, links)
    shared = share(table.sparkSession, index)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield (piece := batch.slice(at, 1024)), matrix(column(piece, "v"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = opened(shared)
        for piece, x in pieces(batches):
            who, where = own.lists(x)
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), column(piece, "vec_id").take(take), column(piece, "v").take(take)],
                                             names=["list", "vec_id", "v"])

    postings = cut_lineage(rows.select("vec_id", "v").mapInArrow(enter, "list int, vec_id long, v array<double>"))
    asking = rows.where("asks").select("vec_id", "v")
    lanes = max(1, -(-asking.count() // lane))
    counted = np.zeros(len(index.centroids), dtype=np.int64)
    for r in postings.groupBy("list").count().collect():  # at most one row a centroid
        counted[r["list"]] = r["count"]
    first, count = zones_of(counted, neighbourly(index.centroids), part)
    shared_zones = share(table.sparkSession, (first, count))
    dealt = table.sparkSession.createDataFrame([(i, int(f), int(c)) for i, (f, c) in enumerate(zip(first, count))], "list int, first int, zones int")
    homes = postings.join(F.broadcast(dealt), "list").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("zones"))).cast("int").alias("zone"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "list", "vec_id", "v").groupBy("zone", "lane")

    def nearest(listed: pa.Table, visiting: pa.Table) -> pa.Table:
        """The k nearest keys in this zone for each visiting query, from the lists that it reads."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if listed.num_rows and visiting.num_rows:
            order = np.argsort(listed.column("vec_id").to_numpy(), kind="stable")
            ids, x = listed.column("vec_id").to_numpy()[order], matrix(listed.column("v"))[order]
            list_names, list_of = np.unique(listed.column("list").to_numpy()[order], return_inverse=True)
            keys, starts = np.unique(ids, return_index=True)  # rows that share a key are one candidate
            norms, askers = (x**2).sum(axis=1), visiting.column("vec_id").to_numpy()
            for at in range(0, len(askers), 128):
                some = visiting.slice(at, 128)
                q, lists_read = matrix(some.column("v")), some.column("lists").to_pylist()
                square = (q**2).sum(axis=1)
                rough = norms - 2 * q @ x.T + square[:, None]
                for i, asker in enumerate(askers[at : at + 128]):
                    far = np.where(np.isin(list_names, lists_read[i])[list_of] & (ids != asker), rough[i], np.inf)
                    of_key = np.minimum.reduceat(far, starts)
                    least = np.partition(of_key, min(k, len(keys)) - 1)[min(k, len(keys)) - 1]
                    near = np.flatnonzero((far <= least + 1e-9 * (norms.max() + square[i])) & np.isfinite(far))
                    d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                    near, d = near[by := np.lexsort((d, ids[near]))], d[by]
                    once = np.unique(ids[near], return_index=True)[1]
                    once = once[np.lexsort((ids[near[once]], d[once]))][:k]
                    out.append((np.full(len(once), asker), ids[near[once]], d[once]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    def visit(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Index = opened(shared)
            first, count = opened(shared_zones)
            for piece, x in pieces(batches):
                who, where = own.probes(x, turn)
                times = count[where]
                zone, who, where = ranges(first[where], times), np.repeat(who, times), np.repeat(where, times)
                order = np.lexsort((where, zone, who))
                zone, who, where = zone[order], who[order], where[order]
                starts = np.flatnonzero(np.diff(zone, prepend=-1) | np.diff(who, prepend=-1))
                take = pa.array(who[starts])
                lists_read = pa.ListArray.from_arrays(pa.array(np.append(starts, len(who)).astype(np.int32)), pa.array(where.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(zone[starts].astype(np.int32)), column(piece, "vec_id").take(take),
                                                  column(piece, "v").take(take), lists_read], names=["zone", "vec_id", "v", "lists"])
        return run

    def read(who: DataFrame, turn: int) -> DataFrame:
        """query_id, vec_id, score: the neighbours in the lists of a turn."""
        visits = who.mapInArrow(visit(turn), "zone int, vec_id long, v array<double>, lists array<int>").withColumn(
            "lane", F.pmod(F.xxhash64("vec_id"), F.lit(lanes)).cast("int"))
        return homes.cogroup(visits.groupBy("zone", "lane")).applyInArrow(nearest, "query_id long, vec_id long, score double")

    def best(near: DataFrame) -> DataFrame:
        once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # a vector may stand in several lists
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        return cut_lineage(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    have, turn = best(read(asking, 0)), 1
    while index.unread(turn):
        full = have.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        short = asking.join(full, "vec_id", "left_anti")
        if not short.limit(1).count():
            break
        have = best(have.drop("rank").unionByName(read(short, turn)))
        turn += 1
    return have
