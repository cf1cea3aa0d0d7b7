"""Exact k-nearest-neighbour search over blocks of nearby points.

Rows with equal coordinates are first collapsed into one location with a number of
copies, so a point held by a third of the rows is a single location.  Locations are
dealt to the leaves of a k-d tree whose cuts come from a bounded sample, below which
trees are grown in tasks (samples only decide where blocks end, never which neighbours
are found).  A query descends a tree of boxes to the nearest blocks; the distance of its k-th neighbour there is a radius, and
every other block whose box comes within that radius is visited in a second step.  Boxes
without a point that has the coordinate sought are never visited.  Blocks
with many queries or many points are cut into parts, so no task holds an unbounded
group, and a task emits only the neighbours it can contribute, never all pairs.

Missing coordinates (NaN) are left out of a distance, which is then scaled up by the
share of coordinates that were present on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulon.functions.columns import as_double, no_nan, number, quoted
from emulon.runtime import cut_lineage, opened, share

BLOCK_ROWS = 4096  # locations aimed at per block
UPPER_DEPTH = 14  # levels of cuts from a sample on the driver; deeper ones are grown in tasks
INDEX_NUMBERS = 16_000_000  # numbers in the boxes of all blocks, at most
FAN = 8  # boxes under one of the next level
BEAM = 4  # boxes of a level followed for the first radius
ROUTED = 1024  # queries that descend together
MAX_PATTERNS = 16  # blocks per leaf, by which coordinates are missing
SAMPLE_PER_LEAF = 24  # sampled locations that place the cuts
PART_ROWS = 16_384  # points or queries of one block in one task
CELLS = 500_000  # distances held at a time inside a task: a few megabytes, near a core's cache
HOT_LOCATIONS = 1000  # at most this many locations are broadcast
HOT_COPIES = 1000  # a location with fewer rows is never hot


def coordinates(columns: Sequence[str]) -> Column:
    """The columns as one array, missing values as NaN so that equal rows group together."""
    return F.expr(f"array({', '.join(f'coalesce({as_double(c)}, {number(math.nan)})' for c in columns)})")


def locations(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Distinct coordinates ``x`` with their smallest key ``id`` and number of ``copies``."""
    points = df.select(F.col(key).alias("id"), coordinates(columns).alias("x"))
    return points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def attach_by_location(rows: DataFrame, table: DataFrame, total: int, on: str = "x") -> DataFrame:
    """Join rows to their location.  Hot locations (a bounded number, since each holds at
    least 1/1000 of the rows) are broadcast, all others are joined by shuffle."""
    hot_copies = max(total // HOT_LOCATIONS, HOT_COPIES)
    hot = F.broadcast(table.where(F.col("copies") >= hot_copies).drop("copies"))
    rest = table.where(F.col("copies") < hot_copies).drop("copies")
    if total < hot_copies:
        return rows.join(rest, on)
    cold_rows = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(cold_rows.join(rest, on))


# ----------------------------------------------------------------------------- block index


@dataclass
class Boxes:
    """Boxes of points, one a row: those of blocks, or of ``FAN`` neighbouring boxes each."""

    low: np.ndarray
    high: np.ndarray
    always: np.ndarray  # coordinate present in every point of the box
    ever: np.ndarray  # coordinate present in some point
    present: np.ndarray  # points with the coordinate
    rows: np.ndarray

    def merged(self) -> Boxes:
        """Boxes around each ``FAN`` that follow one another."""
        at = np.arange(0, len(self.rows), FAN)
        return Boxes(*(how.reduceat(cells, at, axis=0) for how, cells in (
            (np.minimum, self.low), (np.maximum, self.high), (np.logical_and, self.always), (np.logical_or, self.ever),
            (np.add, self.present), (np.add, self.rows))))

    def usable(self, target: int | None) -> np.ndarray:
        """Points that can be found for a target: those that have the coordinate."""
        return self.rows if target is None else self.present[:, target]

    def bounds(self, x: np.ndarray, q: np.ndarray, box: np.ndarray, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of a query and a box, a lower bound of the distance to any of its points (infinite where they share no
        coordinate), and an upper bound of the distance to all of them (infinite where one may share none)."""
        near, most, far, shared, sure = (np.zeros(len(q)) for _ in range(5))
        for d in range(x.shape[1]):
            value = x[q, d]
            here = ~np.isnan(value) & self.ever[box, d]
            low, high = self.low[box, d], self.high[box, d]
            always = here & self.always[box, d]
            with np.errstate(invalid="ignore"):
                near += np.where(always, np.maximum(np.maximum(low - value, value - high), 0.0), 0.0) ** 2
                gap = np.where(here, np.maximum(value - low, high - value), 0.0) ** 2
            far, most = far + gap, np.maximum(most, gap)
            shared += here
            sure += always
        if scaled:
            near *= x.shape[1] / np.maximum(shared, 1.0)
            far = most * x.shape[1]
        near, far = np.sqrt(near) * (1 - 1e-9), np.sqrt(far) * (1 + 1e-9)
        return np.where(shared > 0, near, np.inf), np.where(sure > 0, far, np.inf)


@dataclass
class BlockIndex:
    """A tree over the boxes of all blocks: level 0 has the blocks, each further level boxes around ``FAN`` of the one below."""

    blocks: np.ndarray
    levels: list[Boxes]

    @staticmethod
    def over(blocks: np.ndarray, boxes: Boxes) -> BlockIndex:
        levels = [boxes]
        while len(levels[-1].rows) > FAN:
            levels.append(levels[-1].merged())
        return BlockIndex(blocks, levels)

    def descend(
        self, x: np.ndarray, scaled: bool, target: int | None, radius: np.ndarray, need: np.ndarray | None = None,
        beam: int | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, place of a block, lower bound) within each query's radius, of blocks that hold usable points.

        With ``need``, boxes beyond nearer ones that surely hold as many points are left out on the way; with ``beam``, all but
        so many of the nearest boxes of a level."""
        top = len(self.levels[-1].rows)
        q, box = np.repeat(np.arange(len(x)), top), np.tile(np.arange(top), len(x))
        for level in range(len(self.levels) - 1, -1, -1):
            if len(q) > CELLS and len(x) > 1:
                half = len(x) // 2
                parts = [self.descend(x[s], scaled, target, radius[s], None if need is None else need[s], beam)
                         for s in (slice(half), slice(half, None))]
                return (np.concatenate([parts[0][0], parts[1][0] + half]), *(np.concatenate(c) for c in list(zip(*parts))[1:]))
            boxes = self.levels[level]
            usable = boxes.usable(target)
            some = usable[box] > 0
            q, box = q[some], box[some]
            near, far = boxes.bounds(x, q, box, scaled)
            good = (near <= radius[q]) & np.isfinite(near)
            if need is not None:
                good &= near <= _reach_of(q, far, usable[box], need)[q]
            q, box, near = q[good], box[good], near[good]
            if beam is not None:
                order = np.lexsort((near, q))
                order = order[_running(q[order], np.ones(len(q), np.int64)) <= beam]
                q, box, near = q[order], box[order], near[order]
            if level:
                q, box = np.repeat(q, FAN), (box[:, None] * FAN + np.arange(FAN)).ravel()
                there = box < len(self.levels[level - 1].rows)
                q, box = q[there], box[there]
        return q, box, near

    def home(self, x: np.ndarray, scaled: bool, target: int | None, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest blocks that together hold ``need`` usable points of each query, as pairs."""
        leaves, anywhere = self.levels[0], np.full(len(x), np.inf)
        q, box, _ = self.descend(x, scaled, target, anywhere, need, BEAM)  # straight down, for a first radius
        _, far = leaves.bounds(x, q, box, scaled)
        q, box, near = self.descend(x, scaled, target, _reach_of(q, far, leaves.usable(target)[box], need), need)
        order = np.lexsort((box, near, q))
        q, box = q[order], box[order]
        usable = leaves.usable(target)[box]
        home = _running(q, usable) - usable < need[q]
        return q[home], box[home]


def _running(q: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """Running sums within each run of equal ``q``."""
    total = np.cumsum(amounts)
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    return total - np.repeat(total[starts] - amounts[starts], np.diff(starts, append=len(q)))


def _reach_of(q: np.ndarray, far: np.ndarray, usable: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Per query the smallest upper bound within which boxes surely hold ``need`` points."""
    order = np.lexsort((far, q))
    enough = order[_running(q[order], usable[order]) >= need[q[order]]]
    reach = np.full(len(need), np.inf)
    np.minimum.at(reach, q[enough], far[enough])
    return reach


def _grow_cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Median cuts of a complete binary tree; dimension -1 sends every row left."""
    dims = np.full(2**depth - 1, -1)
    cuts = np.zeros(2**depth - 1)
    spread_all = np.nanmax(sample, axis=0) - np.nanmin(sample, axis=0) if len(sample) else np.zeros(0)
    spread_all = np.where(spread_all > 0, spread_all, 1.0)
    members = {0: sample}
    for node in range(len(dims)):
        rows = members.pop(node, sample[:0])
        left = right = rows[:0]
        if len(rows) > 1:
            filled = ~np.isnan(rows)
            high = np.where(filled, rows, -np.inf).max(axis=0)
            low = np.where(filled, rows, np.inf).min(axis=0)
            spread = np.where(high > low, high - low, 0.0) / spread_all
            dim = int(np.argmax(spread))
            if spread[dim] > 0:
                values = rows[filled[:, dim], dim]
                cut = np.median(values)
                if cut >= high[dim]:
                    cut = values[values < high[dim]].max()
                dims[node], cuts[node] = dim, cut
                goes_right = rows[:, dim] > cut
                left, right = rows[~goes_right], rows[goes_right]
        members[2 * node + 1], members[2 * node + 2] = left, right
    return dims, cuts


def _leaf_of(
    x: np.ndarray, dims: np.ndarray, cuts: np.ndarray, depth: int, tree: np.ndarray | None = None
) -> np.ndarray:
    """The leaf of each row, in one tree or in the ``tree`` (row of cuts) of its own."""
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    for _ in range(depth):
        at = node if tree is None else (tree, node)
        dim = dims[at]
        right = (dim >= 0) & (x[rows, np.maximum(dim, 0)] > cuts[at])
        node = 2 * node + 1 + right
    return node - (2**depth - 1)


def _subtrees(points: DataFrame, leaf: Column, width: int, depth: int, share: float) -> pd.DataFrame:
    """Cuts of a tree of ``depth`` below every leaf, each from a sample of its own points, grown where they are."""
    most = 4 * SAMPLE_PER_LEAF * 2**depth

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        dims, cuts = _grow_cuts(_matrix(rows["x"].iloc[:most], width), depth)
        return pd.DataFrame({"leaf": [rows["leaf"].iloc[0]], "dims": [dims.astype("int32")], "cuts": [cuts]})

    picked = _sampled(points.select("x"), share).withColumn("leaf", leaf)
    return picked.groupBy("leaf").applyInPandas(grow, "leaf int, dims array<int>, cuts array<double>").toPandas()


def _sampled(points: DataFrame, share: float) -> DataFrame:
    return points if share >= 1 else points.where(F.pmod(F.xxhash64("x"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))


def build_blocks(points: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, BlockIndex]:
    """Deal locations (``id``, ``x``, ``copies``) to blocks and summarise the blocks.

    The upper tree is grown on the driver from a bounded sample; below its leaves, trees are grown in tasks.  Only cuts and boxes
    come to the driver, ``INDEX_NUMBERS`` at most: beyond that blocks hold more than ``block_rows`` and are searched in parts."""
    n, gaps = points.agg(F.count(F.lit(1)), F.max(F.exists("x", lambda v: F.isnan(v)).cast("int"))).head()
    most = max(INDEX_NUMBERS // (3 * width * (MAX_PATTERNS if gaps else 1)), 1)
    depth = max(min(math.ceil(math.log2(max(n / block_rows, 1))), int(math.log2(most))), 0)
    upper = min(depth, UPPER_DEPTH)
    lower = depth - upper
    share_of = [min(1.0, SAMPLE_PER_LEAF * 2**d / max(n, 1)) for d in (upper, depth)]
    sample = _matrix([r["x"] for r in _sampled(points.select("x"), share_of[0]).collect()], width) if depth else np.zeros((0, width))
    dims, cuts = _grow_cuts(sample, upper)

    @F.pandas_udf("int")
    def leaf(x: pd.Series) -> pd.Series:
        return pd.Series(_leaf_of(_matrix(x, width), dims, cuts, upper).astype("int32"))

    below = None
    if lower:
        grown = _subtrees(points, leaf("x"), width, lower, share_of[1])
        low_dims, low_cuts = np.full((2**upper, 2**lower - 1), -1, dtype=np.int32), np.zeros((2**upper, 2**lower - 1))
        if len(grown):
            low_dims[grown["leaf"]], low_cuts[grown["leaf"]] = np.stack(grown["dims"]), np.stack(grown["cuts"])
        below = share(points.sparkSession, (dims, cuts, low_dims, low_cuts))

    @F.pandas_udf("int")
    def deep_leaf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dims, cuts, low_dims, low_cuts = opened(below)
        for batch in batches:
            x = _matrix(batch, width)
            at = _leaf_of(x, dims, cuts, upper)
            under = _leaf_of(x, low_dims, low_cuts, lower, at)
            yield pd.Series((at * 2**lower + under).astype("int32"))

    missing = F.transform("x", lambda v: F.isnan(v))
    pattern = F.when(F.exists(missing, lambda m: m), 1 + F.pmod(F.xxhash64(missing), F.lit(MAX_PATTERNS - 1)))
    place = deep_leaf("x") if lower else leaf("x") if depth else F.lit(0)
    placed = cut_lineage(points.withColumn("block", (place * MAX_PATTERNS + F.coalesce(pattern, F.lit(0))).cast("int")))

    per_column = []
    for d in range(width):
        v = no_nan(f"get(x, {d})")
        per_column += [F.expr(f"min({v})").alias(f"lo{d}"), F.expr(f"max({v})").alias(f"hi{d}"),
                       F.expr(f"count({v})").alias(f"n{d}")]
    # blocks of one pattern follow one another, those of neighbouring leaves next to each other
    summary = placed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), *per_column).toPandas()
    blocks = summary["block"].to_numpy()
    order = np.lexsort((blocks // MAX_PATTERNS, blocks % MAX_PATTERNS))
    summary, blocks = summary.iloc[order], blocks[order]
    present, low, high = (np.stack([summary[f"{kind}{d}"].to_numpy(dtype=float) for d in range(width)], axis=1)
                          for kind in ("n", "lo", "hi"))
    present, rows = present.astype(np.int64), summary["rows"].to_numpy()
    boxes = Boxes(
        low=np.where(present > 0, low, np.inf), high=np.where(present > 0, high, -np.inf),
        always=present == rows[:, None], ever=present > 0, present=present, rows=rows)
    return placed, BlockIndex.over(blocks, boxes)


def _matrix(cells, width: int) -> np.ndarray:
    cells = list(cells)
    return np.array(cells, dtype=float).reshape(len(cells), width)


# ----------------------------------------------------------------------------- search


def _route(queries: DataFrame, index: BlockIndex, targets: Sequence[int] | None, first: bool) -> DataFrame:
    """Queries with the blocks that they visit, one row per visit."""
    width = index.levels[0].low.shape[1]
    shared = share(queries.sparkSession, index)
    scaled = targets is not None
    wanted = list(targets) if scaled else [None]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = opened(shared)
        for batch in batches:
            x, need = _matrix(batch["x"], width), batch["need"].to_numpy()
            radius = _matrix(batch["radius"], len(wanted))
            for start in range(0, len(batch), ROUTED):
                rows = slice(start, start + ROUTED)
                q, b = visits(index, x[rows], need[rows], radius[rows])
                yield batch.iloc[start + q].assign(block=index.blocks[b].astype("int32"))

    def visits(index: BlockIndex, x: np.ndarray, need: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(index.blocks)
        home, reached = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(wanted):
            asking = np.arange(len(x)) if t is None else np.flatnonzero(np.isnan(x[:, t]))
            q, b = index.home(x[asking], scaled, t, need[asking] + (t is None))
            home.append(asking[q] * n + b)
            if not first:
                q, b, _ = index.descend(x[asking], scaled, t, radius[asking, i])
                reached.append(asking[q] * n + b)
        pairs = np.unique(np.concatenate(home))
        if not first:  # a block of the first step was searched for all targets
            pairs = np.setdiff1d(np.concatenate(reached), pairs)
        return pairs // n, pairs % n

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(visit, f"{types}, block int")


def _visit_blocks(
    visits: DataFrame, placed: DataFrame, index: BlockIndex, targets: Sequence[int] | None
) -> DataFrame:
    """Candidates ``(id, need, target, other, dist, copies, value)`` found in the visited blocks."""
    spark = placed.sparkSession
    width = index.levels[0].low.shape[1]
    visits = cut_lineage(visits)
    load = {r["block"]: r["count"] for r in visits.groupBy("block").count().collect()}
    sizes = dict(zip(index.blocks.tolist(), index.levels[0].rows.tolist()))
    cut = [(b, math.ceil(sizes[b] / PART_ROWS), math.ceil(q / PART_ROWS)) for b, q in load.items()]
    plan = F.broadcast(spark.createDataFrame(cut, "block int, slices int, parts int"))  # one row per block
    queries = (
        visits.join(plan, "block")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .drop("slices", "parts")
    )
    points = (
        placed.join(plan, "block")
        .withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("slices", "parts")
    )
    wanted = list(targets) if targets is not None else [-1]

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", ignore_index=True)
        at, names, copies = _matrix(p["x"], width), p["id"].to_numpy(), p["copies"].to_numpy()
        step = max(1, CELLS // max(len(p), 1))
        found = []
        for start in range(0, len(q), step):
            chunk = q.iloc[start : start + step]
            x, ids, need = _matrix(chunk["x"], width), chunk["id"].to_numpy(), chunk["need"].to_numpy()
            radius = _matrix(chunk["radius"], len(wanted))
            dist = _distances(x, at, scaled=targets is not None)
            if targets is None:
                dist[ids[:, None] == names[None, :]] = np.inf
            for i, t in enumerate(wanted):
                rows = np.arange(len(chunk)) if t < 0 else np.flatnonzero(np.isnan(x[:, t]))
                d = dist[rows]
                if t >= 0:
                    d[:, np.isnan(at[:, t])] = np.inf
                if not d.size:
                    continue
                kth = min(int(need[rows].max()), d.shape[1]) - 1
                limit = np.minimum(np.partition(d, kth, axis=1)[:, kth], radius[rows, i])
                r, c = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                found.append(pd.DataFrame({
                    "id": ids[rows][r], "need": need[rows][r], "target": t, "other": names[c],
                    "dist": d[r, c], "copies": copies[c], "value": at[c, t] if t >= 0 else np.nan,
                }))
        columns = ["id", "need", "target", "other", "dist", "copies", "value"]
        return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns)

    keys = ["block", "slice", "part"]
    id_type, other_type = (df.schema["id"].dataType.simpleString() for df in (visits, placed))
    schema = f"id {id_type}, need int, target int, other {other_type}, dist double, copies bigint, value double"
    return queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(search, schema)


def _distances(x: np.ndarray, at: np.ndarray, scaled: bool) -> np.ndarray:
    total = np.zeros((len(x), len(at)))
    if not scaled:
        for d in range(x.shape[1]):
            gap = x[:, d][:, None] - at[:, d][None, :]
            gap *= gap
            total += gap
        return np.sqrt(total, out=total)
    present = np.zeros_like(total)
    for d in range(x.shape[1]):
        gap = x[:, d][:, None] - at[:, d][None, :]
        here = ~np.isnan(gap)
        total += np.where(here, gap, 0.0) ** 2
        present += here
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt(total / present * x.shape[1])
    return np.where(present == 0, np.inf, dist)


def _keep_nearest(candidates: DataFrame) -> DataFrame:
    """The nearest copies up to ``need`` per query and target, ties by ``other``; ``weight`` copies each."""
    before = Window.partitionBy("id", "target").orderBy("dist", "other").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("copies").over(before), F.lit(0))
    return (
        candidates.withColumn("taken", taken)
        .where(F.col("taken") < F.col("need"))
        .withColumn("weight", F.least("copies", F.col("need") - F.col("taken")))
        .drop("taken", "copies")
    )


def nearest(
    queries: DataFrame, points: DataFrame, width: int, targets: Sequence[int] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest points of each query as ``(id, need, target, other, dist, value, weight)``.

    ``queries`` has ``id``, ``x`` and ``need`` (how many copies to find); ``points`` has ``id``,
    ``x`` and ``copies``.  Without ``targets`` a query's own location is left out.  With targets
    (positions of x) each query looks for points that have the coordinate which it lacks.
    """
    placed, index = build_blocks(points, width, block_rows)
    slots = len(targets) if targets is not None else 1
    queries = queries.select("id", "x", F.col("need").cast("int").alias("need")).where("need > 0")
    unlimited = F.array_repeat(F.lit(float("inf")), slots)
    queries = cut_lineage(queries.withColumn("radius", unlimited))

    near = _keep_nearest(_visit_blocks(_route(queries, index, targets, True), placed, index, targets))
    if len(index.blocks) == 1:
        return near
    near = cut_lineage(near)

    # Radius per target: distance of the last neighbour, or unlimited when too few were found.
    numbers = list(targets) if targets is not None else [-1]
    reached = near.groupBy("id", "target").agg(
        F.sum("weight").alias("got"), F.max("dist").alias("far"), F.first("need").alias("enough"))
    full = F.when(F.col("got") >= F.col("enough"), F.col("far"))
    radii = reached.groupBy("id").agg(*[F.max(F.when(F.col("target") == t, full)).alias(f"r{i}")
                                        for i, t in enumerate(numbers)])
    positions = targets if targets is not None else [None]
    lacking = [F.lit(True) if t is None else F.isnan(F.get("x", F.lit(t))) for t in positions]
    radius = F.array(*[
        F.when(need_it, F.coalesce(F.col(f"r{i}"), F.lit(float("inf")))).otherwise(F.lit(-1.0))
        for i, need_it in enumerate(lacking)
    ])
    again = queries.drop("radius").join(radii, "id", "left").withColumn("radius", radius)
    again = again.select("id", "x", "need", "radius")
    far = _visit_blocks(_route(again, index, targets, False), placed, index, targets)
    first_round = near.withColumn("copies", F.col("weight")).drop("weight")
    return _keep_nearest(first_round.select(*far.columns).unionByName(far))


# ----------------------------------------------------------------------------- operators on top


def impute_from_neighbours(
    df: DataFrame, donors: DataFrame, key: str, columns: Sequence[str], means: dict[str, float], k: int = 5,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill a missing cell with the mean over the k nearest training rows that have the cell.

    Equal rows get equal values, so the search runs once per distinct incomplete row.
    """
    width = len(columns)
    points = locations(donors, key, columns)
    rows = df.withColumn("_x", coordinates(columns))
    incomplete = F.exists("_x", lambda v: F.isnan(v))
    receivers = cut_lineage(
        rows.where(incomplete).groupBy(F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.md5(F.col("x").cast("string")))
    )
    found = nearest(receivers.withColumn("need", F.lit(k)), points, width, range(width), block_rows)
    filled = found.groupBy("id").agg(*[
        F.expr(f"try_divide(sum(if(target = {i}, value * weight, null)), sum(if(target = {i}, weight, null)))")
        .alias(f"_fill{i}")
        for i in range(width)
    ])
    table = receivers.join(filled, "id", "left").drop("id").withColumnRenamed("x", "_x")
    total = receivers.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0]
    done = attach_by_location(rows.where(incomplete), table, total, "_x")
    new = {c: f"coalesce({no_nan(as_double(c))}, _fill{i}, {number(means[c])}) as {quoted(c)}"
           for i, c in enumerate(columns)}
    done = done.selectExpr(*[new.get(c, quoted(c)) for c in df.columns])
    whole = rows.where(~incomplete).selectExpr(
        *[f"{as_double(c)} as {quoted(c)}" if c in new else quoted(c) for c in df.columns])
    return done.unionByName(whole)


def local_outlier_factor(
    df: DataFrame, key: str, columns: Sequence[str], neighbours: int = 20, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Local outlier factor per location, as ``(x, copies, lof)``; null for a location without neighbours.

    k neighbours without the row itself, ties by the smallest key of a location.
    """
    points = cut_lineage(locations(df, key, columns))
    total = points.agg(F.sum("copies")).head()[0] or 0
    k = max(1, min(neighbours, total - 1))
    own = F.least(F.col("copies") - 1, F.lit(k))
    found = nearest(points.withColumn("need", F.lit(k) - own), points, len(columns), None, block_rows)
    twins = points.where("copies > 1").select("id", F.col("id").alias("other"), F.lit(0.0).alias("dist"),
                                              own.alias("weight"))
    links = cut_lineage(found.select("id", "other", "dist", "weight").unionByName(twins))
    reach_of = links.groupBy(F.col("id").alias("other")).agg(F.max("dist").alias("k_distance"))
    reach = links.join(reach_of, "other").withColumn("reach", F.greatest("k_distance", "dist"))
    density = cut_lineage(reach.groupBy("id").agg(
        (1 / (F.sum(F.col("weight") * F.col("reach")) / F.sum("weight") + F.lit(1e-10))).alias("density")))
    others = links.join(density.select(F.col("id").alias("other"), F.col("density").alias("near")), "other")
    mean = others.groupBy("id").agg((F.sum(F.col("weight") * F.col("near")) / F.sum("weight")).alias("mean_near"))
    factors = mean.join(density, "id").select("id", (F.col("mean_near") / F.col("density")).alias("lof"))
    return points.join(factors, "id", "left").select("x", "copies", "lof")
