"""Isolation forest (Liu et al. 2008): small random trees, each from 256 rows.

Sampling is the method itself: trees are grown from the rows with the lowest hash.  Every draw, of rows, inputs and cuts, is a hash of the seed
and the place in the forest, so the same forest can be grown in SQL, and is for any partitioning.
All rows are scored, inside Arrow batches, against the broadcast trees (at most
trees x 511 nodes).

A row with a missing cell takes both branches of a split on it, each with the share of the tree's rows that went
there.  While a tree grows, such rows follow the larger branch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import HASH_DIGITS, HASH_RANGE, as_double, number, quoted, unit_hash

TREES = 100
TREE_ROWS = 256
NODES = "tree int, node int, feature int, cut double, left int, right int, path double, goes_left double"


def average_path(n) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_forest(
    df: DataFrame, key: str, columns: Sequence[str], n: int, seed: int = 42, trees: int = TREES, rows: int = TREE_ROWS
) -> DataFrame:
    """Node table of the forest grown on a table of ``n`` rows, ``rows`` of them per tree."""
    rows = min(rows, n)
    pool = min(n, 2 * trees * rows)
    share = 1.0 if pool == n else pool / n
    per_tree = min(1.0, (4 * rows + 64) / max(pool, 1))
    digest = f"md5(concat('tree', t, '.{int(seed)}:', cast({quoted(key)} as string)))"
    draw = f"cast(conv(substring({digest}, 1, {HASH_DIGITS}), 16, 10) as double) / {number(HASH_RANGE)}"
    draws = f"transform(sequence(0, {trees - 1}), t -> struct(t as tree, {draw} as draw))"
    picked = df.where(unit_hash(key, seed, "forest") < share).selectExpr(
        f"array({', '.join(map(as_double, columns))}) as x",
        f"explode(filter({draws}, d -> d.draw < {number(per_tree)})) as d",
    ).select("d.tree", "d.draw", "x")
    width = len(columns)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw").head(rows)
        x = np.array(group["x"].tolist(), dtype=float).reshape(len(group), width)
        tree = int(group["tree"].iloc[0])
        return _grow_tree(x, tree, seed, rows)

    return picked.groupBy("tree").applyInPandas(grow, NODES)


def draw_at(seed: int, tree: int, path: str, what: str) -> float:
    """The draw in [0, 1) of a node; ``path`` has a letter, L or R, for each branch on the way to it."""
    digest = hashlib.md5(f"{what}{seed}:{tree}.{path}".encode()).hexdigest()
    return int(digest[:HASH_DIGITS], 16) / HASH_RANGE


def _grow_tree(x: np.ndarray, tree: int, seed: int, rows: int) -> pd.DataFrame:
    depth_cap = math.ceil(math.log2(max(rows, 2)))
    nodes, waiting = [], [(x, "", None, None)]
    while waiting:
        members, way, parent, side = waiting.pop()
        number, depth = len(nodes), len(way)
        if parent is not None:
            nodes[parent][side] = number
        low = np.where(np.isnan(members), np.inf, members).min(axis=0)
        high = np.where(np.isnan(members), -np.inf, members).max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= depth_cap or len(members) <= 1 or not len(splittable):
            path = depth + average_path(len(members))
            nodes.append({"tree": tree, "node": number, "feature": -1, "cut": 0.0, "left": -1, "right": -1,
                          "path": path, "goes_left": 0.0})
            continue
        feature = int(splittable[int(draw_at(seed, tree, way, "input") * len(splittable))])
        cut = float(low[feature] + draw_at(seed, tree, way, "cut") * (high[feature] - low[feature]))
        if cut >= high[feature]:  # neighbouring floats: keep a row on the right
            cut = float(low[feature])
        known = ~np.isnan(members[:, feature])
        goes_left = members[:, feature] <= cut
        share = float(goes_left[known].mean())
        nodes.append({"tree": tree, "node": number, "feature": feature, "cut": cut, "left": -1, "right": -1,
                      "path": 0.0, "goes_left": share})
        goes_left |= ~known & (share >= 0.5)
        waiting.append((members[~goes_left], way + "R", number, "right"))
        waiting.append((members[goes_left], way + "L", number, "left"))
    return pd.DataFrame(nodes)


def _expected_path(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean path of rows with missing cells; children have larger numbers than their parent."""
    weight = np.zeros((len(tree["feature"]), len(x)))
    weight[0] = 1.0
    total = np.zeros(len(x))
    for node, feature in enumerate(tree["feature"]):
        if feature < 0:
            total += weight[node] * tree["path"][node]
            continue
        cell = x[:, feature]
        left = np.where(np.isnan(cell), tree["goes_left"][node], cell <= tree["cut"][node])
        weight[tree["left"][node]] = weight[node] * left
        weight[tree["right"][node]] = weight[node] * (1.0 - left)
    return total


def anomaly_score(nodes: DataFrame, columns: Sequence[str], rows: int) -> Column:
    """Score in (0, 1], larger for rows that are easier to isolate."""
    table = nodes.toPandas().sort_values(["tree", "node"])  # bounded: trees x (2 x rows - 1)
    forest = [
        {name: part[name].to_numpy() for name in ("feature", "cut", "left", "right", "path", "goes_left")}
        for _, part in table.groupby("tree")
    ]
    shared = nodes.sparkSession.sparkContext.broadcast(forest)
    norm = max(average_path(rows), 1e-12)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        every = x.to_numpy(dtype=float)
        gaps = np.isnan(every).any(axis=1)
        paths = np.zeros(len(every))
        if gaps.any():
            paths[gaps] = sum(_expected_path(tree, every[gaps]) for tree in shared.value)
        values = every[~gaps]
        total = np.zeros(len(values))
        line = np.arange(len(values))
        for tree in shared.value if len(values) else ():
            node = np.zeros(len(values), dtype=np.int64)
            while True:
                feature = tree["feature"][node]
                inner = feature >= 0
                if not inner.any():
                    break
                left = values[line, np.maximum(feature, 0)] <= tree["cut"][node]
                node = np.where(inner, np.where(left, tree["left"][node], tree["right"][node]), node)
            total += tree["path"][node]
        paths[~gaps] = total
        return pd.Series(2.0 ** (-(paths / len(shared.value)) / norm))

    return score(F.expr(f"struct({', '.join(f'{as_double(c)} as {quoted(c)}' for c in columns)})"))
