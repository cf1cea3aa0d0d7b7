import tracemalloc

import numpy as np
import pandas as pd
import pytest

from emulon.operators import neighbours
from emulon.operators.impute import fit_imputer
from emulon.operators.outliers import drop_outliers, lof_scores


def brute_lof(x, k):
    """Reference result on distinct locations with copies; ties by the smallest key of a location."""
    n = len(x)
    k = max(1, min(k, n - 1))
    first = {}
    for i, row in enumerate(map(tuple, x)):
        first.setdefault(row, i)
    loc = np.array([first[tuple(r)] for r in x])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        others.sort(key=lambda j: (d[i, j], loc[j], j))
        near.append(others[:k])
    kd = np.array([d[i, near[i]].max() for i in range(n)])
    lrd = np.array([1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean(lrd[near[i]]) / lrd[i] for i in range(n)])


def _points(kind, rng, n=260):
    if kind == "smooth":
        return rng.normal(size=(n, 3))
    if kind == "grid":  # many equal distances
        return rng.integers(0, 6, (n, 2)).astype(float)
    x = rng.normal(size=(n, 2))
    x[: n // 3] = x[0]  # a third of the rows are one point
    return x


@pytest.mark.parametrize("kind", ["smooth", "grid", "hot"])
@pytest.mark.parametrize("block_rows,part_rows", [(4096, 16384), (24, 9)])
def test_lof_equals_brute_force(spark, monkeypatch, kind, block_rows, part_rows):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    monkeypatch.setattr(neighbours, "HOT_COPIES", 10)
    x = _points(kind, np.random.default_rng(5))
    columns = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns).assign(key=range(len(x))))
    got = lof_scores(df, "key", columns, neighbours=7, block_rows=block_rows).orderBy("key").toPandas()
    assert len(got) == len(x)
    assert np.allclose(got["lof"], brute_lof(x, 7), rtol=1e-9)


def test_lof_drops_planted_points(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 2)), 30 + 10 * rng.normal(size=(5, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(key=range(205)))
    kept = {r["key"] for r in drop_outliers(df, "key", ["a", "b"], "lof").collect()}
    assert not kept & set(range(200, 205))
    assert len(kept) > 180


def test_lof_with_few_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "key int, a double")
    got = lof_scores(df, "key", ["a"]).orderBy("key").toPandas()["lof"]
    assert np.allclose(got, brute_lof(np.array([[1.0], [2.0], [4.0]]), 20))


def brute_impute(x, donors, k):
    """Distances leave out missing coordinates; equal donors share the place of the first."""
    first = {}
    for i, row in enumerate(map(tuple, np.where(np.isnan(donors), np.inf, donors))):
        first.setdefault(row, i)
    loc = [first[tuple(r)] for r in np.where(np.isnan(donors), np.inf, donors)]
    out = x.copy()
    for i, row in enumerate(x):
        for t in np.flatnonzero(np.isnan(row)):
            found = []
            for j, other in enumerate(donors):
                both = ~np.isnan(row) & ~np.isnan(other)
                if np.isnan(other[t]) or not both.any():
                    continue
                total = 0.0
                for a, b in zip(row[both], other[both]):
                    total += (a - b) ** 2
                found.append((np.sqrt(total / both.sum() * len(row)), loc[j], j))
            found.sort()
            values = [donors[j, t] for _, _, j in found[:k]]
            out[i, t] = np.mean(values) if values else np.nanmean(donors[:, t])
    return out


@pytest.mark.parametrize("block_rows,part_rows", [(4096, 16384), (20, 7)])
@pytest.mark.parametrize("hot", [False, True])
def test_knn_imputation_equals_brute_force(spark, monkeypatch, block_rows, part_rows, hot):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    monkeypatch.setattr(neighbours, "HOT_COPIES", 10)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(180, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    if hot:
        x[:60] = x[0]
        x[60:90] = [0.1, np.nan, 0.3, np.nan]
    x[5] = np.nan  # nothing to compare by: column means
    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns).assign(key=range(len(x))))
    imputer = fit_imputer(df, columns, "knn", key="key")
    monkeypatch.setattr(neighbours.impute_from_neighbours, "__defaults__", (5, block_rows))
    got = imputer.transform(df).orderBy("key").select(columns).toPandas().to_numpy()
    assert np.allclose(got, brute_impute(x, x, 5), rtol=1e-9)


def test_knn_imputation_of_other_rows(spark):
    donors = np.array([[1.0, 10.0], [2.0, 20.0], [3.0, np.nan], [10.0, 100.0], [11.0, 110.0], [12.0, 120.0]])
    rows = np.array([[1.5, np.nan], [np.nan, 105.0]])
    train = spark.createDataFrame(pd.DataFrame(donors, columns=["a", "b"]).assign(key=range(6)))
    new = spark.createDataFrame(pd.DataFrame(rows, columns=["a", "b"]).assign(key=[100, 101]))
    got = fit_imputer(train, ["a", "b"], "knn", key="key", k=2).transform(new).orderBy("key").select("a", "b").toPandas()
    assert np.allclose(got.to_numpy(), brute_impute(rows, donors, 2))


def _flat_index(rng, n_blocks, width, missing=0.0):
    """An index over random boxes with a few points each, in the order of a k-d tree, and those points."""
    points, centres = [], rng.uniform(0, 100, (n_blocks, width))
    leaf = neighbours._leaf_of(centres, *neighbours._grow_cuts(centres, 12), 12)
    for centre in centres[np.argsort(leaf)]:
        x = centre + rng.normal(size=(5, width))
        x[rng.random(x.shape) < missing] = np.nan
        points.append(x)
    has = [~np.isnan(p) for p in points]
    boxes = neighbours.Boxes(
        low=np.stack([np.where(h, p, np.inf).min(axis=0) for p, h in zip(points, has)]),
        high=np.stack([np.where(h, p, -np.inf).max(axis=0) for p, h in zip(points, has)]),
        always=np.stack([h.all(axis=0) for h in has]), ever=np.stack([h.any(axis=0) for h in has]),
        present=np.stack([h.sum(axis=0) for h in has]), rows=np.full(n_blocks, 5))
    return neighbours.BlockIndex.over(np.arange(n_blocks), boxes), points


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_descent_equals_all_boxes_and_visits_few(missing, monkeypatch):
    rng = np.random.default_rng(3)
    index, points = _flat_index(rng, 3000, 3, missing)
    x = rng.uniform(0, 100, (12, 3))
    if missing:
        x[np.arange(12), rng.integers(0, 3, 12)] = np.nan
    asked = []
    bounds = neighbours.Boxes.bounds
    monkeypatch.setattr(neighbours.Boxes, "bounds", lambda self, x, q, *rest: asked.append(len(q)) or bounds(self, x, q, *rest))
    scaled, target = bool(missing), (2 if missing else None)
    need = np.full(12, 7)
    q, b = index.home(x, scaled, target, need)
    visited = sum(asked)
    every = np.repeat(np.arange(12), 3000), np.tile(np.arange(3000), 12)
    near, far = bounds(index.levels[0], x, *every, scaled)
    near, far, usable = near.reshape(12, -1), far.reshape(12, -1), index.levels[0].usable(target)
    for i in range(12):
        dist = [neighbours._distances(x[i : i + 1], p, scaled)[0] for p in points]
        assert all((near[i, j] <= d).all() and (np.isinf(far[i, j]) or (far[i, j] >= d).all()) for j, d in enumerate(dist))
        order = [j for j in np.argsort(near[i], kind="stable") if usable[j] and np.isfinite(near[i, j])]
        before = np.cumsum(usable[order]) - usable[order]
        assert set(b[q == i]) == {j for j, n in zip(order, before) if n < 7}
    radius = np.full(12, 9.0)
    q, b, _ = index.descend(x, scaled, target, radius)
    assert set(zip(q, b)) == {(i, j) for i, j in zip(*np.nonzero(near <= 9.0)) if usable[j]}
    if not missing:
        assert visited < 0.1 * 12 * 3000
    monkeypatch.setattr(neighbours, "CELLS", 50)  # queries split on the way
    assert set(zip(*index.descend(x, scaled, target, radius)[:2])) == set(zip(q, b))


def test_a_column_with_few_donors_visits_their_blocks_only(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (4000, 3))
    x[:, 2] = np.nan
    donors = [10, 700, 3000]
    x[donors, 2] = [1.0, 2.0, 4.0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(key=range(len(x))))
    points = neighbours.locations(df, "key", ["a", "b", "c"])
    placed, index = neighbours.build_blocks(points, 3, block_rows=40)
    assert len(index.blocks) > 60
    queries = points.where("isnan(x[2])").selectExpr("id", "x", "5 as need", "array(double('inf'), double('inf'), double('inf')) as radius")
    for first in (True, False):
        visits = neighbours._route(queries, index, range(3), first).groupBy("id").count().agg({"count": "max"}).head()[0]
        assert (visits or 0) <= (3 if first else 0)
    found = neighbours.nearest(queries.select("id", "x", "need"), points, 3, range(3), 40).groupBy("id").count()
    assert found.where("count <> 3").count() == 0 and found.count() == 3997


def test_trees_below_the_upper_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "UPPER_DEPTH", 2)
    x = np.random.default_rng(6).normal(size=(1500, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(key=range(len(x))))
    _, index = neighbours.build_blocks(neighbours.locations(df, "key", ["a", "b"]), 2, block_rows=20)
    assert len(index.blocks) > 60 and index.levels[0].rows.sum() == 1500 and index.levels[0].rows.max() < 80
    got = lof_scores(df, "key", ["a", "b"], neighbours=7, block_rows=20).orderBy("key").toPandas()
    assert np.allclose(got["lof"], brute_lof(x, 7), rtol=1e-9)


def test_a_task_holds_few_distances():
    rng = np.random.default_rng(9)
    x, at = rng.random((max(1, neighbours.CELLS // neighbours.BLOCK_ROWS), 2)), rng.random((neighbours.BLOCK_ROWS, 2))
    tracemalloc.start()
    try:
        neighbours._distances(x, at, scaled=False)
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
