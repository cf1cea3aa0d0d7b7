"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulon.llm import negatives


def brute(rows, anchor_every=10, positives=5, k=10):
    """Rows (vec_id, label, vector) to the set of results."""
    good = []
    for key, label, x in rows:
        if key is None or label is None or x is None or any(c is None or not math.isfinite(c) or abs(c) > 2**20 for c in x):
            continue
        good.append((key, str(label), tuple(math.floor(256 * c) for c in x)))
    good = sorted(set(good))
    out = []
    for a in [g for g in good if g[0] % anchor_every == 0]:
        scored = sorted(((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1]) for b in good if b[0] != a[0] and len(b[2]) == len(a[2])))
        for s, key, _ in [x for x in scored if x[2] == a[1]][:positives]:
            window = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(a[0], key, i + 1, x[1], -s, -x[0]) for i, x in enumerate(window)]
    return sorted(out)


def mined(spark, rows, anchor_every=10, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns(
        {c: F.lit("x") for c in ("v", "x", "anchor", "windows", "cell", "kind", "place", "part", "lane", "score", "rank")})
    whole = negatives.whole_vectors(table, F.col("vec_id"), F.col("label"), F.col("embedding"))
    return sorted(tuple(r) for r in negatives.mine(whole, F.col("vec_id") % anchor_every == 0, **options).collect())


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, size)) * spread
    labels = rng.integers(0, 4, n)
    x = (centres[labels] + rng.standard_normal((n, size))).astype(np.float32) / 4
    return [(i, int(labels[i]), [float(c) for c in x[i]]) for i in range(n)]


@pytest.mark.parametrize("n, size, spread, options", [
    (300, 64, 0.3, {}), (300, 40, 0.0, {"block": 7, "lanes": 3}), (400, 3, 1.0, {"lanes": 2}), (200, 17, 2.0, {"positives": 2, "negatives": 3, "block": 5})])
def test_equals_brute_force(spark, n, size, spread, options):
    rows = vectors(n, size, size, spread)
    want = brute(rows, 10, options.get("positives", 5), options.get("negatives", 10))
    assert want and mined(spark, rows, **options) == want


def test_ties_nulls_and_odd_rows(spark):
    rows = vectors(120, 4, 9)
    rows = [(k, l, [float(round(c)) for c in x]) for k, l, x in rows]  # many ties
    rows += rows[:30]  # repeated rows
    rows += [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (510, 1, None), (520, 1, [1.0, None, 0.0, 0.0]), (530, 1, [float("nan")] * 4),
             (540, 1, [float("inf"), 0.0, 0.0, 0.0]), (550, 1, []), (560, 2, []), (570, 1, [0.0] * 4), (580, 1, [1.0, 2.0]), (590, 2, [1.0, 2.0]), (591, 1, [3.0, 1.0]),
             (600, 3, [3e38] * 4), (30, 2, [2.0, 2.0, 2.0, 2.0])]
    rows += [(553, 1, []), (561, 2, [])]
    got, want = mined(spark, rows), brute(rows)
    assert got == want and {550, 570} <= {r[0] for r in want}


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_the_index_omits_what_no_threshold_needs():
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((400, 64)) * np.linspace(4, 0.05, 64) * 100).astype(np.int64)
    keys, labels = np.arange(400), np.zeros(400, dtype=np.int64)
    square = (rows[:3] ** 2).sum(axis=1)
    anchors = negatives.Anchors(rows[:3], np.arange(3), keys[:3], labels[:3], np.arange(3), np.ones(3), square * 3 // 4, square, 5, True)
    listed = []
    join = anchors._join
    anchors._join = lambda some, t, x, rest, n, index, *more: listed.append(sum(map(len, index))) or join(some, t, x, rest, n, index, *more)
    anchors.meet(rows, keys, labels)
    assert listed and listed[0] < 0.5 * 400 * 4  # stretches of rows in the index, of all
    want = {(a, b) for a in range(3) for b in range(400) if a != b and square[a] * 3 // 4 <= rows[a] @ rows[b] <= square[a]}
    assert {(a, b) for a, b in zip(anchors.window, anchors.vec)} <= want and len(anchors.window) == sum(min(5, sum(p[0] == a for p in want)) for a in range(3))
