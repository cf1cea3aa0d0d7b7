import numpy as np
import pandas as pd
import pytest

from emulon.functions.quantiles import column_quantiles, order_statistics, values_at_ranks

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _columns(seed, n=4000):
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=n)
    hot[: n // 3] = 1.25  # a third of the rows hold one value
    return pd.DataFrame({
        "smooth": rng.normal(size=n),
        "hot": hot,
        "steps": rng.integers(0, 7, n).astype(float),
        "constant": np.full(n, 5.0),
        "skewed": np.exp(4 * rng.normal(size=n)),
    })


@pytest.mark.parametrize("accuracy,max_inside", [(10_000, 200_000), (50, 100_000), (50, 20), (20, 5)])
def test_equal_to_sorting(spark, accuracy, max_inside):
    pdf = _columns(accuracy + max_inside)
    df = spark.createDataFrame(pdf).repartition(5)
    for c in pdf.columns:
        ranks = [0, 17, len(pdf) // 3, len(pdf) // 2, len(pdf) - 1]
        wanted = {c: [((r + 0.5) / len(pdf), [r]) for r in ranks]}
        n, found = order_statistics(df, wanted, accuracy, max_inside)[c]
        ordered = np.sort(pdf[c])
        assert n == len(pdf)
        assert found == {r: ordered[r] for r in ranks}


def test_linear_interpolation_and_missing(spark):
    pdf = _columns(3)
    pdf.loc[::5, "smooth"] = None
    df = spark.createDataFrame(pdf).selectExpr("nanvl(smooth, null) as smooth", "hot", "steps", "cast(null as double) as none")
    got = column_quantiles(df, ["smooth", "hot", "steps", "none"], SHARES)
    for c in ("smooth", "hot", "steps"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), SHARES), rtol=0, atol=1e-12)
    assert got["none"] == [None] * len(SHARES)


def test_quartet(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "a double")
    assert column_quantiles(df, ["a"], [0.25, 0.5, 0.75])["a"] == [1.75, 3.0, 5.25]
    assert column_quantiles(df, ["a"], [0.25, 0.5, 0.75], approximate=True)["a"] == [1.0, 2.0, 4.0]


def test_values_at_ranks(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "u double")
    assert values_at_ranks(df, "u", [0, 50, 100], 101) == {0: 0.0, 50: 50.0, 100: 100.0}


@pytest.mark.parametrize("accuracy,max_inside", [(10_000, 200_000), (50, 20), (20, 3)])
def test_positions_of_arrays_equal_sorting(spark, accuracy, max_inside):
    from emulon.functions.quantiles import array_quantiles

    pdf = _columns(3, 2000)
    cells = pdf.to_numpy().tolist()
    rows = [(i, c) for i, c in enumerate(cells)] + [(-1, None), (-2, [1.0]), (-3, [None, float("nan"), 2.0, 5.0, 0.5, 7.0])]
    df = spark.createDataFrame(rows, "k int, `a.v` array<double>").repartition(4)
    got = array_quantiles(df, "a.v", SHARES, accuracy, max_inside)
    extra = {0: [1.0], 2: [2.0], 3: [5.0], 4: [0.5], 5: [7.0]}
    for pos in range(6):
        values = ([c[pos] for c in cells] if pos < 5 else []) + extra.get(pos, [])
        assert np.allclose(got[pos], np.quantile(values, SHARES), rtol=0, atol=1e-12), pos
    assert array_quantiles(df.limit(0), "a.v", SHARES) == []


def test_many_columns_share_one_bound(spark, monkeypatch):
    """Many columns and three quartiles: what one scan collects stays below the total, and nothing is lost."""
    from emulon.functions import quantiles

    n, k = 1500, 120
    x = np.random.default_rng(5).standard_normal((n, k))
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>").selectExpr(*[f"v[{i}] as c{i}" for i in range(k)]).cache()
    monkeypatch.setattr(quantiles, "MAX_TOTAL", 8_000)
    monkeypatch.setattr(quantiles, "SKETCHES", 12_000)
    collected = []
    step = quantiles._refine
    monkeypatch.setattr(quantiles, "_refine", lambda df, brackets, *a: collected.append(sum(b.width for b in brackets if b.width <= a[-1])) or step(df, brackets, *a))
    got = column_quantiles(df, names, [0.25, 0.5, 0.75])
    want = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    assert np.allclose(np.array([got[c] for c in names]).T, want, rtol=0, atol=1e-12)
    assert 0 < max(collected) <= 8_000
