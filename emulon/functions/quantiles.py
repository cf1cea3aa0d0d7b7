"""Exact quantiles that need no sort and no per-value memory.

``percentile`` keeps a map of all distinct values in one aggregation buffer, which
does not hold on very large tables.  Here an approximate sketch brackets each wanted
rank, a second scan counts what lies below the bracket and picks up the few values
strictly inside it.  Values equal to a bracket end are only counted, so a value held
by a third of the rows costs nothing.  Brackets that are still wide are narrowed again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import as_double, number, quoted

ACCURACY = 10_000
MAX_INSIDE = 200_000  # values of one bracket that may be collected
MAX_TOTAL = 4_000_000  # values of all brackets of a scan that may be collected
SKETCHES = 2_000_000  # samples that the sketches of a scan may keep in all; many columns get coarser sketches and narrower brackets
FEWEST = 500  # accuracy of a sketch, at least


def _accuracy(columns: int, accuracy: int) -> int:
    return min(accuracy, max(FEWEST, SKETCHES // max(1, columns)))


def _share_of_total(brackets: int, max_inside: int) -> int:
    """Values that each of so many brackets may collect; at least two, so that narrowing ends."""
    return max(2, min(max_inside, MAX_TOTAL // max(1, brackets)))


@dataclass
class _Bracket:
    name: str
    ranks: list[int]
    lo: float
    hi: float
    width: float  # estimated number of values strictly inside

    @property
    def value(self) -> str:
        return as_double(self.name)

    @property
    def inside(self) -> str:
        return f"if({self.value} > {number(self.lo)} and {self.value} < {number(self.hi)}, {self.value}, null)"


def order_statistics(
    df: DataFrame,
    wanted: Mapping[str, Sequence[tuple[float, Sequence[int] | None]]],
    accuracy: int = ACCURACY,
    max_inside: int = MAX_INSIDE,
) -> dict[str, tuple[int, dict[int, float]]]:
    """``{column: (n, {rank: value})}`` over the non-null values of each column.

    A wanted item is a share of the rows with the 0-based ranks near it that are asked for;
    without ranks, the two between which the quantile of that share lies.
    """
    accuracy = _accuracy(len(wanted), accuracy)
    slack = 2.0 / accuracy
    grids = {c: sorted({p for s, _ in items for p in (s - slack, s + slack) if 0 < p < 1})
             for c, items in wanted.items()}

    # First scan: counts, extremes and sketches of every column together.
    first = []
    for i, (c, grid) in enumerate(grids.items()):
        x = as_double(c)
        first += [f"count({x}) as n{i}", f"min({x}) as lo{i}", f"max({x}) as hi{i}"]
        if grid:
            first.append(f"percentile_approx({x}, array({', '.join(map(number, grid))}), {accuracy}) as s{i}")
    row = df.selectExpr(*first).head()

    out: dict[str, tuple[int, dict[int, float]]] = {}
    pending: list[_Bracket] = []
    extremes = {}
    for i, (c, grid) in enumerate(grids.items()):
        n = row[f"n{i}"]
        out[c] = (n, {})
        if n == 0:
            continue
        extremes[c] = (row[f"lo{i}"], row[f"hi{i}"])
        sketch = dict(zip(grid, row[f"s{i}"])) if grid else {}
        for share, ranks in wanted[c]:
            lo = sketch.get(share - slack, extremes[c][0])
            hi = sketch.get(share + slack, extremes[c][1])
            ranks = list(ranks) if ranks is not None else neighbouring_ranks(n, share)
            pending.append(_Bracket(c, ranks, lo, hi, 4 * slack * n))
    while pending:
        pending = _refine(df, pending, extremes, out, accuracy, _share_of_total(len(pending), max_inside))
    return out


def _refine(df, brackets, extremes, out, accuracy, max_inside) -> list[_Bracket]:
    aggregates = []
    for i, b in enumerate(brackets):
        lo, hi = number(b.lo), number(b.hi)
        aggregates += [
            f"count_if({b.value} < {lo}) as below{i}",
            f"count_if({b.value} = {lo}) as low{i}",
            f"count_if({b.value} = {hi}) as high{i}",
            f"count({b.inside}) as mid{i}",
        ]
        if b.width <= max_inside:
            aggregates.append(f"collect_list({b.inside}) as values{i}")
    row = df.selectExpr(*aggregates).head()

    again: list[_Bracket] = []
    wide: list[tuple[_Bracket, int]] = []
    for i, b in enumerate(brackets):
        below, low, high, mid = (row[f"{k}{i}"] for k in ("below", "low", "high", "mid"))
        if b.lo == b.hi:
            high = 0
        start = below + low  # rank of the first value strictly inside
        if min(b.ranks) < below or max(b.ranks) >= start + mid + high:
            again.append(_Bracket(b.name, b.ranks, *extremes[b.name], math.inf))  # the sketch was off
            continue
        values = out[b.name][1]
        inner = [r for r in b.ranks if start <= r < start + mid]
        values.update({r: b.lo if r < start else b.hi for r in b.ranks if r not in inner})
        if inner and b.width <= max_inside:
            inside = sorted(row[f"values{i}"])
            values.update({r: inside[r - start] for r in inner})
        elif inner and mid <= max_inside:
            again.append(_Bracket(b.name, inner, b.lo, b.hi, mid))
        elif inner:
            wide.append((_Bracket(b.name, inner, b.lo, b.hi, mid), start))

    if wide:
        slack = 2.0 / accuracy
        shares, sketches = [], []
        for i, (b, start) in enumerate(wide):
            last = max(b.width - 1, 1)
            ends = ((min(b.ranks) - start) / last - slack, (max(b.ranks) - start) / last + slack)
            shares.append([min(max(e, 0.0), 1.0) for e in ends])
            sketches += [
                f"percentile_approx({b.inside}, array({', '.join(map(number, shares[-1]))}), {accuracy}) as s{i}",
                f"min({b.inside}) as lo{i}",
                f"max({b.inside}) as hi{i}",
            ]
        row = df.selectExpr(*sketches).head()
        for i, (b, _) in enumerate(wide):
            lo = row[f"lo{i}"] if shares[i][0] == 0.0 else row[f"s{i}"][0]
            hi = row[f"hi{i}"] if shares[i][1] == 1.0 else row[f"s{i}"][1]
            again.append(_Bracket(b.name, b.ranks, lo, hi, 4 * slack * b.width))
    return again


def array_quantiles(df: DataFrame, column: str, shares: Sequence[float], accuracy: int = ACCURACY, max_inside: int = MAX_INSIDE) -> list[list[float | None]]:
    """Quantiles, with linear interpolation, of every position of an array column; missing cells left out.

    All positions are groups of the same scans: a sketch, then counts below each bracket and the few values inside it, which are narrowed again
    until those of all positions together are few.  Cells combine on the map side."""
    cells = df.select(F.posexplode(F.col(quoted(column)).cast("array<double>")).alias("pos", "x")).where("x is not null and not isnan(x)")
    size = df.agg(F.max(F.size(F.col(quoted(column))))).head()[0] or 0
    accuracy = _accuracy(size, accuracy)
    slack = 2.0 / accuracy
    grid = sorted({p for s in shares for p in (s - slack, s + slack) if 0 < p < 1})
    sketch = f"percentile_approx(x, array({', '.join(map(number, grid))}), {accuracy})" if grid else "array()"
    first = cells.groupBy("pos").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.expr(f"{sketch} as s")).collect()
    found: dict[int, tuple[int, dict[int, float]]] = {r["pos"]: (r["n"], {}) for r in first}
    extremes = {r["pos"]: (r["lo"], r["hi"]) for r in first}
    pending: list[_Bracket] = []
    for r in first:
        at = dict(zip(grid, r["s"]))
        pending += [_Bracket(r["pos"], neighbouring_ranks(r["n"], s), at.get(s - slack, r["lo"]), at.get(s + slack, r["hi"]), 4 * slack * r["n"]) for s in shares]
    while pending:
        pending = _refine_cells(cells, pending, extremes, found, accuracy, _share_of_total(len(pending), max_inside))
    out: list[list[float | None]] = []
    for pos in range(size):
        n, values = found.get(pos, (0, {}))
        out.append([_between(values, s * (n - 1)) if n else None for s in shares])
    return out


def _between(values: Mapping[int, float], position: float) -> float:
    low, high = values[math.floor(position)], values[math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


def _refine_cells(cells: DataFrame, brackets: list[_Bracket], extremes, found, accuracy: int, limit: int) -> list[_Bracket]:
    """The step of ``_refine`` for brackets that are rows: at most a few for each position of an array."""
    spark = cells.sparkSession
    rows = [(i, int(b.name), float(b.lo), float(b.hi), b.width <= limit) for i, b in enumerate(brackets)]
    table = F.broadcast(spark.createDataFrame(rows, "i int, pos int, lo double, hi double, take boolean"))
    joined = cells.join(table, "pos")
    inside = F.expr("if(x > lo and x < hi, x, null)")
    counted = joined.groupBy("i").agg(
        F.expr("count_if(x < lo)").alias("below"), F.expr("count_if(x = lo)").alias("low"), F.expr("count_if(x = hi)").alias("high"),
        F.count(inside).alias("mid"), F.collect_list(F.when(F.col("take"), inside)).alias("values")).collect()
    again, wide = [], []
    for r in counted:
        b = brackets[r["i"]]
        values, start = found[b.name][1], r["below"] + r["low"]
        high = 0 if b.lo == b.hi else r["high"]
        if min(b.ranks) < r["below"] or max(b.ranks) >= start + r["mid"] + high:
            again.append(_Bracket(b.name, b.ranks, *extremes[b.name], math.inf))  # the sketch was off
            continue
        inner = [k for k in b.ranks if start <= k < start + r["mid"]]
        values.update({k: b.lo if k < start else b.hi for k in b.ranks if k not in inner})
        if inner and b.width <= limit:
            ordered = sorted(r["values"])
            values.update({k: ordered[k - start] for k in inner})
        elif inner and r["mid"] <= limit:
            again.append(_Bracket(b.name, inner, b.lo, b.hi, r["mid"]))
        elif inner:
            wide.append((r["i"], _Bracket(b.name, inner, b.lo, b.hi, r["mid"]), start))
    if wide:
        slack = 2.0 / accuracy
        # the sketch inside each bracket, at the ends of a narrower one
        ends = {i: tuple(min(max(e, 0.0), 1.0) for e in ((min(b.ranks) - start) / max(b.width - 1, 1) - slack, (max(b.ranks) - start) / max(b.width - 1, 1) + slack))
                for i, b, start in wide}
        shares = sorted({e for pair in ends.values() for e in pair})
        sketched = joined.where(F.col("i").isin(list(ends)) & inside.isNotNull()).groupBy("i").agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"),
            F.expr(f"percentile_approx(x, array({', '.join(map(number, shares))}), {accuracy})").alias("s")).collect()
        by = {r["i"]: r for r in sketched}
        for i, b, _ in wide:
            at = dict(zip(shares, by[i]["s"]))
            lo = by[i]["lo"] if ends[i][0] == 0.0 else at[ends[i][0]]
            hi = by[i]["hi"] if ends[i][1] == 1.0 else at[ends[i][1]]
            again.append(_Bracket(b.name, b.ranks, lo, hi, 4 * slack * b.width))
    return again


def neighbouring_ranks(n: int, share: float) -> list[int]:
    position = share * (n - 1)
    return sorted({math.floor(position), math.ceil(position)})


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    approximate: bool = False,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation for all columns, missing values left out.

    ``approximate`` returns the sketch's values after a single scan.
    """
    if approximate:
        points = ", ".join(map(number, shares))
        row = df.selectExpr(*[f"percentile_approx({as_double(c)}, array({points}), {accuracy}) as q{i}"
                              for i, c in enumerate(columns)]).head()
        return {c: row[f"q{i}"] or [None] * len(shares) for i, c in enumerate(columns)}
    found = order_statistics(df, {c: [(s, None) for s in shares] for c in columns}, accuracy)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n, values = found[c]
        out[c] = []
        for share in shares:
            if n == 0:
                out[c].append(None)
                continue
            position = share * (n - 1)
            low, high = values[math.floor(position)], values[math.ceil(position)]
            out[c].append(low + (high - low) * (position - math.floor(position)))
    return out


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int], n: int) -> dict[int, float]:
    """The values at the given 0-based ranks of a column that has ``n`` non-null values."""
    return order_statistics(df, {column: [((r + 0.5) / n, [r]) for r in ranks]})[column][1]
