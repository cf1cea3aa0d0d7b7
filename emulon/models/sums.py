"""Sums over partitions of small arrays computed inside the tasks.

Each task folds its Arrow batches into a few arrays.  The scan keeps its own partitions.  The arrays
are added up in a tree of fixed shape, keyed by partition number: 256 neighbours first, then all of these.
Few small arrays are added on the driver, others in Spark, sliced, so that every slice has its own group; the shape of the
tree, and so every bit of the totals, is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 4096  # numbers per row of the partial table
GROUP = 256  # partials added up in one group
DRIVER_NUMBERS = 8_000_000  # partial arrays of up to this many numbers are added on the driver
LEAST_FROM = 1 << 28  # slots from here on hold the element-wise least, not the sum
PARTIALS = "slot int, slice int, part int, numbers binary"

Work = Callable[[Iterator[pd.DataFrame], int], dict[int, np.ndarray]]


def sum_over_partitions(df: DataFrame, work: Work, size: int = 0, partitions: int | None = None) -> dict[int, np.ndarray]:
    """Element-wise totals of the arrays that ``work`` returns for each partition, by slot; the least in slots from ``LEAST_FROM`` on.

    With ``partitions``, their number, and ``size``, the most numbers a task returns, known to be small, totals are formed on the driver.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for slot, numbers in work(batches, part).items():
            cuts = range(0, len(numbers), SLICE)
            yield pd.DataFrame({
                "slot": slot,
                "slice": [c // SLICE for c in cuts],
                "part": part,
                "numbers": [numbers[c : c + SLICE].tobytes() for c in cuts],
            })

    def combined(slot: int, arrays: list[np.ndarray]) -> np.ndarray:
        total = arrays[0].copy()
        for a in arrays[1:]:
            if slot >= LEAST_FROM:
                np.minimum(total, a, out=total)
            else:
                total += a
        return total

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        first = group.iloc[0]
        return pd.DataFrame({
            "slot": [first["slot"]], "slice": [first["slice"]], "part": [first["part"]],
            "numbers": [combined(first["slot"], [np.frombuffer(b) for b in group["numbers"]]).tobytes()],
        })

    partials = df.mapInPandas(run, PARTIALS)
    few = partitions is not None and partitions * size <= DRIVER_NUMBERS
    if not few:
        partials = partials.groupBy("slot", "slice", F.floor(F.col("part") / GROUP)).applyInPandas(add, PARTIALS)
        partials = partials.groupBy("slot", "slice").applyInPandas(add, PARTIALS)
    tree: dict[tuple[int, int], dict[int, list[np.ndarray]]] = {}
    for row in sorted(partials.collect(), key=lambda r: (r["slot"], r["slice"], r["part"])):
        tree.setdefault((row["slot"], row["slice"]), {}).setdefault(row["part"] // GROUP, []).append(np.frombuffer(row["numbers"]))
    totals: dict[int, list[np.ndarray]] = {}
    for slot, piece in sorted(tree):
        totals.setdefault(slot, []).append(combined(slot, [combined(slot, a) for a in tree[slot, piece].values()]))
    return {slot: np.concatenate(pieces) for slot, pieces in totals.items()}
