"""Train / test / validation split and fold assignment by a hash of the key.

The plain forms are narrow projections: no shuffle, the same answer for any
partitioning and on streams.  The exact forms give the row counts a permutation
would give; they look up the hash at the cut ranks and are still only scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.functions.columns import unit_hash
from emulon.functions.quantiles import values_at_ranks
from emulon.roles import check_shares
from emulon.runtime import cut_lineage

TRAIN, TEST, VAL = "train", "test", "val"


def split(
    df: DataFrame,
    key: str,
    test: float = 0.15,
    val: float | None = 0.15,
    seed: int = 42,
    exact: bool = False,
) -> DataFrame:
    """Add a ``split`` column with ``train``, ``test`` or ``val``."""
    test, val = check_shares(test, val)
    u = unit_hash(key, seed)
    if exact:
        low, high = _upper_ends(df, u, lambda n: _test_and_val(n, test, val))
        label = F.when(u <= low, TEST).when(u <= high, VAL).otherwise(TRAIN)
    else:
        label = F.when(u < test, TEST).when(u < test + val, VAL).otherwise(TRAIN)
    return df.withColumn("split", label)


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, exact: bool = False) -> DataFrame:
    """Add a ``fold`` column with 0 .. k-1; exact folds differ by one row at most."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    u = unit_hash(key, seed, "fold")
    if not exact:
        return df.withColumn("fold", F.floor(u * k).cast("int"))
    passed = [F.when(u > cut, 1).otherwise(0) for cut in _upper_ends(df, u, lambda n: _fold_ends(n, k))]
    return df.withColumn("fold", sum(passed[1:], passed[0]).cast("int"))


def _test_and_val(n: int, test: float, val: float) -> list[int]:
    n_test = math.ceil(test * n)
    return [n_test, n_test + (math.ceil(val / (1 - test) * (n - n_test)) if val else 0)]


def _fold_ends(n: int, k: int) -> list[int]:
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    return [sum(sizes[: i + 1]) for i in range(k - 1)]


def _upper_ends(df: DataFrame, u, counts_of: Callable[[int], list[int]]) -> list[float]:
    """For each count of lowest rows, the largest hash among them (-1 for none).

    The hashes are written once, eight bytes a row; the rank scans read only them.
    """
    hashes = cut_lineage(df.select(u.alias("u")))
    n = hashes.count()
    counts = counts_of(n)
    ranks = sorted({c - 1 for c in counts if c > 0})
    found = values_at_ranks(hashes, "u", ranks, n) if ranks else {}
    return [found[c - 1] if c > 0 else -1.0 for c in counts]


def part(df: DataFrame, name: str) -> DataFrame:
    """Rows of one split; prunes partitions on a table written by ``write_bundle``."""
    return df.where(F.col("split") == name)
