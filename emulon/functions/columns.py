"""Column expressions used by several operators.

Wide tables need hundreds of expressions at a time.  They are written as SQL text here and
in the operators: Spark parses a long text far faster than Python builds the same tree call
by call.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

EPSILON = 1e-10  # fixed value: added to the signed truth in relative errors
HASH_DIGITS = 13
HASH_RANGE = 16**HASH_DIGITS


# ----------------------------------------------------------------------------- SQL text


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(x: float) -> str:
    """A double literal."""
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_double(name: str) -> str:
    return f"cast({quoted(name)} as double)"


def no_nan(sql: str) -> str:
    """Null in place of NaN."""
    return f"nanvl({sql}, cast(null as double))"


def cells_to_rows(df: DataFrame, cells: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Explode an array of equally shaped structs, given as SQL text, into rows."""
    return df.selectExpr(*map(quoted, keep), f"explode(array({', '.join(cells)})) as cell").select(*keep, "cell.*")


# ----------------------------------------------------------------------------- expressions


def unit_hash(key: str, seed: int, purpose: str = "") -> Column:
    """A number in [0, 1) that depends on the key, the seed and the purpose only.

    Unlike ``rand`` it does not move when the table is partitioned differently.  Each use has a
    purpose of its own: rows that a split has chosen by hash must not look alike to a later draw.
    """
    digest = f"md5(concat('{purpose}{seed}:', cast({quoted(key)} as string)))"
    return F.expr(f"cast(conv(substring({digest}, 1, {HASH_DIGITS}), 16, 10) as double) / {number(HASH_RANGE)}")


def row_key(columns: Iterable[str]) -> Column:
    """Key of a table without one: digest of the given columns, nulls told apart from empty text."""
    cells = ", ".join(f"coalesce(cast({quoted(c)} as string), '\\\\N')" for c in columns)
    return F.expr(f"md5(concat_ws('|', {cells}))")


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values are nulls from here on: NaN compares above everything and spoils averages."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    chosen = floats & set(columns if columns is not None else df.columns)
    return df.selectExpr(*[
        f"nanvl({quoted(c)}, null) as {quoted(c)}" if c in chosen else quoted(c) for c in df.columns
    ])


def replace_columns(df: DataFrame, new: Mapping[str, str]) -> DataFrame:
    """One projection with some columns replaced or appended by SQL text, the order kept."""
    kept = [f"{new[c]} as {quoted(c)}" if c in new else quoted(c) for c in df.columns]
    return df.selectExpr(*kept, *[f"{e} as {quoted(c)}" for c, e in new.items() if c not in df.columns])


def model_columns(prefix: str, columns: Sequence[str]) -> list[Column]:
    """The columns as doubles under short positional names, ready for an Arrow block."""
    return [F.expr(f"{as_double(c)} as {prefix}{i}") for i, c in enumerate(columns)]


def narrow(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast model columns to single precision."""
    return replace_columns(df, {c: f"cast({quoted(c)} as float)" for c in columns})


def format_number(sql: str) -> str:
    """Six decimals; scientific when below 1e-4 or above 1e4 in size and not zero."""
    size = f"abs({sql})"
    return (
        f"if({size} != 0 and ({size} < 1e-4D or {size} > 1e4D), "
        f"format_string('%.6e', {sql}), format_string('%.6f', {sql}))"
    )


def percent_error(pred: str, truth: str) -> str:
    """Signed error in percent of the truth; null where truth plus epsilon is zero."""
    return f"(try_divide({pred} - {truth}, {truth} + {number(EPSILON)}) * 100)"
