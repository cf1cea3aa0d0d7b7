"""Feature and column shaping: polynomial terms, list columns, output families."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from emulon.functions.columns import as_double, cells_to_rows, number, quoted, replace_columns, text

# Names of the output families.
FAMILIES = (
    "TCP_A_pos_list",
    "TCP_B_pos_list",
    "TCP_C_pos_list",
    "TCP_X_pos_list",
    "TCP_Y_pos_list",
    "TCP_Z_pos_list",
)

LIST_TEXT = r"^\s*\[.*\]\s*$"


def polynomial_terms(
    inputs: Sequence[str], degree: int, interaction_only: bool = False, include_bias: bool = True
) -> list[tuple[str, ...]]:
    """All products of up to ``degree`` inputs, by degree; the empty product is the bias."""
    choose = combinations if interaction_only else combinations_with_replacement
    lowest = 0 if include_bias else 1
    return [term for d in range(lowest, degree + 1) for term in choose(inputs, d)]


def term_name(term: Sequence[str]) -> str:
    if not term:
        return "1"
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in Counter(term).items())


def term_sql(term: Sequence[str]) -> str:
    return " * ".join(map(as_double, term)) if term else number(1)


def expand_polynomial(
    df: DataFrame,
    inputs: Sequence[str],
    degree: int = 2,
    interaction_only: bool = False,
    include_bias: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One projection with a column per polynomial term."""
    terms = polynomial_terms(inputs, degree, interaction_only, include_bias)
    return df.selectExpr(*map(quoted, keep), *[f"{term_sql(t)} as {quoted(term_name(t))}" for t in terms])


def list_columns(df: DataFrame) -> list[str]:
    """Columns that hold lists: arrays by type, text when any cell looks like a list."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if texts:
        row = df.agg(*[F.bool_or(F.col(c).rlike(LIST_TEXT)).alias(f"t{i}") for i, c in enumerate(texts)]).head()
        arrays += [c for i, c in enumerate(texts) if row[f"t{i}"]]
    return [c for c in df.columns if c in arrays]


def as_list(df: DataFrame, column: str) -> str:
    """The column as ``array<double>``; text cells are read as number lists with None for missing."""
    if isinstance(df.schema[column].dataType, ArrayType):
        return f"cast({quoted(column)} as array<double>)"
    return f"from_json(regexp_replace({quoted(column)}, 'None', 'null'), 'array<double>')"


def expand_lists(
    df: DataFrame, columns: Sequence[str] | None = None, widths: dict[str, int] | None = None
) -> DataFrame:
    """Replace list columns by ``name_0 .. name_{L-1}``, short rows padded with null.

    L is the longest list; give ``widths`` to save the scan that finds it.
    """
    columns = list(columns) if columns is not None else list_columns(df)
    if not columns:
        return df
    widths = dict(widths or {})
    unknown = [c for c in columns if c not in widths]
    if unknown:
        row = df.selectExpr(*[f"max(size({as_list(df, c)})) as w{i}" for i, c in enumerate(unknown)]).head()
        widths.update({c: max(row[f"w{i}"] or 0, 0) for i, c in enumerate(unknown)})
    # Each list is read once, then its cells are taken out by position.
    read = replace_columns(df, {c: as_list(df, c) for c in columns})
    kept = [quoted(c) for c in df.columns if c not in columns]
    new = [f"get({quoted(c)}, {i}) as {quoted(f'{c}_{i}')}" for c in columns for i in range(widths[c])]
    return read.selectExpr(*kept, *new)


def family_of(name: str, families: Sequence[str] = FAMILIES) -> str | None:
    """The family whose name occurs in the column name."""
    return next((f for f in families if f in name), None)


def family_values(
    df: DataFrame, key: str, columns: Sequence[str], families: Sequence[str] = FAMILIES
) -> DataFrame:
    """Long table ``(key, family, output, value)`` of the columns that belong to a family."""
    cells = [
        f"struct({text(family_of(c, families))} as family, {text(c)} as output, {as_double(c)} as value)"
        for c in columns
        if family_of(c, families)
    ]
    if not cells:
        raise ValueError("no column belongs to a family")
    return cells_to_rows(df, cells, [key])
