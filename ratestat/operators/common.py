"""Shared plumbing: size-checked broadcast, quoting, one-row parameter
frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ratestat.session import materialize

# Largest row count we hint as a broadcast side without further checks.
DEFAULT_BROADCAST_ROWS = 1_000_000


def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str | Column) -> Column:
    """Column by exact name (names may contain dots, spaces or quotes)."""
    if isinstance(name, Column):
        return name
    return F.col(q(name))


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after proving the side holds at most ``max_rows``
    rows (a bounded ``limit(max_rows + 1).count()`` probe).  Larger sides are
    left to the planner (sort-merge / AQE)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def _literal(value, dtype) -> Column:
    if isinstance(value, Row):
        fields = dtype.fields
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in fields])
    return F.lit(value).cast(dtype)


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate: a few
    numbers) to every row as typed literals.

    The row is fetched once -- a fixed-size result -- so the main plan has
    no join and no subquery, and the values compile into the generated code.
    (A scalar subquery referenced by hundreds of expressions made planning
    slow; a broadcast nested-loop join was the other option.)"""
    rows = one_row.take(2)
    if len(rows) != 1:
        raise ValueError(f"expected exactly one row, got {len(rows)}")
    row = rows[0]
    attached = [_literal(row[f.name], f.dataType).alias(f.name) for f in one_row.schema.fields]
    return df.select(*[col(c) for c in df.columns], *attached)


def sum_columns(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner", small: bool = False) -> DataFrame:
    """Join on ``keys`` with null equal to null, so that a null group keeps
    its rows.  ``small`` marks a right side of one row per group: it is
    written first, so that the planner broadcasts or shuffles it by the size
    of its file, whatever the number of groups."""
    right = materialize(right) if small else right
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.select(*[col(k).alias(n) for k, n in names.items()], *[col(c) for c in right.columns if c not in names])
    on = None
    for k, n in names.items():
        same = col(k).eqNullSafe(col(n))
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*names.values())
