"""Helpers shared by the registered driver queries and their SQL oracles.

Both sides round doubles the same way (6 decimals; ``log10_*`` columns 4
decimals) so that results computed in a different order by another engine
compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ratestat.operators.common import col

DIGITS = 6          # decimals kept for values below 10^(SIG_DIGITS - DIGITS)
SIG_DIGITS = 9      # significant digits kept for larger magnitudes
LOG_DIGITS = 4


def _round_value(c):
    """Round to min(DIGITS decimals, SIG_DIGITS significant digits) using
    only exact powers of ten, so two engines given values a few ulps apart
    agree: x*10^d rounded then divided (d >= 0), or x/10^-d rounded then
    multiplied (d < 0)."""
    a = F.abs(c)
    d = F.least(F.lit(DIGITS), F.lit(SIG_DIGITS - 1) - F.floor(F.log10(a)))
    up = F.pow(F.lit(10.0), d.cast("double"))
    down = F.pow(F.lit(10.0), (-d).cast("double"))
    r = F.when(d >= 0, F.round(c * up) / up).otherwise(F.round(c / down) * down)
    special = c.isNull() | F.isnan(c) | (a == float("inf")) | (c == 0)
    return F.when(special, c).otherwise(r)


def finalize(df: DataFrame) -> DataFrame:
    """Round every floating column of a query result (``log10_*`` columns
    to LOG_DIGITS decimals)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = col(f.name).cast("double")
            r = F.round(c, LOG_DIGITS) if f.name.startswith("log10_") else _round_value(c)
            out.append(r.alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sql_round_value(x: str) -> str:
    d = f"least({DIGITS}, {SIG_DIGITS - 1} - floor(log10(abs({x}))))"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) OR {x} = 0 THEN {x} "
            f"WHEN {d} >= 0 THEN round({x} * pow(10, {d})) / pow(10, {d}) "
            f"ELSE round({x} / pow(10, -{d})) * pow(10, -{d}) END")


def sql_round(sql: str, doubles: list[str]) -> str:
    """Wrap an oracle query so the listed double columns are rounded like
    :func:`finalize`."""
    if not doubles:
        return sql
    parts = []
    for c in doubles:
        x = f"CAST({qi(c)} AS DOUBLE)"
        expr = f"round({x}, {LOG_DIGITS})" if c.startswith("log10_") else _sql_round_value(x)
        parts.append(f"{expr} AS {qi(c)}")
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) _r"


# ------------------------------------------------- tail quadrature for SQL
QUAD_POINTS = 20000


def _log_density(kind: str, x: str, d1: str = "d1", d2: str = "d2") -> str:
    if kind == "t":
        return (f"(lgamma(({d1} + 1) / 2) - lgamma({d1} / 2) - 0.5 * ln({d1} * pi())"
                f" - ({d1} + 1) / 2 * ln(1 + ({x}) * ({x}) / {d1}))")
    if kind == "f":
        return (f"(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2)"
                f" + {d1} / 2 * ln({d1} / {d2}) + ({d1} / 2 - 1) * ln({x})"
                f" - ({d1} + {d2}) / 2 * ln(1 + {d1} * ({x}) / {d2}))")
    if kind == "norm":
        return f"(-0.5 * ({x}) * ({x}) - 0.5 * ln(2 * pi()))"
    raise ValueError(kind)


def tail_sql(src: str, keys: list[str], kind: str, stat: str, d1: str = "NULL",
             d2: str = "NULL") -> str:
    """SQL computing ``tail = P(X > a)`` by midpoint quadrature on
    x = a + u / (1 - u), for every row of ``src``; ``a`` = ``stat`` (the
    caller passes abs() for symmetric laws).  Output: keys..., a, tail."""
    key_list = ", ".join(qi(k) for k in keys)
    key_sel = (key_list + ", ") if keys else ""
    x = "(s.a + g.u / (1 - g.u))"
    dens = _log_density(kind, x, "s.d1", "s.d2")
    return f"""SELECT {key_sel}s.a,
  sum(exp({dens}) / ((1 - g.u) * (1 - g.u))) / {QUAD_POINTS} AS tail
FROM (SELECT {key_sel}CAST({stat} AS DOUBLE) AS a, CAST({d1} AS DOUBLE) AS d1,
             CAST({d2} AS DOUBLE) AS d2 FROM {src}) s,
     (SELECT (i + 0.5) / {QUAD_POINTS} AS u FROM range({QUAD_POINTS}) r(i)) g
GROUP BY {key_sel}s.a"""


def log_tail_sql(src: str, kind: str, stat: str, d1: str = "NULL", d2: str = "NULL") -> str:
    """:func:`tail_sql` in logarithms, summed around the greatest term: one
    row (a, log_tail) with ln P(X > a), also where P is below the least
    double."""
    dens = _log_density(kind, "(s.a + g.u / (1 - g.u))", "s.d1", "s.d2")
    return f"""SELECT max(a) AS a, max(top) + ln(sum(exp(v - top))) - ln({QUAD_POINTS}) AS log_tail
FROM (SELECT s.a, {dens} - 2 * ln(1 - g.u) AS v, max({dens} - 2 * ln(1 - g.u)) OVER () AS top
  FROM (SELECT CAST({stat} AS DOUBLE) AS a, CAST({d1} AS DOUBLE) AS d1, CAST({d2} AS DOUBLE) AS d2 FROM {src}) s,
       (SELECT (i + 0.5) / {QUAD_POINTS} AS u FROM range({QUAD_POINTS}) r(i)) g) _v"""
