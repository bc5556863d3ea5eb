"""Deterministic hash draws.

All randomness is keyed: a draw is a hash of (seed, identifiers), so results
do not move with partitioning, retries or executor loss.  The 60-bit md5
prefix is also computable in plain SQL engines, which lets oracles replay
exactly the same draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ratestat.session import ship_package

HASH_BITS = 60


def _as_col(c) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def hash_key(*parts) -> Column:
    """':'-joined text of the parts (the hashed message)."""
    return F.concat_ws(":", *[_as_col(p).cast("string") for p in parts])


def hash60(*parts) -> Column:
    """Non-negative 60-bit integer from md5 of the ':'-joined parts."""
    digest = F.md5(hash_key(*parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


#: Draws by the billion are mixed from integers instead: multiply, xor with
#: the high bits, keep 31 bits.  Every product stays below 2**62, so that any
#: SQL engine replays it.
DRAW_BITS = 31
DRAWS = 2**DRAW_BITS
SHIFTS = (16, 13, 17)


def mix_keys(*parts) -> list[int]:
    """Odd multipliers from the md5 of ':'-joined parts."""
    text = ":".join(str(p) for p in parts)
    digests = [hashlib.md5(f"{text}:{i}".encode()).hexdigest() for i in range(len(SHIFTS) + 1)]
    return [(2**30 + int(d[:15], 16) % 2**29) | 1 for d in digests]


def mix_numbers(number: np.ndarray, keys: Sequence[int]) -> np.ndarray:
    """Draws in [0, DRAWS) that ``number`` (0 <= number < 2**62) and the keys
    fix."""
    return stir((number & (DRAWS - 1)) * keys[0] + ((number >> DRAW_BITS) * keys[1] & (DRAWS - 1)), keys)


def stir(out: np.ndarray, keys: Sequence[int]) -> np.ndarray:
    """The rounds of :func:`mix_numbers` after its first sum, in place."""
    out &= DRAWS - 1
    for key, shift in zip(keys[1:], SHIFTS):
        out ^= out >> shift
        out *= key
        out &= DRAWS - 1
    out ^= out >> SHIFTS[0]
    return out


def mix(spark: SparkSession, number: Column, *lanes: Sequence[int]) -> Column:
    """:func:`mix_numbers` of a column, one lane of 31 bits per key list (at
    most two).  Numpy does it batch by batch: as a column expression every
    xor would write its input out twice."""
    ship_package(spark)

    def draw(batch: pd.Series) -> pd.Series:
        values = batch.to_numpy(dtype="int64")
        out = np.zeros(len(values), dtype="int64")
        for keys in lanes:
            out = (out << DRAW_BITS) + mix_numbers(values, keys)
        return pd.Series(out)
    return F.pandas_udf(draw, "long")(number)


def mix_sql(number: str, keys: Sequence[int]) -> str:
    """:func:`mix` as SQL text."""
    out = f"(({number}) % {DRAWS} * {keys[0]} + (({number}) >> {DRAW_BITS}) * {keys[1]} % {DRAWS}) % {DRAWS}"
    for key, shift in zip(keys[1:], SHIFTS):
        out = f"xor({out}, ({out}) >> {shift}) * {key} % {DRAWS}"
    return f"xor({out}, ({out}) >> {SHIFTS[0]})"
