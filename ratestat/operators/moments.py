"""Block accumulators of first and second moments.

One Arrow pass turns each task's rows into numpy blocks and keeps one small
state: row count, means and centred cross products.  A block's products are
taken around its own means, and two states are merged by the pairwise
mean-shift formula, so nothing cancels and no earlier pass for the means is
needed.  Tasks' states are merged in two grouped steps, so that no task reads
more than about the square root of all of them.

``complete_moments`` uses the rows without a null; ``pairwise_moments`` keeps
all moments for each pair of columns over the rows where both have a value,
by products with the 0/1 mask of values.  ``newton_sums`` adds up a weighted
logistic loss with its gradient and Hessian in the same manner.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.operators.common import col
from ratestat.session import ship_package

BLOCK = 1 << 14       # rows of one numpy block
FAN = 256             # partial states that the first merge leaves


# ------------------------------------------------------------ complete rows
def block_moments(x: np.ndarray) -> np.ndarray:
    """State [n, means, centred cross products] of a block without gaps."""
    n, p = x.shape
    first = x[0] if n else np.zeros(p)     # a constant column leaves exact zeros
    x = x - first
    mean = x.mean(axis=0) if n else np.zeros(p)
    x = x - mean
    return np.concatenate([[n], first + mean, (x.T @ x).ravel()])


def merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two blocks' rows together."""
    if a[0] == 0 or b[0] == 0:
        return b if a[0] == 0 else a
    p = _width(len(a), 1, 1, 1)
    n = a[0] + b[0]
    shift = b[1:p + 1] - a[1:p + 1]
    cross = a[p + 1:] + b[p + 1:] + np.outer(shift, shift).ravel() * (a[0] * b[0] / n)
    return np.concatenate([[n], a[1:p + 1] + shift * (b[0] / n), cross])


def _width(size: int, squares: int, lines: int, ones: int) -> int:
    """p with squares * p**2 + lines * p + ones = size."""
    return int(round((-lines + (lines * lines + 4 * squares * (size - ones)) ** 0.5) / (2 * squares)))


def unpack_moments(state) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, centred cross products); of :func:`newton_sums` (loss,
    gradient, Hessian)."""
    state = np.asarray(state, dtype=float)
    p = _width(len(state), 1, 1, 1)
    return state[0], state[1:p + 1], state[p + 1:].reshape(p, p)


# ----------------------------------------------------------- pairwise rows
_PAIR_PARTS = ("n", "mean", "cross", "spread", "low", "high")


def block_pairs(x: np.ndarray) -> np.ndarray:
    """State of a block with gaps (NaN).  Entry (i, j) speaks of the rows
    where columns i and j both have a value: their number, column i's mean,
    the centred products of i and j, the centred squares, least and greatest
    value of i."""
    p = x.shape[1]
    known = ~np.isnan(x)
    mask = known.astype(float)
    n = mask.T @ mask
    first = np.where(known.any(axis=0), x[known.argmax(axis=0), np.arange(p)] if len(x) else 0, 0)
    y = np.where(known, x - first, 0)
    mean = y.sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
    y = np.where(known, y - mean, 0)
    some = np.maximum(n, 1)
    total = y.T @ mask                     # of column i where j is known
    cross = y.T @ y - total * total.T / some
    spread = (y * y).T @ mask - total * total / some
    low, high = np.empty((p, p)), np.empty((p, p))
    up, down = np.where(known, x, np.inf), np.where(known, x, -np.inf)
    whole_low, whole_high = (up.min(axis=0), down.max(axis=0)) if len(x) else (np.full(p, np.inf), np.full(p, -np.inf))
    for j in range(p):
        if known[:, j].all():
            low[:, j], high[:, j] = whole_low, whole_high
        else:
            at = known[:, j]
            low[:, j] = up[at].min(axis=0) if at.any() else np.inf
            high[:, j] = down[at].max(axis=0) if at.any() else -np.inf
    return np.stack([n, first[:, None] + mean[:, None] + total / some, cross, spread, low, high]).ravel()


def merge_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = _width(len(a), len(_PAIR_PARTS), 0, 0)
    a, b = a.reshape(-1, p, p), b.reshape(-1, p, p)
    n = a[0] + b[0]
    part = b[0] / np.maximum(n, 1)
    shift = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0)
    mean = np.where(a[0] > 0, a[1], b[1]) + shift * part
    weight = a[0] * part
    return np.stack([n, mean, a[2] + b[2] + shift * shift.T * weight, a[3] + b[3] + shift * shift * weight,
                     np.minimum(a[4], b[4]), np.maximum(a[5], b[5])]).ravel()


def unpack_pairs(state) -> dict[str, np.ndarray]:
    """The parts of a pairwise state by name, each a square matrix."""
    state = np.asarray(state, dtype=float)
    p = _width(len(state), len(_PAIR_PARTS), 0, 0)
    return dict(zip(_PAIR_PARTS, state.reshape(-1, p, p)))


# ------------------------------------------------------------ the Spark pass
def numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """The columns as one matrix of doubles, null as NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])


def _task_states(names, one: Callable, merge: Callable, key: str | None, complete: bool):
    def emit(batches):
        held: dict = {}
        for batch in batches:
            x = numbers(batch, names)
            keys = numbers(batch, [key])[:, 0] if key else np.zeros(len(x))
            # told apart here: a filter on many columns would be slow to plan
            use = ~np.isnan(keys)
            if complete:
                use &= ~np.isnan(x).any(axis=1)
            x, keys = x[use], keys[use]
            for k in np.unique(keys):
                mine = x[keys == k] if key else x
                for a in range(0, len(mine), BLOCK):
                    state = one(mine[a:a + BLOCK])
                    held[int(k)] = merge(held[int(k)], state) if int(k) in held else state
        if held:
            part = TaskContext.get().partitionId() % FAN
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([part] * len(held), pa.int64()),
                 pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], names=["key", "part", "state"])
    return emit


def _merged(merge: Callable):
    def run(table: pa.Table) -> pa.Table:
        state = None
        for row in table.column("state"):
            one = np.asarray(row.values)
            state = one if state is None else merge(state, one)
        return pa.table({"key": table.column("key")[:1], "part": table.column("part")[:1],
                         "state": pa.array([state.tolist()], pa.list_(pa.float64()))})
    return run


def merge_states(states: DataFrame, merge: Callable) -> DataFrame:
    """(key, part, state) to one state a key, in two grouped steps."""
    for keys in (["key", "part"], ["key"]):
        states = states.groupBy(*keys).applyInArrow(_merged(merge), states.schema)
    return states.select("key", "state")


def _moments(df: DataFrame, cols: Sequence[str], one, merge, key: str | None, complete: bool) -> DataFrame:
    ship_package(df.sparkSession)
    names = [f"_v{i}" for i in range(len(cols))]
    picked = [col(c).cast("double").alias(n) for c, n in zip(cols, names)]
    rows = df.select(*picked, *([col(key).cast("double").alias("_key")] if key else []))
    states = rows.mapInArrow(_task_states(names, one, merge, "_key" if key else None, complete),
                             "key long, part long, state array<double>")
    return merge_states(states, merge)


def complete_moments(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    """(key, state) with the moments of ``cols`` over the rows that have all
    of them (no null, no NaN), for each whole-numbered value of ``key`` (0 if
    not given; rows with a null one are left out).  Meant for few keys: a task
    holds one state for each.  Without rows there is no state."""
    return _moments(df, cols, block_moments, merge_moments, key, True)


def pairwise_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(key, state) with the moments of each pair of ``cols`` over the rows
    that have both; see :func:`block_pairs`."""
    return _moments(df, cols, block_pairs, merge_pairs, None, False)


# ----------------------------------------------------------- logistic sums
def block_newton(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """[loss, gradient, Hessian] of rows (features, label, weight) at ``beta``
    (intercept first)."""
    design = np.column_stack([np.ones(len(x)), x[:, :-2]])
    y, w = x[:, -2], x[:, -1]
    eta = design @ beta
    tail = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1, tail) / (1 + tail)
    loss = w @ (np.maximum(eta, 0) + np.log1p(tail) - eta * y)
    h = w * tail / (1 + tail) ** 2
    return np.concatenate([[loss], design.T @ (w * (p - y)), (design.T @ (design * h[:, None])).ravel()])


def newton_sums(rows: DataFrame, names: Sequence[str], beta: np.ndarray) -> DataFrame:
    """(key, state): the summed :func:`block_newton` over the rows of
    ``names`` (features, label, weight; no nulls) at ``beta``."""
    ship_package(rows.sparkSession)
    states = rows.select(*names).mapInArrow(_task_states(names, lambda x: block_newton(x, beta), np.add, None, False),
                                            "key long, part long, state array<double>")
    return merge_states(states, np.add)
