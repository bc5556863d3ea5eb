"""Column-bind tables by row position (pandas ``concat(axis=1)``).

There is no key, so each input needs its row numbers and the inputs are
joined on them with a full outer join, so a shorter input is padded with
nulls.  CSV inputs bring their record numbers, from files of any number and
size (:mod:`ratestat.sources.csvranges`).  Other inputs must be scans of a
single file and are numbered in scan order
(:func:`ratestat.operators.indexing.scan_row_index`): a folder of several
files is packed by split size and has no defined row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ratestat.operators.common import col
from ratestat.operators.indexing import scan_row_index

_NUMBERED = "_ratestat_numbered"


def with_row_numbers(frame: DataFrame, numbered: DataFrame) -> DataFrame:
    """``frame``, remembering ``numbered``: the same rows after a first column
    of row numbers."""
    setattr(frame, _NUMBERED, numbered)
    return frame


def _numbered(frame: DataFrame, idx: str) -> DataFrame:
    known = getattr(frame, _NUMBERED, None)
    if known is not None:
        return known.select(col(known.columns[0]).alias(idx), *[col(c) for c in known.columns[1:]])
    if idx in frame.columns:
        return frame
    if len(frame.inputFiles()) > 1:
        raise ValueError("a table of several files has no row order; join it on a key")
    return scan_row_index(frame, idx)


def positional_bind(*frames: DataFrame, idx: str = "row_idx") -> DataFrame:
    """The frames' columns side by side with the row number ``idx``.  A frame
    that has a column ``idx`` is bound by it."""
    if not frames:
        raise ValueError("nothing to bind")
    out = _numbered(frames[0], idx)
    for f in frames[1:]:
        out = out.join(_numbered(f, idx), idx, "full_outer")
    return out
