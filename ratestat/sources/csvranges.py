"""Quoted CSV read in byte ranges, with global record numbers.

A quoted field may hold line ends, so a reader that starts in the middle of a
file cannot tell whether it is inside one.  Here

1. every byte range (Spark's own splits of the files, cut at line ends) is
   read under both assumptions and yields, for each, the number of records
   that end in it and whether it ends inside a quoted field: one short row a
   range;
2. composing these rows in file order fixes every range's true state and the
   number of its first record;
3. the ranges are read again, each on its own, and emit their records.  A
   record that crosses a border leaves one piece in each range it touches;
   only those pieces are shuffled and put together.

Fields begin with a quote or are not quoted; a quote inside an unquoted field
is a plain character.  Records end with a line feed, a carriage return before
it is dropped; empty lines between records are skipped.  A quote left open
ends with its file.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestat.session import ship_package

RANGE_SQL = ("path string, start long, records_out long, inside_out boolean, records_in long, inside_in boolean")
BATCH_RECORDS = 4096


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open after ``line``; ``inside`` says whether
    one was before it."""
    opening, at = sep + '"', 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(opening)
            if at < 0:
                return False
            at += len(sep)
        at += 1
    while True:  # ``at`` is inside a quoted field
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at = line.find(opening, at + 1)
        if at < 0:
            return False
        at += len(opening)


def _blank(line: str) -> bool:
    return line == "" or line == "\r"


class _Reading:
    """One range read under one assumption."""

    def __init__(self, inside: bool):
        self.inside, self.records = inside, 0

    def line(self, line: str, sep: str) -> None:
        was, self.inside = self.inside, ends_inside(line, self.inside, sep)
        if not self.inside and (was or not _blank(line)):
            self.records += 1


def _lines(batches):
    """(path, range start, line) in the order of the file."""
    for batch in batches:
        yield from zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist())


def _summaries(sep):
    def emit(batches):
        key, readings, out = None, None, []

        def done():
            a, b = readings
            out.append({"path": key[0], "start": key[1], "records_out": a.records, "inside_out": a.inside,
                        "records_in": b.records, "inside_in": b.inside})
        for path, start, line in _lines(batches):
            if (path, start) != key:
                if key is not None:
                    done()
                key, readings = (path, start), (_Reading(False), _Reading(True))
            for r in readings:
                r.line(line, sep)
        if key is not None:
            done()
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("path", pa.string()), ("start", pa.int64()), ("records_out", pa.int64()), ("inside_out", pa.bool_()),
                ("records_in", pa.int64()), ("inside_in", pa.bool_())]))
    return emit


def compose(ranges: Sequence, paths: Sequence[str], header: bool) -> dict:
    """(path, start) -> (inside, number of its first record), by composing
    the ranges' summaries in the order of ``paths`` and byte positions.  With
    ``header`` a file's first record has the number before its file's first,
    marked by the third item: the number below which the file's records are
    left out."""
    files: dict = {p: [] for p in paths}
    for r in ranges:
        files[r["path"]].append(r)
    out, number = {}, 0
    for path in paths:
        inside, first = False, number
        number -= header
        for r in sorted(files[path], key=lambda r: r["start"]):
            out[path, r["start"]] = (inside, number, first)
            number += r["records_in"] if inside else r["records_out"]
            inside = r["inside_in"] if inside else r["inside_out"]
        number = max(number + inside, first)  # a quote left open ends with its file
    return out


_RECORDS = pa.schema([("record", pa.int64()), ("piece", pa.int64()), ("line", pa.string())])


def _records(placed, sep):
    """Whole records (piece null) and the pieces of those that cross a
    range's border (piece: the range's start)."""
    def emit(batches):
        key, state, held, out = None, (False, 0, 0), [], []

        def put(piece):
            number = state[1]
            if number >= state[2]:
                out.append({"record": number, "piece": piece, "line": "\n".join(held)})

        for path, start, line in _lines(batches):
            if (path, start) != key:
                if held:
                    put(key[1])
                key, held = (path, start), []
                state = list(placed[key])
                crossing = state[0]
            was = state[0]
            state[0] = ends_inside(line, was, sep)
            if not was and not state[0] and _blank(line):
                continue
            held.append(line)
            if not state[0]:
                held[-1] = line[:-1] if line.endswith("\r") else line
                put(start if crossing else None)
                state[1], held, crossing = state[1] + 1, [], False
                if len(out) >= BATCH_RECORDS:
                    yield pa.RecordBatch.from_pylist(out, _RECORDS)
                    out = []
        if held:
            put(key[1])
        if out:
            yield pa.RecordBatch.from_pylist(out, _RECORDS)
    return emit


def read_records(spark: SparkSession, paths: str | Sequence[str], header: bool = False, sep: str = ",") -> DataFrame:
    """(record, line): every record of the files with its number from 0, over
    all ``paths`` in the given order; the files of a folder come in the order
    of their names, and no file may come twice.  With ``header`` each file's
    first record is left out.

    The driver holds one short row a byte range; each range is read twice."""
    ship_package(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = [sorted(spark.read.text(p).inputFiles()) for p in paths]
    plain = spark.read.option("lineSep", "\n").text(paths).select(
        F.input_file_name().alias("path"), F.input_file_block_start().alias("start"), "value")
    ranges = plain.mapInArrow(_summaries(sep), RANGE_SQL).toArrow().to_pylist()
    named, known = [f for group in files for f in group], {r["path"] for r in ranges}
    if len(set(named)) < len(named) or not known <= set(named):
        raise ValueError("the files of a positional read must be named once each")
    ordered = [f for f in named if f in known]
    placed = compose(ranges, ordered, header)
    found = plain.mapInArrow(_records(placed, sep), "record long, piece long, line string")
    whole = found.where("piece is null").select("record", "line")
    crossing = found.where("piece is not null").groupBy("record").agg(
        F.sort_array(F.collect_list(F.struct("piece", "line"))).alias("pieces"))
    return whole.unionByName(crossing.select("record", F.array_join("pieces.line", "\n").alias("line")))
