"""Static guards for the execution rules the library follows."""

import pathlib
import re

PKG = pathlib.Path(__file__).resolve().parents[1] / "ratestat"
SOURCES = {p: p.read_text() for p in PKG.rglob("*.py")}


def _lines(pattern):
    rx = re.compile(pattern)
    return [(f"{p.relative_to(PKG)}:{i + 1}", line) for p, src in SOURCES.items()
            for i, line in enumerate(src.splitlines())
            if rx.search(line) and not line.lstrip().startswith("#")]


def _hits(pattern):
    return [where for where, _ in _lines(pattern)]


def test_no_local_checkpoint():
    assert _hits(r"\.localCheckpoint\(") == []


def test_no_cross_joins():
    assert _hits(r"\.crossJoin\(") == []


def test_no_rdd_or_pandas_round_trips():
    assert _hits(r"\.rdd\b") == []
    assert _hits(r"\.toPandas\(") == []


def test_no_driver_loops_over_collected_rows():
    # collecting an aggregate (k group rows) is fine; iterating raw rows is not
    raw = [where for where, line in _lines(r"for .* in .*\.collect\(\)") if ".agg(" not in line]
    assert raw == []


def test_checkpoint_dir_taken_from_session():
    src = SOURCES[PKG / "session.py"]
    assert 'spark.conf.get("spark.checkpoint.dir"' in src
