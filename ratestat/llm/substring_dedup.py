"""Removal of long passages that an earlier document already holds.

A window is ``width`` consecutive words of one document; it is repeated if
the same words also start in a document with a smaller id.  Every word under
a repeated window goes, so overlapping windows merge into maximal intervals.

Every window gets a Rabin-Karp hash.  So that Spark need not shuffle a row
for each, windows are first told apart by their anchor: the least hash among
the ``seed_width``-word grams inside the window.  Equal windows have equal
anchors, and neighbouring windows mostly share one, so a document is a short
list of runs (neighbouring windows with one anchor).  Spark counts runs:

1. a run (anchor, hash of all its words) that also is in a smaller document
   is repeated as a whole;
2. an anchor with one kind of run only is then settled; where it has several,
   windows can match across runs, and the windows of each kind's first
   document are counted one by one.

The windows removed are exactly those of the definition (up to 64-bit hash
collisions of a window, 128-bit ones of a run).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import prepare, staged
from ratestat.llm.textops import (doc_chunks, mix64, ragged_range, rolling_hashes, run_starts, signed,
                                  text_buffers, word_hashes, word_spans)

WIDTH, SEED_WIDTH = 50, 12
_U = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


class Windows:
    """All windows of a chunk of documents, in order: start word, document,
    anchor, and the run each belongs to."""

    def __init__(self, off, raw, width, seed_width):
        self.width = width
        self.starts, self.ends, self.word_off = word_spans(off, raw)
        self.words = word_hashes(raw, self.starts, self.ends)
        counts = np.maximum(np.diff(self.word_off) - width + 1, 0)
        self.first_word = run_starts(self.word_off, width)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        grams = rolling_hashes(self.words, seed_width)
        self.anchor = sliding_min(grams, width - seed_width + 1)[self.first_word]
        new = np.ones(len(self.first_word), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.run_first = np.flatnonzero(new)
        self.run_of = np.cumsum(new) - 1
        last = np.append(self.run_first[1:], len(new)) - 1 if len(new) else self.run_first
        a, b = self.first_word[self.run_first], self.first_word[last] + width
        self.run_key = self._run_hashes(a, b)

    def _run_hashes(self, a, b):
        """A hash of words a..b-1 for each run: its window hashes summed with
        their position in the run, and its length."""
        if len(a) == 0:
            return np.zeros(0, dtype=_U)
        spread = np.zeros(len(self.words) + 1, dtype=_U)
        place = np.multiply.accumulate(np.full(len(self.words), 0x9FB21C651E98DF25, dtype=_U))
        np.cumsum(mix64(self.words ^ _U(0x5851F42D4C957F2D)) * place, out=spread[1:])
        inverse = pow(0x9FB21C651E98DF25, -1, 1 << 64)
        back = np.multiply.accumulate(np.full(len(self.words), inverse, dtype=_U))
        return mix64((spread[b] - spread[a]) * back[a] + (b - a).astype(_U))

    def hashes(self):
        return rolling_hashes(self.words, self.width)[self.first_word]


def _chunks(batch, width, seed_width):
    off, raw = text_buffers(batch.column("text"))
    for a, b, o, r in doc_chunks(off, raw):
        yield a, b, o, r, Windows(o, r, width, seed_width)


def _distinct(doc, *columns):
    """Positions of one row for each distinct (doc, columns...)."""
    order = np.lexsort((*columns[::-1], doc))
    keep = np.ones(len(order), dtype=bool)
    if len(order):
        same = doc[order][1:] == doc[order][:-1]
        for c in columns:
            same &= c[order][1:] == c[order][:-1]
        keep[1:] = ~same
    return order[keep]


def _runs(width, seed_width):
    def emit(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, b, _, _, win in _chunks(batch, width, seed_width):
                doc, anchor = win.doc[win.run_first], win.anchor[win.run_first]
                at = _distinct(doc, anchor, win.run_key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor[at])), pa.array(signed(win.run_key[at])), pa.array(ids[a:b][doc[at]])],
                    names=["anchor", "run_key", "doc_id"])
    return emit


def _contested_windows(width, seed_width):
    def emit(batches):
        for batch in batches:
            ids, anchors = batch.column("doc_id").to_numpy(), batch.column("anchors")
            for a, b, _, _, win in _chunks(batch, width, seed_width):
                wanted = _membership(win.doc, signed(win.anchor), anchors, a, b)
                doc, hashes = win.doc[wanted], win.hashes()[wanted]
                at = _distinct(doc, hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(hashes[at])), pa.array(ids[a:b][doc[at]])], names=["hash", "doc_id"])
    return emit


def _membership(doc, values, lists, a, b):
    """For each (document, value) of documents a..b-1: is the value in the
    document's list?"""
    hit = np.zeros(len(values), dtype=bool)
    edges = np.searchsorted(doc, np.arange(b - a + 1))
    for k in range(b - a):
        cell = lists[a + k]
        if cell.is_valid and edges[k] < edges[k + 1]:
            wanted = cell.values.to_numpy(zero_copy_only=False)
            if len(wanted):
                hit[edges[k]:edges[k + 1]] = np.isin(values[edges[k]:edges[k + 1]], wanted)
    return hit


def kept_words(raw, starts, ends, word_off, keep):
    """The kept words of each document joined by one space, as an Arrow array."""
    counts = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(word_off[:-1], len(keep)))
    counts = np.where(np.diff(word_off) > 0, counts, 0)
    s, lengths = starts[keep], (ends - starts)[keep] + 1
    padded = np.append(raw, np.uint8(0x20))
    data = padded[ragged_range(s, lengths)]
    stop = np.cumsum(lengths)
    data[stop - 1] = 0x20
    last = np.cumsum(counts)
    final = stop[last[counts > 0] - 1] - 1
    sizes = np.zeros(len(counts), dtype=np.int64)
    bytes_to = np.append(0, stop)
    sizes = bytes_to[last] - bytes_to[last - counts] - (counts > 0)
    data = np.delete(data, final)
    off = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(off), pa.py_buffer(data)).cast(pa.string())


def _strip(width, seed_width):
    def emit(batches):
        for batch in batches:
            runs, windows = batch.column("runs"), batch.column("windows")
            for a, b, _, raw, win in _chunks(batch, width, seed_width):
                run_hit = _membership(win.doc[win.run_first], signed(win.run_key), runs, a, b)
                hit = run_hit[win.run_of] if len(win.run_of) else np.zeros(0, dtype=bool)
                hit |= _membership(win.doc, signed(win.hashes()), windows, a, b)
                cover = np.zeros(len(win.words) + 1, dtype=np.int64)
                first = win.first_word[hit]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + width, -1)
                gone = np.cumsum(cover)[:-1] > 0
                n_words = np.diff(win.word_off)
                total = np.append(0, np.cumsum(gone))
                n_removed = total[win.word_off[1:]] - total[win.word_off[:-1]]
                edge = np.ones(len(gone), dtype=bool)
                doc = np.repeat(np.arange(b - a), n_words)
                edge[1:] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(edge)
                stop = np.append(begin[1:], len(gone)) if len(begin) else begin
                cut = gone[begin] if len(begin) else np.zeros(0, dtype=bool)
                span_doc = doc[begin[cut]]
                base = win.word_off[span_doc]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(span_doc, np.arange(b - a + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(begin[cut] - base), pa.array(stop[cut] - base)],
                                               names=["start", "end"]))
                kept = kept_words(raw, win.starts, win.ends, win.word_off, ~gone)
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(n_words), pa.array(n_removed), spans, kept],
                    names=[*batch.schema.names[:-2], "n_words", "n_removed", "removed_spans", "kept_text"])
    return emit


def substring_dedup(docs: DataFrame, width: int = WIDTH, seed_width: int = SEED_WIDTH,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, removed_spans, kept_text) for every row.

    ``removed_spans`` lists the maximal removed intervals as [start, end) word
    numbers; ``kept_text`` is the other words joined by one space.  Null and
    empty texts have no words; rows with a null id keep all their words and
    are no source of a removal; rows that repeat an id share its verdicts but
    never remove each other.  Other columns of ``docs`` are not read.
    """
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = base.where("doc_id is not null")
    runs = staged(known.mapInArrow(_runs(width, seed_width), "anchor long, run_key long, doc_id long"), "runs")
    kinds = staged(
        runs.groupBy("anchor", "run_key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .join(runs.groupBy("anchor").agg((F.min("run_key") < F.max("run_key")).alias("contested")), "anchor")
        .where("contested or owner < last"), "run-kinds")
    gone_runs = (runs.join(kinds.where("owner < last").select("anchor", "run_key", "owner"), ["anchor", "run_key"])
                 .where("doc_id > owner").select("doc_id", "run_key", F.lit(None).cast("long").alias("hash")))
    contested = (kinds.where("contested").groupBy(F.col("owner").alias("doc_id"))
                 .agg(F.collect_set("anchor").alias("anchors")))
    windows = staged(known.join(contested, "doc_id").select("doc_id", "text", "anchors")
                     .mapInArrow(_contested_windows(width, seed_width), "hash long, doc_id long"), "windows")
    owners = staged(windows.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
                    .where("owner < last").select("hash", "owner"), "window-owners")
    gone_windows = (windows.join(owners, "hash").where("doc_id > owner")
                    .select("doc_id", F.lit(None).cast("long").alias("run_key"), "hash"))
    gone = (gone_runs.unionByName(gone_windows).groupBy("doc_id")
            .agg(F.collect_set("run_key").alias("runs"), F.collect_set("hash").alias("windows")))
    return base.join(gone, "doc_id", "left").select("doc_id", "text", "runs", "windows").mapInArrow(
        _strip(width, seed_width),
        "doc_id long, text string, n_words long, n_removed long, "
        "removed_spans array<struct<start: long, end: long>>, kept_text string")


def op5_substring_dedup(spark, sf_dir):
    """Per document: words, words under repeated 50-word windows, and the
    SHA-256 of the rest."""
    from ratestat.llm.common import documents
    out = substring_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (
  SELECT s, min(doc_id) AS owner FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 50)) AS i FROM g JOIN f ON g.s = f.s WHERE g.doc_id > f.owner
), k AS (
  SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.i) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) e
  ANTI JOIN r ON e.doc_id = r.doc_id AND e.i = r.i
  GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
