"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. The corpus frequency of every word of the test items is counted over all
   documents.  An item's ``SEED``-word grams are rare if, with words drawn at
   these frequencies, one would turn up less than once in ``1 / CHANCE``
   words; an item without such a gram uses its ``FEW`` rarest.  Rarity comes
   from single words, so that a passage that leaked into many documents keeps
   its seeds.
2. Every document is searched for seeds.  A hit fixes an item and roughly
   where in the document the item would begin.
3. Smith-Waterman alignment of the item's words with the passage around it
   (match 1, mismatch and gap -0.5) gives the score: its best local score over
   the item's length, 1 for a verbatim copy.  A pair is reported if the score
   reaches the threshold, or if the local score itself, of whatever share of a
   long item, reaches ``RUN`` words.

Items of fewer than ``SEED`` words have no seed; they are searched exactly, by
their whole word sequence.

Words are runs outside white space and ASCII punctuation, A-Z in lower case.
Test items are handled in blocks of at most ``BLOCK`` items, and only one
block's words and seeds are sent to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import prepare
from ratestat.llm.textops import (LOWER, doc_chunks, ragged_range, rolling_hashes, run_starts, signed, text_buffers,
                                  word_hashes, word_spans)

SEED, CHANCE, FEW = 3, 1e-6, 4
THRESHOLD, RUN = 0.5, 30
BLOCK = 20_000
BATCH = 1024
PENALTY = np.float32(0.5)

_FOLD = LOWER.copy()
_FOLD[[i for i in range(33, 127) if not chr(i).isalnum()]] = 0x20


def _folded_words(off, raw):
    folded = _FOLD[raw]
    starts, ends, word_off = word_spans(off, folded)
    return word_hashes(folded, starts, ends), word_off


class Items:
    """The words of a block of test items."""

    def __init__(self, rows):
        self.ids = np.array([r["item_id"] for r in rows], dtype=np.int64)
        off, raw = text_buffers(pa.array([r["text"] for r in rows], pa.string()))
        self.words, self.off = _folded_words(off, raw)
        self.vocabulary = np.unique(self.words)

    def seeds(self, counts: dict, total: int):
        """(sorted hashes, item, place): the rare grams of all items."""
        share = np.array([max(counts.get(int(w), 0), 1) for w in signed(self.vocabulary)]) / max(total, 1)
        logs = np.log(share)[np.searchsorted(self.vocabulary, self.words)]
        at = run_starts(self.off, SEED)
        item = np.searchsorted(self.off, at, side="right") - 1
        chance = sum(logs[at + k] for k in range(SEED)) if len(at) else np.zeros(0)
        order = np.lexsort((chance, item))
        rank = np.empty(len(at), dtype=np.int64)
        first = np.searchsorted(item[order], item[order])
        rank[order] = np.arange(len(at)) - first
        keep = (chance <= np.log(CHANCE)) | (rank < FEW)
        at, item = at[keep], item[keep]
        grams = rolling_hashes(self.words, SEED)[at]
        order = np.argsort(grams, kind="stable")
        return grams[order], item[order], (at - self.off[item])[order]


    def short(self, width: int):
        """(sorted hashes, item) of the items of ``width`` words."""
        item = np.flatnonzero(np.diff(self.off) == width)
        grams = rolling_hashes(self.words, width)[self.off[item]] if len(item) else self.words[:0]
        order = np.argsort(grams, kind="stable")
        return grams[order], item[order]


def _word_counts(vocabulary):
    def emit(batches):
        counts, total = np.zeros(len(vocabulary) + 1, dtype=np.int64), 0
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            for _, _, o, r in doc_chunks(off, raw):
                words, _ = _folded_words(o, r)
                total += len(words)
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                counts += np.bincount(np.where(vocabulary[at] == words, at, len(vocabulary)), minlength=len(counts))
        seen = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(signed(vocabulary[seen])), pa.array(counts[seen]),
                                          pa.array(np.zeros(len(seen), np.int64))], names=["word", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([total])],
                                         names=["word", "n", "total"])
    return emit


def align(items: np.ndarray, passages: np.ndarray):
    """Best local alignment score of each row of ``items`` (word hashes, 0 as
    filler) with the same row of ``passages`` (1 as filler), and the place in
    the passage where it ends."""
    n, width = passages.shape
    ramp = PENALTY * np.arange(width, dtype=np.float32)
    above = np.zeros((n, width + 1), dtype=np.float32)
    best, end = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.int64)
    for i in range(items.shape[1]):
        word = items[:, i:i + 1]
        score = above[:, :-1] + np.where(passages == word, np.float32(1), -PENALTY)
        np.maximum(score, above[:, 1:] - PENALTY, out=score)
        np.maximum(score, 0, out=score)
        score += ramp
        np.maximum.accumulate(score, axis=1, out=score)
        score -= ramp
        above[:, 1:] = np.where(word != 0, score, 0)
        at = above[:, 1:].argmax(axis=1)
        top = above[np.arange(n), at + 1]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _matches(grams, found):
    """(positions in ``found``, positions in the sorted ``grams``) of all
    equal pairs."""
    lo = np.searchsorted(grams, found)
    counts = np.searchsorted(grams, found, side="right") - lo
    return np.repeat(np.arange(len(found)), counts), ragged_range(lo, counts)


def _passages(items: Items, seeds, threshold, run):
    grams, seed_item, seed_place = seeds
    lengths = np.diff(items.off)
    whole = [(width, *items.short(width)) for width in range(1, SEED)]

    def exact(words, word_off):
        """(document, item, end) of the first copy of each short item."""
        for width, sequences, item in whole:
            at = run_starts(word_off, width) if len(item) else words[:0]
            if not len(at):
                continue
            hit, which = _matches(sequences, rolling_hashes(words, width)[at])
            doc = np.searchsorted(word_off, at[hit], side="right") - 1
            _, first = np.unique(np.stack([doc, item[which]]), axis=1, return_index=True)
            yield from zip(doc[first], item[which][first], at[hit][first] + width - word_off[doc[first]])

    def hits(words, word_off):
        """Distinct (document, item, passage number) with a seed hit; a
        passage starts at a multiple of the item's length."""
        at = run_starts(word_off, SEED)
        found = rolling_hashes(words, SEED)[at] if len(at) else words[:0]
        hit, which = _matches(grams, found)
        at = at[hit]
        doc = np.searchsorted(word_off, at, side="right") - 1
        item = seed_item[which]
        begin = at - word_off[doc] - seed_place[which]
        return np.unique(np.stack([doc, item, begin // lengths[item]]), axis=1)

    def emit(batches):
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, o, r in doc_chunks(off, raw):
                words, word_off = _folded_words(o, r)
                doc, item, number = hits(words, word_off)
                order = np.argsort(lengths[item], kind="stable")
                found = {(d, i): (1.0, -int(end)) for d, i, end in exact(words, word_off)}
                for k in range(0, len(order), BATCH):
                    part = order[k:k + BATCH]
                    d, i, num = doc[part], item[part], number[part]
                    size = lengths[i]
                    longest = int(size.max())
                    margin = longest // 4 + 4
                    place = np.arange(longest)
                    q = np.where(place < size[:, None], items.words[np.minimum(items.off[i][:, None] + place,
                                                                               len(items.words) - 1)], 0)
                    first = word_off[d] + num * size - margin
                    spot = first[:, None] + np.arange(2 * longest + 2 * margin)
                    inside = (spot >= word_off[d][:, None]) & (spot < word_off[d + 1][:, None])
                    p = np.where(inside, words[np.clip(spot, 0, len(words) - 1)], 1)
                    best, end = align(q, p)
                    score = best / size
                    for j in np.flatnonzero((score >= threshold) | (best >= run)):
                        key, value = (d[j], i[j]), (float(score[j]), -int(first[j] + end[j] + 1 - word_off[d[j]]))
                        found[key] = max(found.get(key, value), value)
                rows = sorted(found.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[a + d] for (d, _), _ in rows], pa.int64()),
                     pa.array([int(items.ids[i]) for (_, i), _ in rows], pa.int64()),
                     pa.array([v[0] for _, v in rows], pa.float64()),
                     pa.array([-v[1] for _, v in rows], pa.int64())], names=["doc_id", "item_id", "score", "end_word"])
    return emit


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text", run: float = RUN) -> DataFrame:
    """(doc_id, item_id, score, end_word) for each document and test item
    whose alignment scores ``threshold`` or more, or ``run`` words or more in
    itself; ``end_word`` is the number of words up to the end of the best
    passage (the first of equals).

    Documents with null or empty text, or a null id, match nothing, and so do
    items with a null id or no word.  Items of fewer than ``SEED`` words match
    where their words stand in a row.  Items that repeat an id
    are matched each and reported once at their best score; so are rows that
    repeat a document id.
    """
    spark = prepare(docs)
    schema = "doc_id long, item_id long, score double, end_word long"
    base = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .where("doc_id is not null and text is not null"))
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id is not null and text is not null"))
    blocks = -(-items.count() // BLOCK)
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(mine.collect(), key=lambda r: (r["item_id"], r["text"]))
        part = Items(rows)
        if not len(part.words):
            continue
        counted = base.mapInArrow(_word_counts(part.vocabulary), "word long, n long, total long").groupBy("word").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        total = sum(r["total"] for r in counted)
        seeds = part.seeds({r["word"]: r["n"] for r in counted if r["word"] is not None}, total)
        found = base.mapInArrow(_passages(part, seeds, threshold, run), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", (-F.col("end_word")).alias("e")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.e")).alias("end_word"))


def op10_decontaminate(spark, sf_dir):
    """Contaminated documents with the test items they hold."""
    from ratestat.llm.common import documents
    from ratestat.sources.tables import read_table
    return decontaminate(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
