"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of ``WINDOW`` words.  A word enters as
two vectors: its own, and the maximum over the vectors of its character
4-grams and prefixes.  Two gated recurrent layers read the window in both
directions, attention pools their states, and a logistic unit scores it; the
text's score is its worst window's.

Training (numpy, on the driver) uses at most ``TOXIC`` + ``CLEAN`` labelled
documents.  Words and n-grams whose share of toxic documents is no chance
(``LEAST_Z`` standard deviations) have vectors of their own, the others share
one.  Their first coordinate starts as the log odds, which points out the
windows of a toxic document that its label speaks of; then all weights are
trained by Adam.
Words are runs outside white space and ASCII punctuation, A-Z in lower case;
one over ``LONG`` bytes is cut into overlapping pieces, each a word.  All its
4-grams count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import is_remainder, labelled_sample, prepare
from ratestat.llm.textops import (LOWER, _BYTE_CODE, _CHARS, doc_chunks, mix64, ragged_range, text_buffers, word_hashes,
                                  word_spans)

TOXIC, CLEAN = 1000, 2000
WINDOW, STRIDE = 48, 36
WORD_DIM, CHAR_DIM, HIDDEN = 4, 4, 8
GRAM_ROWS, PREFIXES = 1 << 17, (3, 5, 6)
LONG, OVERLAP = 64, 3
LEAST_Z, EPOCHS, BATCH, RATE = 5.0, 8, 256, 0.01
ACCEPT = 0.3

_FOLD = LOWER.copy()
_FOLD[[i for i in range(33, 127) if not chr(i).isalnum()]] = 0x20
_U = np.uint64


def folded_words(off, raw):
    """Words of the folded bytes; a word over ``LONG`` bytes is cut into pieces
    of that length, which share ``OVERLAP`` bytes, so that no n-gram is lost."""
    folded = _FOLD[raw]
    starts, ends, word_off = word_spans(off, folded)
    step = LONG - OVERLAP
    pieces = np.maximum(-(-(ends - starts - OVERLAP) // step), 1)
    which = np.repeat(np.arange(len(starts)), pieces)
    starts = starts[which] + ragged_range(np.zeros(len(pieces), np.int64), pieces) * step
    return folded, starts, np.minimum(ends[which], starts + LONG), np.append(0, np.cumsum(pieces))[word_off]


def gram_rows(folded, starts, ends):
    """(rows, offsets): rows of the n-gram table for each word, its prefixes
    first; row 0 is no n-gram."""
    total = np.zeros(len(folded) + 1, dtype=_U)
    np.cumsum(_BYTE_CODE[folded] * _CHARS.up(len(folded) + 1)[:len(folded)], out=total[1:])
    back = _CHARS.down(len(folded) + 1)
    before = len(PREFIXES)
    counts = before + np.maximum(ends - starts - 3, 0)
    k = ragged_range(np.zeros(len(counts), np.int64), counts)
    size = np.array([*PREFIXES, 4])[np.minimum(k, before)]
    a = np.repeat(starts, counts) + np.maximum(k - before, 0)
    b = a + size
    ok = b <= np.repeat(ends, counts)
    a, b = np.where(ok, a, 0), np.where(ok, b, 0)
    h = mix64((total[b] - total[a]) * back[a] + np.where(k == before, 77, size).astype(_U))
    return np.where(ok, 1 + (h % _U(GRAM_ROWS - 1)).astype(np.int64), 0), np.append(0, np.cumsum(counts))


def _sigmoid(x):
    return np.float32(0.5) * (1 + np.tanh(np.float32(0.5) * x))


class Network:
    """Vectors of known words (row 0: any other) and n-grams, and the
    recurrent weights."""

    def __init__(self, vocabulary, word_vectors, gram_vectors, weights, bias_only=None):
        self.vocabulary, self.words, self.grams = vocabulary, word_vectors, gram_vectors
        self.weights, self.bias_only = weights, bias_only

    def word_rows(self, hashes):
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, rows, grams, gram_off):
        return np.hstack([self.words[rows], np.maximum.reduceat(self.grams[grams], gram_off[:-1])])


def window_index(word_off):
    """(document of each window, first word, words in it): windows start
    every ``STRIDE`` words, and a text that fits one window has one."""
    n = np.diff(word_off)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    number = ragged_range(np.zeros(len(n), np.int64), count)
    first = word_off[:-1][doc] + number * STRIDE
    return doc, first, np.minimum(word_off[1:][doc] - first, WINDOW)


def recurrent(x, mask, u, keep=False):
    """States of one direction: x (time, batch, 3 * HIDDEN) holds the input's
    part of update, reset and candidate."""
    h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    states, trace = np.empty((len(x), *h.shape), dtype=np.float32), []
    for t in range(len(x)):
        part = h @ u
        gates = _sigmoid(x[t, :, :2 * HIDDEN] + part[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN:] + r * part[:, 2 * HIDDEN:])
        new = n + z * (h - n)
        new = h + mask[t][:, None] * (new - h)
        if keep:
            trace.append((h, z, r, n, part[:, 2 * HIDDEN:]))
        h = states[t] = new
    return states, trace


def recurrent_back(grad, mask, u, trace):
    """Gradients of x and u from those of the states."""
    dx = np.zeros((*grad.shape[:2], 3 * HIDDEN), dtype=np.float32)
    du = np.zeros_like(u)
    ahead = np.zeros(grad.shape[1:], dtype=np.float32)
    for t in range(len(grad) - 1, -1, -1):
        h, z, r, n, inner = trace[t]
        total = grad[t] + ahead
        new = mask[t][:, None] * total
        dn = new * (1 - z) * (1 - n * n)
        dz = new * (h - n) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dx[t] = np.hstack([dz, dr, dn])
        dp = np.hstack([dz, dr, dn * r])
        du += h.T @ dp
        ahead = total - new + new * z + dp @ u.T
    return dx, du


def forward(weights, x, mask, keep=False):
    """Logit of each window from its inputs x (time, batch, dim)."""
    w, b, u1, u2, att, out, bias = weights
    part = x.reshape(-1, x.shape[2]) @ w + b
    part = part.reshape(x.shape[0], x.shape[1], -1)
    return _pooled(weights, part, mask, keep)


def _pooled(weights, part, mask, keep=False):
    _, _, u1, u2, att, out, bias = weights
    ahead, t1 = recurrent(part[:, :, :3 * HIDDEN], mask, u1, keep)
    behind, t2 = recurrent(part[::-1, :, 3 * HIDDEN:], mask[::-1], u2, keep)
    states = np.concatenate([ahead, behind[::-1]], axis=2)
    heat = states @ att
    heat = np.where(mask > 0, heat, np.float32(-1e9))
    share = np.exp(heat - heat.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", share, states)
    logit = pooled @ out + bias[0]
    return (logit, (states, share, pooled, t1, t2)) if keep else logit


def backward(weights, x, mask, kept, slope):
    """Gradients of all weights and of x from those of the logits."""
    w, b, u1, u2, att, out, bias = weights
    states, share, pooled, t1, t2 = kept
    d_pool = slope[:, None] * out
    d_share = np.einsum("bh,tbh->tb", d_pool, states)
    d_heat = share * (d_share - (share * d_share).sum(axis=0))
    d_states = share[:, :, None] * d_pool + d_heat[:, :, None] * att
    dx1, du1 = recurrent_back(d_states[:, :, :HIDDEN], mask, u1, t1)
    dx2, du2 = recurrent_back(d_states[::-1, :, HIDDEN:], mask[::-1], u2, t2)
    d_part = np.concatenate([dx1, dx2[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
    flat = x.reshape(-1, x.shape[2])
    grads = [flat.T @ d_part, d_part.sum(0), du1, du2, np.einsum("tb,tbh->h", d_heat, states), pooled.T @ slope,
             np.array([slope.sum()], dtype=np.float32)]
    return grads, (d_part @ w.T).reshape(x.shape)


class _Texts:
    """Training texts as word kinds: read in chunks, so that only word hashes
    and the n-grams of distinct words are kept."""

    def __init__(self, texts):
        off, raw = text_buffers(pa.array(texts, pa.string()))
        hashes, counts, kinds, grams, sizes = [], [], [], [], []
        for _, _, o, r in doc_chunks(off, raw):
            folded, starts, ends, word_off = folded_words(o, r)
            h = word_hashes(folded, starts, ends)
            kind, first = np.unique(h, return_index=True)
            hashes.append(h)
            counts.append(np.diff(word_off))
            kinds.append(kind)
            rows, gram_off = gram_rows(folded, starts[first], ends[first])
            grams.append(rows.astype(np.int32))
            sizes.append(np.diff(gram_off))
        self.word_off = np.append(0, np.cumsum(np.concatenate(counts)))
        self.kinds, first = np.unique(np.concatenate(kinds), return_index=True)
        sizes = np.concatenate(sizes)
        self.grams = np.concatenate(grams)[ragged_range((np.cumsum(sizes) - sizes)[first], sizes[first])]
        self.gram_off = np.append(0, np.cumsum(sizes[first]))
        self.back = np.searchsorted(self.kinds, np.concatenate(hashes)).astype(np.int32)

    def spots(self, kinds):
        """Places in ``grams`` of some word kinds, and their number for each."""
        sizes = self.gram_off[kinds + 1] - self.gram_off[kinds]
        return ragged_range(self.gram_off[kinds], sizes), sizes

    def log_odds(self, toxic, rows_of, size):
        """Smoothed log odds of toxic documents for each word or n-gram row
        (``rows_of`` gives a document's rows from its word kinds), relative to
        their share; 0 for rows whose number of toxic documents is within
        ``LEAST_Z`` standard deviations of chance."""
        seen, bad = np.zeros(size), np.zeros(size)
        for i, label in enumerate(toxic):
            rows = np.unique(rows_of(np.unique(self.back[self.word_off[i]:self.word_off[i + 1]])))
            seen[rows] += 1
            bad[rows] += label
        rate = max(float(toxic.sum()), 0.5) / len(toxic)
        odds = np.log((bad + 2 * rate) / (seen - bad + 2 * (1 - rate))) - np.log(rate / (1 - rate))
        z = (bad - rate * seen) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
        return np.where((seen > 2) & (np.abs(z) >= LEAST_Z), odds, 0.0)


def train(texts: list, toxic: np.ndarray, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    read = _Texts(texts)
    kinds, grams, back, word_off = read.kinds, read.grams, read.back, read.word_off
    odds = read.log_odds(toxic, lambda k: k, len(kinds))
    known = np.flatnonzero(odds)
    net = Network(kinds[known], rng.normal(0, 0.1, (len(known) + 1, WORD_DIM)).astype(np.float32),
                  rng.normal(0, 0.1, (GRAM_ROWS, CHAR_DIM)).astype(np.float32), None)
    net.words[:, 0] = np.append(0, odds[known] / 3)
    net.grams[:, 0] = read.log_odds(toxic, lambda k: grams[read.spots(k)[0]], GRAM_ROWS) / 3
    telling = net.grams[:, :1] != 0
    telling[0] = False
    net.grams *= telling
    dim = WORD_DIM + CHAR_DIM

    def normal(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    net.weights = [normal(dim, 6 * HIDDEN), np.zeros(6 * HIDDEN, np.float32), normal(HIDDEN, 3 * HIDDEN),
                   normal(HIDDEN, 3 * HIDDEN), normal(2 * HIDDEN), normal(2 * HIDDEN), np.zeros(1, np.float32)]
    rows = net.word_rows(kinds)
    doc, start, size = window_index(word_off)
    if not len(doc):
        return net
    # The windows a label speaks of: a toxic text's most suspect two; of clean
    # texts the most suspect two and some others.
    suspicion = (net.words[rows, 0] + np.maximum.reduceat(net.grams[grams, 0], read.gram_off[:-1]))[back]
    place = np.arange(WINDOW)
    spot = np.minimum(start[:, None] + place, len(back) - 1)
    heat = np.where(place < size[:, None], suspicion[spot], 0).max(axis=1)
    order = np.lexsort((-heat, doc))
    rank = np.empty(len(doc), dtype=np.int64)
    rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    bad = toxic[doc] > 0
    shown = (heat > 0.3) | (heat.max() <= 0.3)
    use = np.flatnonzero(np.where(bad, shown & (rank < 2), (rank < 2) | (rng.random(len(doc)) < 0.1)))
    label = bad[use].astype(np.float32)
    params = [*net.weights, net.words, net.grams]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(use)), -(-len(use) // BATCH)):
            step += 1
            w = use[part]
            mask = (place[:, None] < size[w]).astype(np.float32)
            kind, local = np.unique(back[spot[w].T], return_inverse=True)
            spots, sizes = read.spots(kind)
            g, first = grams[spots], np.cumsum(sizes) - sizes
            stack = net.grams[g]
            most = np.maximum.reduceat(stack, first)
            top = np.where(stack == np.repeat(most, sizes, axis=0), np.arange(len(g))[:, None], len(g))
            top = np.minimum.reduceat(top, first)
            x_kind = np.hstack([net.words[rows[kind]], most])
            x = x_kind[local.reshape(mask.shape)]
            logit, kept = forward(net.weights, x, mask, keep=True)
            slope = (_sigmoid(logit) - label[part]) / len(part)
            grads, dx = backward(net.weights, x, mask, kept, slope.astype(np.float32))
            dk = np.zeros_like(x_kind)
            np.add.at(dk, local.ravel(), dx.reshape(-1, dim))
            dw, dg = np.zeros_like(net.words), np.zeros_like(net.grams)
            np.add.at(dw, rows[kind], dk[:, :WORD_DIM])
            np.add.at(dg, (g[top], np.arange(CHAR_DIM)), dk[:, WORD_DIM:])
            dg *= telling
            for k, (p, grad) in enumerate(zip(params, [*grads, dw, dg])):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p -= (RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def scores(net: Network, off, raw) -> np.ndarray:
    """The worst window's probability for each document of a chunk."""
    folded, starts, ends, word_off = folded_words(off, raw)
    out = np.zeros(len(off) - 1)
    if not len(starts):
        return out
    hashes = word_hashes(folded, starts, ends)
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    x = net.inputs(net.word_rows(kinds), *gram_rows(folded, starts[first], ends[first]))
    x = x @ net.weights[0] + net.weights[1]
    doc, start, size = window_index(word_off)
    place = np.arange(WINDOW)[:, None]
    for a in range(0, len(doc), 1024):
        s, n = start[a:a + 1024], size[a:a + 1024]
        mask = (place < n).astype(np.float32)
        logit = _pooled(net.weights, x[back[np.minimum(s + place, len(back) - 1)]], mask)
        np.maximum.at(out, doc[a:a + 1024], _sigmoid(logit))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out, seed: int = 5) -> Network | None:
    known = labels.where(~held_out)
    bad = labelled_sample(docs, known, "toxic", 1, TOXIC, seed)
    good = labelled_sample(docs, known, "toxic", 0, CLEAN, seed)
    if not bad or not good:
        return None
    return train([t for _, t in bad] + [t for _, t in good], np.repeat([1.0, 0.0], [len(bad), len(good)]), seed)


def _scored(net):
    def emit(batches):
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            for a, b, o, r in doc_chunks(off, raw, 1 << 18):
                score = scores(net, o, r) if net else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score)],
                                                 names=["doc_id", "score"])
    return emit


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text",
                    net: Network | None = None) -> DataFrame:
    """(doc_id, score) for every row: the probability that its worst window
    is toxic.  Texts without a word (null and empty ones too) score 0, and so
    do all where either label is missing.  Rows with a null id, text or label
    are not learned from; only ``toxic`` is read of ``labels``."""
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        net = fit_toxicity(base.where("text is not null"), labels, F.lit(False) if held_out is None else held_out)
    return base.mapInArrow(_scored(net), "doc_id long, score double")


def op9_toxicity(spark, sf_dir):
    """Per document: hold-out fold, toxicity and the verdict at 0.3."""
    from ratestat.llm.common import documents
    from ratestat.sources.tables import read_table
    held_out = is_remainder("doc_id", 4, 2)
    found = toxicity_scores(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "toxic"),
                            held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
