"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is a plain
sample of documents.  Labels of bad documents are never read.

* Features are shapes of the text (shares of character classes, repetition of
  words, word and line lengths), not its words.
* The class prior is estimated from scores of a positive-against-unlabelled
  classifier on a held part: the least ratio of unlabelled to positive mass
  above a threshold.
* A one-layer network minimises the non-negative unbiased risk
  ``prior * E+[l(+)] + max(0, Eu[l(-)] - prior * E+[l(-)])`` with logistic
  loss, so its sigmoid estimates the probability of the positive class.

Both samples are bounded (``POSITIVES``, ``UNLABELLED``); scoring covers all
documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import is_remainder, labelled_sample, plain_sample, prepare
from ratestat.llm.textops import code_points_before, doc_chunks, text_buffers, word_hashes, word_spans

POSITIVES, UNLABELLED = 4000, 6000
HIDDEN, STEPS, RATE, DECAY = 16, 500, 0.03, 1e-4
ACCEPT = 0.7

_CLASSES = 12
_CLASS = np.full(256, 8, dtype=np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "|<>"]] = 11
_CLASS[0xC0:] = 9
_CLASS[0x80:0xC0] = 10


def features(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """One row of shape features for each document of a chunk."""
    starts, ends, word_off = word_spans(off, raw)
    words = word_hashes(raw, starts, ends)
    points = code_points_before(raw)
    n = len(off) - 1
    x = np.zeros((n, _CLASSES + 12))
    kind = _CLASS[raw]
    for i in range(n):
        a, b = off[i], off[i + 1]
        if b <= a:
            continue
        counts = np.bincount(kind[a:b], minlength=_CLASSES).astype(float)
        letters = counts[0] + counts[1] + counts[9]
        x[i, :_CLASSES] = counts / (b - a)
        p, q = word_off[i], word_off[i + 1]
        m = q - p
        row = x[i, _CLASSES:]
        row[0] = np.log1p(m)
        row[1] = counts[1] / max(letters, 1)
        row[2] = letters / max(b - a, 1)
        if m:
            w = words[p:q]
            size = points[ends[p:q]] - points[starts[p:q]]
            row[3] = size.mean()
            row[4] = size.std()
            row[5] = np.log1p(len(np.unique(w))) - np.log1p(m)
            row[6] = (w[1:] == w[:-1]).mean() if m > 1 else 0
            first, last = kind[starts[p:q]], kind[ends[p:q] - 1]
            row[7] = ((first == 1) | (first == 9)).mean()
            row[8] = ((last == 6) | (last == 7)).mean()
            row[9] = (size == 1).mean()
            row[10] = np.log1p(m / (counts[4] + 1))
            row[11] = ((last == 5) & (size > 1)).mean()
    return x


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class Network:
    """Standardised features, one tanh layer, one output."""

    def __init__(self, mean, scale, seed):
        rng = np.random.default_rng(seed)
        f = len(mean)
        self.mean, self.scale = mean, scale
        self.w = [rng.normal(0, f ** -0.5, (f, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]

    def hidden(self, x):
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z, np.tanh(z @ self.w[0] + self.w[1])

    def logit(self, x):
        return self.hidden(x)[1] @ self.w[2] + self.w[3][0]

    def score(self, x):
        return _sigmoid(self.logit(x))

    def fit(self, groups, slopes):
        """Adam; ``slopes`` maps the logits of each group to the gradient of
        the risk with respect to them."""
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, STEPS + 1):
            kept = [self.hidden(x) for x in groups]
            grads = [DECAY * w for w in self.w]
            for (z, h), g in zip(kept, slopes([h @ self.w[2] + self.w[3][0] for _, h in kept])):
                back = (g[:, None] * self.w[2]) * (1 - h * h)
                for k, d in enumerate((z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]))):
                    grads[k] = grads[k] + d
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        return self


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the unlabelled to the positive share above a threshold,
    over thresholds that keep a fifth of the positives or more, with a margin
    for sampling error."""
    cuts = np.quantile(positive, np.linspace(0, 0.8, 81))
    p = (positive[None, :] >= cuts[:, None]).mean(1)
    u = (unlabelled[None, :] >= cuts[:, None]).mean(1)
    margin = np.sqrt(0.5 / len(positive)) + np.sqrt(0.5 / len(unlabelled))
    best = np.argmin((u + margin * 0.5) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> tuple[Network, float]:
    """The network and the class prior it used, from two feature tables."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3

    def split(x):
        part = np.arange(len(x)) % 3 == 0
        return (x[~part], x[part]) if len(x) >= 30 else (x, x)

    (p, p_held), (u, u_held) = split(positive), split(unlabelled)
    against = Network(mean, scale, seed).fit(
        [p, u], lambda z: [-(1 - _sigmoid(z[0])) / len(z[0]), _sigmoid(z[1]) / len(z[1])])
    prior = class_prior(against.logit(p_held), against.logit(u_held))

    def slopes(z):
        zp, zu = z
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = -prior * (1 - _sigmoid(zp)) / len(zp)
        down_p, down_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative >= 0:
            return up + down_p, down_u
        return -down_p, -down_u  # the part that went below zero is pushed back

    return Network(mean, scale, seed).fit([positive, unlabelled], slopes), prior


def text_features(texts) -> np.ndarray:
    off, raw = text_buffers(pa.array(list(texts), pa.string()))
    parts = [features(o, r) for _, _, o, r in doc_chunks(off, raw)]
    return np.vstack(parts) if parts else np.zeros((0, _CLASSES + 12))


def fit_quality(docs: DataFrame, labels: DataFrame, held_out, seed: int = 7):
    """The trained network, or None where there are no trusted positives.
    ``held_out``: a column that is true for documents not to learn from."""
    good = labels.where(~held_out)
    positive = labelled_sample(docs, good, "quality", 1, POSITIVES, seed)
    unlabelled = plain_sample(docs, ~held_out, UNLABELLED, seed + 1)
    if not positive or not unlabelled:
        return None
    return train(text_features(t for _, t in positive), text_features(t for _, t in unlabelled), seed)[0]


def _scored(network):
    def emit(batches):
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            for a, b, o, r in doc_chunks(off, raw):
                score = network.score(features(o, r)) if network else np.full(b - a, 0.5)
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*batch.schema.names[:-1], "score"])
    return emit


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   held_out=None, network=None) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the probability of good
    quality.  Null and empty texts get the score of an empty text; without
    any trusted positive all scores are 0.5.  A document labelled twice
    counts once; rows with a null id or text are never learned from; only
    ``quality`` is read of ``labels``, only id and text of ``docs``."""
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if network is None:
        fold = F.lit(False) if held_out is None else held_out
        network = fit_quality(base.where("text is not null"), labels, fold)
    return base.mapInArrow(_scored(network), "doc_id long, score double")


def op1_quality(spark, sf_dir):
    """Per document: hold-out fold, quality score and the verdict at 0.7."""
    from ratestat.llm.common import documents
    from ratestat.sources.tables import read_table
    held_out = is_remainder("doc_id", 4, 2)
    scores = quality_scores(documents(spark, sf_dir, "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"),
                            held_out=held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
