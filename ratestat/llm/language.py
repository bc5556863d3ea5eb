"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1 in ``DIMENSIONS`` dimensions.
A trigram is bound by multiplying its letters' vectors, the first rotated
twice and the second once; a text is the sum of its trigrams' vectors, and a
language's prototype the sum of its training texts' unit vectors.  The
language predicted is the one whose prototype has the largest cosine with the
text.

Letters are lower-cased code points; everything else is one boundary symbol.
a-z and the Latin-1 letters have a vector each, all other letters share
``OTHERS`` vectors by a fixed hash of the code point.  Training reads a
bounded sample of at most ``PER_LANGUAGE`` documents a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import hash_order, is_remainder, prepare
from ratestat.llm.textops import doc_chunks, mix64, text_buffers

DIMENSIONS, OTHERS, PER_LANGUAGE = 512, 67, 1000
_BASE = 128  # symbols: 0 boundary, 1..26 a-z, 27..60 Latin-1, then the others
_BLOCK = 4096

_SYMBOL = np.zeros(0x250, dtype=np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0xDF:0x100] = np.arange(27, 60)
_SYMBOL[0xF7] = 0


def letter_vectors(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_BASE, DIMENSIONS))


_ALPHA: dict[int, bool] = {}


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of a lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    low = points < len(_SYMBOL)
    out = np.where(low, _SYMBOL[np.where(low, points, 0)], 0)
    rest = np.flatnonzero((out == 0) & (points > 0x7F))
    if len(rest):
        kinds, back = np.unique(points[rest], return_inverse=True)
        hashed = 60 + (mix64(kinds.astype(np.uint64)) % np.uint64(OTHERS)).astype(np.int64)
        is_letter = np.array([chr(k).isalpha() for k in kinds])
        out[rest] = np.where(is_letter, hashed, 0)[back]
    return out


def bundles(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text vectors, whether each text has a letter) of a small batch."""
    codes, docs, has = [], [], np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        s = symbols(f" {text} ") if text else np.zeros(0, np.int64)
        has[i] = bool(s.any())
        if has[i]:
            t = (s[:-2] * _BASE + s[1:-1]) * _BASE + s[2:]
            t = t[s[1:-1] > 0]
            codes.append(t)
            docs.append(np.full(len(t), i))
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if not codes:
        return out, has
    codes, docs = np.concatenate(codes), np.concatenate(docs)
    present = np.flatnonzero(np.bincount(codes, minlength=_BASE ** 3))
    column = np.zeros(_BASE ** 3, dtype=np.int32)
    column[present] = np.arange(len(present))
    column = column[codes]
    twice, once = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    for a in range(0, len(present), _BLOCK):
        grams = present[a:a + _BLOCK]
        bound = (twice[grams // _BASE ** 2] * once[grams // _BASE % _BASE] * letters[grams % _BASE]).astype(np.float32)
        part = slice(None) if len(present) <= _BLOCK else (column >= a) & (column < a + _BLOCK)
        counts = np.bincount(docs[part] * len(grams) + column[part] - a, minlength=len(texts) * len(grams))
        out += counts.reshape(len(texts), len(grams)).astype(np.float32) @ bound
    return out, has


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _text_batches(column):
    off, raw = text_buffers(column)
    for a, b, o, r in doc_chunks(off, raw, 1 << 19):
        data = r.tobytes()
        yield a, b, [data[o[i]:o[i + 1]].decode("utf-8", "replace") for i in range(b - a)]


def _profiles(letters):
    def emit(batches):
        total: dict = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, texts in _text_batches(batch.column("text")):
                vectors = unit(bundles(texts, letters)[0]).astype(np.float64)
                for lang in set(langs[a:b]):
                    rows = [i for i in range(b - a) if langs[a + i] == lang]
                    total[lang] = total.get(lang, 0) + vectors[rows].sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS)), pa.array(v)],
                names=["lang", "d", "v"])
    return emit


def fit_languages(docs: DataFrame, held_out, seed: int = 11) -> tuple[list, np.ndarray]:
    """(languages, unit prototypes): the prototype of a language sums at most
    about ``PER_LANGUAGE`` documents, chosen by a hash of their id at the
    share that the language's size allows."""
    letters = letter_vectors(seed)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, DIMENSIONS))
    share = F.pmod(hash_order("doc_id", seed), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (share < int(min(1.0, PER_LANGUAGE / n) * (1 << 20)) + 1))
    rows = (known.where(chosen).select("text", "lang").mapInArrow(_profiles(letters), "lang string, d long, v double")
            .groupBy("lang", "d").agg(F.sum("v").alias("v")).collect())
    langs = sorted({r["lang"] for r in rows})
    sums = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        sums[langs.index(r["lang"]), r["d"]] = r["v"]
    return langs, unit(sums)


def _predicted(langs, prototypes, seed):
    letters = letter_vectors(seed)
    names = np.array([*langs, "und"], dtype=object)

    def emit(batches):
        for batch in batches:
            for a, b, texts in _text_batches(batch.column("text")):
                vectors, has = bundles(texts, letters)
                if langs:
                    cosine = unit(vectors) @ prototypes.T.astype(np.float32)
                    best = np.where(has, cosine.argmax(axis=1), len(langs))
                    score = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                else:
                    best, score = np.zeros(b - a, dtype=int), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(names[best], pa.string()),
                     pa.array(score.astype(float))], names=["doc_id", "lang_pred", "score"])
    return emit


def identify_language(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", seed: int = 11) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the nearest prototype and
    its cosine (0 if negative).  Texts that are null or without a letter get
    ``und`` and 0; so do all where no language could be learned."""
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    langs, prototypes = fit_languages(base, F.lit(False) if held_out is None else held_out, seed)
    return base.select("doc_id", "text").mapInArrow(_predicted(langs, prototypes, seed),
                                                    "doc_id long, lang_pred string, score double")


def op4_language(spark, sf_dir):
    """Per document: hold-out fold, predicted language and its cosine."""
    from ratestat.llm.common import documents
    held_out = is_remainder("doc_id", 5, 0)
    found = identify_language(documents(spark, sf_dir, "doc_id", "text", "lang"), held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
