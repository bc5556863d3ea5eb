"""Token counts of a byte-level BPE without tokenising every word.

Offline, every vocabulary string is encoded alone; those that are one
pre-token and one token by themselves form a table sent to the tasks (at most
the vocabulary's size).  A text is cut at the special strings (one token each,
the library's default), then into pre-tokens; a pre-token in the table counts
one, the others are merged by the library, each distinct one once per cache.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import prepare
from ratestat.llm.textops import doc_chunks, text_buffers

LIMIT = 1024
CACHE = 600_000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Bpe:
    """The tokenizer file, its pre-token pattern and special strings."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split = regex.compile(pattern).findall
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def sizes(self, pieces: list) -> list:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def whole_tokens(path: str, pattern: str) -> list:
    """The vocabulary strings that are one pre-token and encode alone as one
    token."""
    bpe = _Bpe(path, pattern)
    vocabulary = bpe.tokenizer.get_vocab(with_added_tokens=False)
    strings = [s for s in bpe.tokenizer.decode_batch([[i] for i in sorted(vocabulary.values())], skip_special_tokens=False)
               if s and "�" not in s and bpe.split(s) == [s]]
    strings = sorted(set(strings))
    return [s for s, n in zip(strings, bpe.sizes(strings)) if n == 1]


_STATE: dict = {}


def _worker(path, pattern, singles):
    """Tokenizer and cache of this Python worker, kept from task to task."""
    key = (path, pattern)
    if key not in _STATE:
        _STATE[key] = (_Bpe(path, pattern), dict.fromkeys(singles, 1))
    return _STATE[key]


def _counted(path, pattern, singles):
    def emit(batches):
        bpe, cache = _worker(path, pattern, singles)
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            for a, b, o, r in doc_chunks(off, raw):
                data = r.tobytes()
                extra, parts = [], []
                for i in range(b - a):
                    text = data[o[i]:o[i + 1]].decode("utf-8", "replace")
                    if bpe.special is None:
                        extra.append(0)
                        parts.append(bpe.split(text))
                    else:
                        cut = bpe.special.split(text)
                        extra.append(len(cut) - 1)
                        parts.append(bpe.split(cut[0]) if len(cut) == 1 else [p for c in cut for p in bpe.split(c)])
                new = list(set().union(*parts).difference(cache))
                if len(cache) + len(new) > CACHE + len(singles):
                    cache.clear()
                    cache.update(dict.fromkeys(singles, 1))
                    new = list(set().union(*parts).difference(cache))
                cache.update(zip(new, bpe.sizes(new)))
                n = [e + sum(map(cache.__getitem__, p)) for e, p in zip(extra, parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(o)), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return emit


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row; a null text is an empty one.
    ``path`` is a tokenizer file found at the same place on every machine;
    other columns of ``docs`` are not read."""
    prepare(docs)
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    path = path or default_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_counted(path, pattern, whole_tokens(path, pattern)), "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark, sf_dir):
    """Per document: bytes, tokens, and whether it exceeds the limit."""
    from ratestat.llm.common import documents
    counts = token_counts(documents(spark, sf_dir, "doc_id", "text"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
