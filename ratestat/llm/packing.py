"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the largest length is cut into pieces of it.  Pieces
are packed longest first: each goes where the least room stays (best fit); if
it fits nowhere a new bin is opened, of the permitted length that promises
the least cost per token once the pieces still to come that fit beside it are
counted in.  In the end every bin is downsized to the least permitted length
that holds its contents.  The cost of a sequence is ``fixed + length +
length ** 2 / quadratic``.

Spark deals the pieces out to shards of about ``SHARD`` rows by a hash of the
id and packs every shard by itself, so that no task sees more than a shard;
the price is at most a few half-empty bins a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import prepare, staged

LENGTHS = (512, 1024, 2048, 4096, 8192)
FIXED, QUADRATIC = 32.0, 16384.0
SHARD = 2000


def cost(length):
    return FIXED + length + length * length / QUADRATIC


def pack(sizes: np.ndarray, lengths=LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each piece and the length of each bin.
    ``sizes`` are positive and no larger than the largest length."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    room_bins: dict[int, list] = {}
    rooms = 0  # bit r is set if some bin has room r
    room, bin_of, offset = [], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = []
    still = np.bincount(sizes, minlength=lengths[-1] + 1).astype(np.int64)
    tokens = np.cumsum(still * np.arange(len(still)))  # of pieces up to a size
    for i in order:
        size = int(sizes[i])
        tokens[size:] -= size
        fits = rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room_bins[r].pop()
            if not room_bins[r]:
                rooms &= ~(1 << r)
        else:
            def price(c):
                beside = min(c - size, int(tokens[c - size]))
                return cost(c) / (size + beside), c
            r = min((c for c in lengths if c >= size), key=price)
            b = len(full)
            full.append(r)
            room.append(r)
        bin_of[i], offset[i] = b, full[b] - r
        left = r - size
        room[b] = left
        if left:
            room_bins.setdefault(left, []).append(b)
            rooms |= 1 << left
    used = np.array(full, dtype=np.int64) - np.array(room, dtype=np.int64)
    final = np.array(lengths)[np.searchsorted(lengths, used)] if len(used) else used
    return bin_of, offset, final


def _packed(lengths):
    longest = max(lengths)

    def run(table: pa.Table) -> pa.Table:
        # ids stay in Arrow: through pandas a null would turn them into doubles
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("piece", "ascending")]))
        piece, tokens = table.column("piece").to_numpy(), table.column("n_tokens").to_numpy()
        whole, offset, size = pack(tokens, lengths)
        bin_id = table.column("shard").to_numpy() * (1 << 24) + whole
        return pa.table({"doc_id": table.column("doc_id"), "piece": piece, "start": piece * longest, "n_tokens": tokens,
                         "bin_id": bin_id, "bin_offset": offset, "bin_length": size[whole]})
    return run


def best_fit_packing(docs: DataFrame, size_col: str, lengths=LENGTHS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length), one
    row per piece.

    ``size_col`` holds each row's tokens; null, zero or negative ones take
    part in no bin and give no row.  Rows with a null id are packed too,
    dealt out by their place; rows that repeat an id are packed each.  Other
    columns of ``docs`` are not read.
    """
    prepare(docs)
    longest = max(lengths)
    sized = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(size_col).cast("long").alias("size"))
                   .where("size > 0"), "sizes")
    pieces = sized.agg(F.coalesce(F.sum(F.ceil(F.col("size") / longest)), F.lit(0))).collect()[0][0]
    shards = max(1, -(-int(pieces) // SHARD))
    spread = F.xxhash64(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()), F.col("piece"))
    cut = (sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / longest))).alias("piece"))
           .select("doc_id", "piece", F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("n_tokens")))
    return cut.withColumn("shard", F.pmod(spread, F.lit(shards))).groupBy("shard").applyInArrow(
        _packed(tuple(lengths)),
        "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long")


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and the text's words plus one for its end."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", (words + 1).alias("size"))


def op2_packing(spark, sf_dir):
    """All documents packed, a token being a word or the end of a text."""
    from ratestat.llm.common import documents
    return best_fit_packing(with_sizes(documents(spark, sf_dir, "doc_id", "text")), "size")
