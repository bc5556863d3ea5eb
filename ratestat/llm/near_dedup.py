"""Near-duplicate classes by HyperMinHash sketches and exact verification.

A document's set is its distinct ``shingle``-word shingles of lower-cased
words.  One pass over the text hashes each shingle once: the top bits choose
one of ``REGISTERS`` buckets, and each bucket keeps, of its least hash, the
leading-zero count and ``MANTISSA`` following bits (16 bits in all).  Empty
buckets copy a pseudo-randomly probed other bucket.

1. Documents with one and the same set form a class, represented by its least
   id; from here on only representatives are compared.
2. ``BANDS`` bands of ``ROWS`` compressed registers are hashed; each bucket of
   a band links its members to the least one (a hub), never to each other.
3. The sketches' Jaccard estimate, corrected for chance collisions of the
   compressed registers, drops pairs ``SLACK`` standard deviations below the
   threshold; the others are confirmed on their full shingle sets.
4. Members of buckets that still hold several components are rivals: all
   pairs of rivals from two components that can reach the threshold are found
   by an exact prefix join on their rarest shingles, and confirmed too.

A pair at a similarity of 0.8 shares no bucket with probability 3e-6; all
else is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratestat.llm.common import prepare, staged
from ratestat.llm.components import components
from ratestat.llm.textops import (LOWER, doc_chunks, mix64, rolling_hashes, signed, text_buffers, word_hashes,
                                  word_spans)

SHINGLE, PERCENT = 4, 80
REGISTERS, MANTISSA = 256, 10
BANDS, ROWS = 42, 6
SLACK = 6.0
PROBES = 256
HOT = 500  # documents of a shingle that one task of the prefix join is meant to hold
_U = np.uint64
_REST = 56  # hash bits below the bucket number
_PROBE = (mix64(np.arange(PROBES * REGISTERS, dtype=_U) + _U(0x1B873593)) % _U(REGISTERS)).astype(np.int64).reshape(
    PROBES, REGISTERS)


def shingle_sets(off: np.ndarray, raw: np.ndarray, shingle: int):
    """Sorted distinct shingle hashes of each document of a chunk.  A text
    with fewer words than a shingle has its whole sequence as the one."""
    starts, ends, word_off = word_spans(off, raw)
    words = word_hashes(LOWER[raw], starts, ends)
    grams = {k: rolling_hashes(words, k) for k in range(1, shingle + 1)}
    for a, b in zip(word_off[:-1], word_off[1:]):
        n = int(b - a)
        if n >= shingle:
            yield np.unique(grams[shingle][a:b - shingle + 1])
        elif n:
            yield mix64(grams[n][a:a + 1] ^ _U(n))
        else:
            yield words[:0]


def registers(sets: list) -> np.ndarray:
    """Compressed registers of each set, empty buckets filled; sets without an
    element get zeros."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    filled = np.zeros((len(sets), REGISTERS), dtype=bool)
    if sizes.sum():
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), sizes)
        bucket = (h >> _U(_REST)).astype(np.int64)
        first = np.ones(len(h), dtype=bool)  # hashes ascend within a set, so the first of a bucket is its least
        first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
        rest = h[first] & _U((1 << _REST) - 1)
        _, bits = np.frexp(rest.astype(np.float64))
        zeros = np.clip(_REST - bits, 0, _REST - 1)
        mantissa = (rest << (zeros + 1).astype(_U)) & _U((1 << _REST) - 1)
        value = (zeros.astype(np.int64) << MANTISSA) | (mantissa >> _U(_REST - MANTISSA)).astype(np.int64)
        out[doc[first], bucket[first]] = value
        filled[doc[first], bucket[first]] = True
    row, col = np.nonzero(~filled & (sizes > 0)[:, None])
    source = out.copy()
    for t in range(PROBES):
        if not len(row):
            return out
        probe = _PROBE[t, col]
        hit = filled[row, probe]
        out[row[hit], col[hit]] = source[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    for r in np.unique(row):  # tiny sets: the next filled bucket to the right
        have = np.flatnonzero(filled[r])
        c = col[row == r]
        out[r, c] = source[r, have[np.searchsorted(have, c) % len(have)]]
    return out




def _sketches(shingle):
    def emit(batches):
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            for a, b, o, r in doc_chunks(off, raw):
                sets = list(shingle_sets(o, r, shingle))
                sig = registers(sets)
                one = [signed(np.array([mix64(s ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)]))[0] for s in sets]
                two = [signed(np.array([mix64(s * _U(0x9E3779B97F4A7C15)).sum(dtype=_U)]))[0] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])
    return emit


def chance_match(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that the registers of two unrelated sets agree by chance."""
    i = np.arange(_REST + 1)
    below = 1.0 - 2.0 ** -i
    p = []
    for n in (n_a, n_b):
        over = below[None, :] ** np.maximum(n[:, None] / REGISTERS, 1e-9)
        p.append(np.clip(np.diff(over, axis=1), 0, 1))
    return (p[0] * p[1]).sum(axis=1) / (1 << MANTISSA)


def estimate(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of pairs of sketches."""
    same = (sig_a == sig_b).mean(axis=1)
    chance = chance_match(n_a, n_b)
    return (same - chance) / (1 - chance)


def _as_registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _plausible(percent):
    j = percent / 100
    least = j - SLACK * (j * (1 - j) / REGISTERS) ** 0.5

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            guess = estimate(_as_registers(batch.column("sig_a")), _as_registers(batch.column("sig_b")),
                             batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float))
            at = pa.array(np.flatnonzero(guess >= least))
            yield batch.select(["a", "b"]).take(at)
    return emit


def _set_bytes(shingle):
    def emit(batches):
        for batch in batches:
            off, raw = text_buffers(batch.column("text"))
            for a, b, o, r in doc_chunks(off, raw):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(a, b - a),
                     pa.array([s.tobytes() for s in shingle_sets(o, r, shingle)], pa.binary())], names=["rep", "shingles"])
    return emit


def _confirmed(percent):
    def emit(batches):
        known_id, known = None, None
        for batch in batches:
            out = []
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                if known_id != a[i]:
                    known_id, known = a[i], np.frombuffer(x.as_buffer(), dtype=_U)
                other = np.frombuffer(y.as_buffer(), dtype=_U)
                both = np.intersect1d(known, other, assume_unique=True).size
                if both and 100 * both >= percent * (len(known) + len(other) - both):
                    out.append(i)
            at = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a).take(at), pa.array(b).take(at)], names=["a", "b"])
    return emit


def _exploded(batches):
    for batch in batches:
        reps = batch.column("rep").to_numpy()
        for i, cell in enumerate(batch.column("shingles")):
            s = np.frombuffer(cell.as_buffer(), dtype=np.int64)
            for k in range(0, len(s), 100_000):
                part = s[k:k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), reps[i]))],
                                                 names=["shingle", "rep"])


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that the estimate lets pass and the full sets confirm."""
    one = sketches.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    two = sketches.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    plausible = staged(pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
                       .mapInArrow(_plausible(percent), "a long, b long"), "plausible")
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return staged(plausible.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
                  .mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")


def _cross_pairs(rivals: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rivals(rep, n, component) from two components that can
    reach the threshold: an exact prefix join.

    Each set is ordered rarest shingle first.  Two sets that reach the
    threshold share a shingle among the first n - ceil(percent/100 * n) + 1 of
    both, and from the places of their first common one it follows how many
    they can share at most.  Shingles that one document alone holds take up
    places but never meet.  A shingle's largest component is not compared with
    itself, and one that many documents hold is dealt over several tasks.
    """
    held = staged(sets.join(rivals.select("rep"), "rep").mapInArrow(_exploded, "shingle long, rep long"), "rival-shingles")
    common = staged(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common-shingles")
    ranked = held.join(common, "shingle", "left").select("rep", "shingle", F.coalesce("df", F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    prefix = staged(ranked.withColumn("place", place).where("df > 1").join(rivals, "rep")
                    .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
                    .select("shingle", "rep", "n", "component", "place"), "prefixes")
    kinds = staged(prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")), "prefix-kinds")
    shared = staged(kinds.groupBy("shingle").agg(
        F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"),
        F.ceil(F.sum("k") / HOT).alias("parts")).where("kinds > 1")
        .select("shingle", F.col("top.component").alias("largest"), "parts"), "shared-shingles")
    # A shingle of many documents is dealt over several tasks: each of its
    # documents lies in one part, the rarer side visits them all.
    known = staged(prefix.join(shared, "shingle").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))), "dealt-prefixes")
    rare = known.where("component <> largest").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    x, y = rare.alias("x"), known.alias("y")
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return (x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part"))
                   & (F.col("x.component") != F.col("y.component"))
                   & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Two documents are linked if 100 * intersection >= percent * union of
    their shingle sets.  ``component_id`` is the least id reachable over
    links, ``kept`` marks it.  Null, empty and wordless texts have an empty
    set and no link; so have rows with a null id, whose component is null and
    which stay.  Rows that repeat an id are judged by their own text each.
    Other columns of ``docs`` are not read.
    """
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = staged(base.mapInArrow(
        _sketches(shingle), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"), "sketches")
    linkable = sketches.where("doc_id is not null and n_shingles > 0")
    classes = staged(linkable.groupBy("set_a", "set_b", F.col("n_shingles").alias("n"))
                     .agg(F.min("doc_id").alias("rep")), "classes")

    own = ["set_a", "set_b"]
    reps = (linkable.select("doc_id", *own, "sig").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *own])
            .groupBy(F.col("doc_id").alias("rep"), *own, "n").agg(F.min("sig").alias("sig")).select("rep", "n", "sig"))
    # A set of size n only links with sets of at least percent/100 * n: below
    # percent / (100 - percent) elements the sets would be equal.
    reps = reps.where(F.col("n") * 100 >= percent * (F.col("n") + 1))
    step = 2 * ROWS
    banded = reps.select("rep", "n", F.explode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), j -> xxhash64(j, substring(sig, j * {step} + 1, {step})))")).alias("band"))
    banded = staged(banded, "bands")
    hubs = staged(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
                  .where("hub < last").select("band", "hub"), "hubs")
    members = staged(banded.join(hubs, "band"), "members")
    ids = members.select("rep").distinct()
    texts = base.where("doc_id is not null").join(ids.withColumnRenamed("rep", "doc_id"), "doc_id")
    mine = staged(texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(
        _set_bytes(shingle), "rep long, shingles binary"), "member-sets")
    sigs = staged(reps.join(ids, "rep"), "member-sketches")

    size = {r: F.col(r) for r in ("n", "n_hub")}
    size_fits = (100 * F.least(size["n"], size["n_hub"]) >= percent * F.greatest(size["n"], size["n_hub"]))
    stars = members.where("rep <> hub").select("hub", "rep", "n").distinct()
    stars = stars.join(sigs.select(F.col("rep").alias("hub"), F.col("n").alias("n_hub")), "hub").where(size_fits)
    first = _links(stars.select(F.col("hub").alias("a"), F.col("rep").alias("b")), sigs, mine, percent)

    placed = members.join(components(first), F.col("rep") == F.col("node"), "left").select(
        "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = staged(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                   .where("lo < hi").select("band"), "mixed-bands")
    rivals = staged(placed.join(mixed, "band").select("rep", "n", "component").distinct(), "rivals")
    pairs = _cross_pairs(rivals, mine, percent).join(
        stars.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")), ["a", "b"], "left_anti")
    second = _links(pairs, sigs, mine, percent)
    joined = components(first.unionByName(second))
    named = staged(classes.join(joined, F.col("rep") == F.col("node"), "left")
                   .select("set_a", "set_b", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")),
                   "class-components")
    known = (sketches.select("doc_id", "n_shingles", "set_a", "set_b")
             .join(named, ["set_a", "set_b", "n_shingles"], "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return known.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dedup(spark, sf_dir):
    """Per document: its set's size, its component and whether it stays."""
    from ratestat.llm.common import documents
    return near_dedup(documents(spark, sf_dir, "doc_id", "text"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (
  SELECT x.doc_id, md5(string_agg(x.g, chr(10) ORDER BY x.g)) AS k FROM s x GROUP BY x.doc_id
), c AS (SELECT k, min(doc_id) AS rep FROM k GROUP BY k),
t AS (SELECT s.doc_id, s.g, n.n FROM s JOIN c ON s.doc_id = c.rep JOIN n ON s.doc_id = n.doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT rep AS node, rep AS c FROM c
  UNION
  SELECT e.b AS node, r.c FROM r JOIN e ON r.node = e.a
), m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id,
       coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
LEFT JOIN c ON k.k = c.k LEFT JOIN m ON c.rep = m.node
"""
