"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` reads the texts once.  Documents of like numbers of terms form
blocks; a block is a bit matrix of one row of bits (a slice) per signature
position and one column per document.  A term that occurs at least 1, 2, 3, 5
or 9 times sets the positions of that tier's hashes, so the conjunction of a
tier's slices marks every document where it does, and by chance some others.

``search`` weighs the slices of an item's terms by what a tier can add to the
score and sums them: an upper bound for every document.  The documents with
the highest bounds are scored exactly, from their whole texts; the tenth best
exact score of an item is its threshold.  Every document whose bound reaches
the threshold is then scored exactly, so what is not scored is provably not
among the ten.  Terms are told apart by 64 bits.

Items are searched in groups of about ``ITEM_TERMS`` terms and at most some
``ITEMS`` items, each against all blocks; only an item group's own terms and thresholds are held by driver and
tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratestat.llm.common import prepare, staged
from ratestat.llm.textops import LOWER, doc_chunks, mix64, ragged_range, signed, text_buffers, word_hashes, word_spans

TOP = 10
TIERS = (1, 2, 3, 5, 9)
MOST = (1, 2, 4, 8)  # the most occurrences of a term that reaches a tier and not the next
BITS, HASHES = 16, 4
BLOCK_BITS, BLOCK_ROWS, LEAST_WIDTH = 1 << 22, 1024, 256
ITEM_TERMS, ITEMS = 1 << 17, 1 << 12
GROUP_TERMS = 4096
PENDING = 1 << 19
FULL = 10 ** 9
_U = np.uint64
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x41:0x5B] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False
_TIER_KEYS = mix64(np.arange(1, len(TIERS) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def term_counts(off: np.ndarray, raw: np.ndarray):
    """(terms of each document, document, term hash, occurrences) of a chunk,
    the last three sorted by document and hash."""
    starts, ends, word_off = word_spans(off, raw, BETWEEN)
    hashes = word_hashes(LOWER[raw], starts, ends)
    n = np.diff(word_off)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return n, doc[at], hashes[at], np.diff(np.append(at, len(hashes)))


def positions(elements: np.ndarray, width: int) -> np.ndarray:
    """The ``HASHES`` signature positions of each element, one row each."""
    step = (elements >> _U(32)) | _U(1)
    return ((elements[None, :] + np.arange(HASHES, dtype=_U)[:, None] * step) & _U(width - 1)).astype(np.int64)


def tier_elements(hashes: np.ndarray, tier: int) -> np.ndarray:
    return mix64(hashes ^ _TIER_KEYS[tier])


def signature_width(elements: int) -> int:
    """Bits of a signature: a power of two of at least ``BITS`` an element."""
    return max(LEAST_WIDTH, 1 << (BITS * elements - 1).bit_length())


def sliced(rows: list, width: int) -> np.ndarray:
    """The bit matrix of rows' positions: width slices of packed columns."""
    out = np.zeros((width, -(-len(rows) // 8)), dtype=np.uint8)
    for i, at in enumerate(rows):
        out[at, i >> 3] |= np.uint8(1 << (i & 7))
    return out


_INDEX = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
                    ("width", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("slices", pa.binary())])
_INDEX_SQL = "term long, df long, n_docs long, n_terms long, width long, ids binary, lengths binary, slices binary"


def _index_rows(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                                       for f in _INDEX], schema=_INDEX)


def _block(width: int, rows: list) -> pa.RecordBatch:
    ids, lengths, at = zip(*rows)
    return _index_rows({"width": [width], "ids": [np.array(ids, np.int64).tobytes()],
                        "lengths": [np.array(lengths, np.int64).tobytes()], "slices": [sliced(at, width).tobytes()]}, 1)


def _indexed(batches):
    """Texts to signature blocks, document frequencies and totals."""
    waiting: dict = {}
    frequency, pending = [], 0
    n_docs = n_terms = 0

    def frequencies():
        terms = np.concatenate([t for t, _ in frequency])
        known, where = np.unique(terms, return_inverse=True)
        return known, np.bincount(where, np.concatenate([c for _, c in frequency]), len(known)).astype(np.int64)

    for batch in batches:
        ids = batch.column("doc_id")
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        off, raw = text_buffers(batch.column("text"))
        for a, b, o, r in doc_chunks(off, raw):
            n, doc, hashes, tf = term_counts(o, r)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            known, count = np.unique(hashes, return_counts=True)
            frequency.append((known, count))
            pending += len(known)
            if pending > PENDING:
                known, count = frequencies()
                frequency, pending = [(known, count)], len(known)
                if pending > PENDING // 2:
                    yield _index_rows({"term": signed(known), "df": count}, len(known))
                    frequency, pending = [], 0
            reached = [tf >= least for least in TIERS]
            elements = np.concatenate([tier_elements(hashes[m], j) for j, m in enumerate(reached)])
            owner = np.concatenate([doc[m] for m in reached])
            order = np.argsort(owner, kind="stable")
            elements, edges = elements[order], np.searchsorted(owner[order], np.arange(b - a + 1))
            for i in np.flatnonzero((n > 0) & named[a:b]):
                mine = elements[edges[i]:edges[i + 1]]
                width = signature_width(len(mine))
                rows = waiting.setdefault(width, [])
                rows.append((ids[a + i], n[i], positions(mine, width).ravel().astype(np.uint32)))
                if len(rows) >= min(BLOCK_ROWS, max(8, BLOCK_BITS // width)):
                    yield _block(width, waiting.pop(width))
    for width, rows in sorted(waiting.items()):
        yield _block(width, rows)
    if frequency:
        known, count = frequencies()
        yield _index_rows({"term": signed(known), "df": count}, len(known))
    yield _index_rows({"n_docs": [n_docs], "n_terms": [n_terms]}, 1)


@dataclass
class Index:
    """Signature blocks, document frequencies and totals of a corpus."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of ``docs``.

    A null text has no term.  A row with a null id counts in all statistics
    but cannot be found; rows that repeat an id are documents of their own.
    Other columns are not read."""
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = staged(base.mapInArrow(_indexed, _INDEX_SQL), "signatures")
    total = parts.where("n_docs is not null").agg(F.sum("n_docs"), F.sum("n_terms")).collect()[0]
    terms = staged(parts.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
    blocks = parts.where("width is not null").select("width", "ids", "lengths", "slices")
    return Index(blocks, terms, int(total[0] or 0), int(total[1] or 0))


def length_factor(n, n_docs: int, n_terms: int):
    """A document's m: 25 hundredths and 75 more by its relative length."""
    return 25 + (75 * n * n_docs) // max(n_terms, 1)


def term_share(tf, m):
    return (FULL * tf) // (1000 * tf + 8 * m)


class ItemGroup:
    """The weighted terms of some items: entry j of item i says which term
    weighs how much.  ``terms`` are sorted hashes."""

    def __init__(self, items, hashes, weights):
        order = np.lexsort((hashes, items))
        self.items, first = np.unique(items[order], return_index=True)
        self.edges = np.append(first, len(order))
        self.terms, self.entry = np.unique(hashes[order], return_inverse=True)
        self.weights = weights[order]

    def parts(self):
        """Ranges of items of at most ``GROUP_TERMS`` entries, or one item."""
        i = 0
        while i < len(self.items):
            j = max(i + 1, int(np.searchsorted(self.edges, self.edges[i] + GROUP_TERMS, side="right")) - 1)
            yield i, j
            i = j

    def bounds(self, width, lengths, slices, n_docs, n_terms) -> np.ndarray:
        """An upper bound of each item's score in each document of a block."""
        r = len(lengths)
        matrix = np.frombuffer(slices, dtype=np.uint8).reshape(width, -1)
        m = length_factor(lengths, n_docs, n_terms)
        most = [term_share(np.int64(k), m) for k in MOST] + [term_share(np.maximum(lengths, MOST[-1]), m)]
        adds = [most[0]] + [b - a for a, b in zip(most, most[1:])]
        out = np.zeros((len(self.items), r))
        for i, j in self.parts():
            lo, hi = self.edges[i], self.edges[j]
            used, entry = np.unique(self.entry[lo:hi], return_inverse=True)
            total = np.add.reduceat(self.weights[lo:hi], self.edges[i:j] - lo)
            kind = np.float32 if total.max() < 1 << 24 else np.float64  # whole numbers stay exact
            weights = self.weights[lo:hi].astype(kind)
            for tier, add in enumerate(adds):
                at = positions(tier_elements(self.terms[used], tier), width)
                bits = matrix[at[0]]
                for more in at[1:]:
                    bits = bits & matrix[more]
                live = bits.any(axis=1)
                if not live.any():
                    continue
                marks = np.zeros((len(used), r), dtype=kind)
                marks[live] = np.unpackbits(bits[live], axis=1, count=r, bitorder="little")
                for k in range(i, j):
                    a, b = self.edges[k] - lo, self.edges[k + 1] - lo
                    out[k] += (weights[a:b] @ marks[entry[a:b]]).astype(np.float64) * add
        return out

    def scores(self, wanted, hashes, tf, n, n_docs, n_terms) -> np.ndarray:
        """Exact scores of the items ``wanted`` (positions) in one document."""
        m = length_factor(np.int64(n), n_docs, n_terms)
        first, counts = self.edges[wanted], self.edges[wanted + 1] - self.edges[wanted]
        entries = ragged_range(first, counts)
        terms = self.terms[self.entry[entries]]
        at = np.minimum(np.searchsorted(hashes, terms), len(hashes) - 1)
        found = np.where(hashes[at] == terms, tf[at], 0)
        return np.add.reduceat(self.weights[entries] * term_share(found, m), np.cumsum(counts) - counts)


def _item_terms(batches):
    for batch in batches:
        items = batch.column("item").to_numpy()
        off, raw = text_buffers(batch.column("text"))
        for a, b, o, r in doc_chunks(off, raw):
            _, doc, hashes, tf = term_counts(o, r)
            yield pa.RecordBatch.from_arrays([pa.array(items[a + doc]), pa.array(signed(hashes)), pa.array(tf.astype(np.int64))],
                                             names=["item", "term", "times"])


def _pairs(items, ids, values, names):
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.int64()),
                                       pa.array(values.astype(np.int64), pa.int64())], names=names)


def _best(items, ids, values, top):
    """Positions of each item's ``top`` highest values, least ids on ties."""
    order = np.lexsort((ids, -values, items))
    rank = np.arange(len(order)) - np.searchsorted(items[order], items[order])
    return order[rank < top]


def _highest_bounds(group, n_docs, n_terms, top):
    """Each task's ``top`` documents of every item by their bounds."""
    def emit(batches):
        best = np.zeros((len(group.items), 0))
        ids = np.zeros((len(group.items), 0), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], dtype=np.int64)
                more = group.bounds(row["width"], lengths, row["slices"], n_docs, n_terms)
                best = np.concatenate([best, more], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(np.frombuffer(row["ids"], np.int64), more.shape)], axis=1)
                if best.shape[1] > top:
                    at = np.argpartition(-best, top - 1, axis=1)[:, :top]
                    best, ids = np.take_along_axis(best, at, 1), np.take_along_axis(ids, at, 1)
        i, j = np.nonzero(best)
        yield _pairs(group.items[i], ids[i, j], best[i, j], ["item", "doc_id", "bound"])
    return emit


def _not_excluded(group, thresholds, n_docs, n_terms):
    """All (item, document) whose bound reaches the item's threshold."""
    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["ids"], np.int64)
                bound = group.bounds(row["width"], lengths, row["slices"], n_docs, n_terms)
                i, j = np.nonzero(bound >= thresholds[:, None])
                yield _pairs(group.items[i], ids[j], bound[i, j], ["item", "doc_id", "bound"])
    return emit


def _rescored(group, n_docs, n_terms, top):
    """Whole texts with their candidate items to each task's best scores."""
    def emit(batches):
        held, pending = [], 0

        def kept():
            items, ids, scores = (np.concatenate(c) for c in zip(*held))
            at = _best(items, ids, scores, top)
            return items[at], ids[at], scores[at]

        for batch in batches:
            ids, items = batch.column("doc_id").to_numpy(), batch.column("items")
            off, raw = text_buffers(batch.column("text"))
            for a, b, o, r in doc_chunks(off, raw):
                n, doc, hashes, tf = term_counts(o, r)
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                for i in np.flatnonzero(n):
                    wanted = np.searchsorted(group.items, items[a + int(i)].values.to_numpy())
                    mine = slice(edges[i], edges[i + 1])
                    score = group.scores(wanted, hashes[mine], tf[mine], n[i], n_docs, n_terms)
                    hit = score > 0
                    held.append((group.items[wanted[hit]], np.full(hit.sum(), ids[a + i]), score[hit]))
                    pending += int(hit.sum())
                if pending > PENDING:
                    held = [kept()]
                    pending = len(held[0][0])
        if held:
            yield _pairs(*kept(), ["item", "doc_id", "score"])
    return emit


def _exact(pairs: DataFrame, docs: DataFrame, group: ItemGroup, index: Index, top: int) -> DataFrame:
    """(item, doc_id, score) of the ``top`` of the pairs' documents."""
    wanted = staged(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "wanted")
    scored = docs.join(wanted, "doc_id").select("doc_id", "text", "items").mapInArrow(
        _rescored(group, index.n_docs, index.n_terms, top), "item long, doc_id long, score long")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
                             ).where(F.col("rank") <= top)


def search(index: Index, docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id",
           item_text: str = "text", id_col: str = "doc_id", text_col: str = "text",
           item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of the
    indexed ``docs`` with a score above 0, ties by ascending id.

    A null, empty or unknown item text finds nothing; equal item rows count
    once; an item id with several texts gets a ranking for each; a null
    ``item_id`` is an id too.  Documents without an id are not found, those
    that repeat one are ranked each.  Empty tables give no row.
    """
    prepare(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
                       ).where("doc_id is not null")
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    named = staged(named.withColumn("item", F.monotonically_increasing_id()), "items")
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)))
    weighted = staged(named.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long")
                      .join(index.terms, "term").select("item", "term", (weight * F.col("times")).cast("long").alias("weight"))
                      .where("weight > 0"), "item-terms")
    size = weighted.agg(F.count(F.lit(1)), F.count_distinct("item")).collect()[0]
    groups = max(1, -(-size[0] // item_terms), -(-size[1] // ITEMS))
    found = None
    for g in range(groups):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).toArrow()
        if not rows.num_rows:
            continue
        columns = [rows.column(c).to_numpy() for c in ("item", "term", "weight")]
        group = ItemGroup(columns[0], columns[1].view(_U), columns[2])
        seeds = index.blocks.mapInArrow(_highest_bounds(group, index.n_docs, index.n_terms, top),
                                        "item long, doc_id long, bound long")
        best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
        seeds = seeds.withColumn("place", best).where(F.col("place") <= top).drop("place")
        reached = (_exact(seeds, base, group, index, top).groupBy("item")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).toArrow())
        thresholds = np.ones(len(group.items))
        thresholds[np.searchsorted(group.items, reached.column("item").to_numpy())] = reached.column("least").to_numpy()
        left = staged(index.blocks.mapInArrow(_not_excluded(group, thresholds, index.n_docs, index.n_terms),
                                              "item long, doc_id long, bound long"), "not-excluded")
        part = staged(_exact(left, base, group, index, top), "ranked")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = weighted.select("item", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"),
                                F.lit(0).alias("rank")).limit(0)
    return found.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    from ratestat.llm.common import documents
    from ratestat.sources.tables import read_table
    docs = documents(spark, sf_dir, "doc_id", "text")
    return search(build_index(docs), docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
), qt AS (SELECT item_id, text, term, count(*) AS times FROM q GROUP BY ALL),
w AS (
  SELECT item_id, text, term, times * CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * CAST(df AS DOUBLE) + 1))) AS BIGINT) AS w
  FROM qt JOIN df USING (term), total
), m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n, total),
s AS (
  SELECT item_id, text, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank
  FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
