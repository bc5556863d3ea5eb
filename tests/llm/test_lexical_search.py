"""Ranked search against scoring every document, signatures and edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ratestat.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item long, term string, rank int, bound double"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counts:
            if i is None or not c:
                continue
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(.6))}" for _ in range(4000)] + ["naïve", "语言", "A1", "b-c"]

    def prose(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    docs = [(i * 7 % 501, prose(rng.choice([1, 5, 40, 41, 200]))) for i in range(500)]
    docs += [(600 + i, docs[3][1]) for i in range(30)]                       # ties
    docs += [(700, None), (701, ""), (702, " .,! "), (703, prose(20000)), (None, docs[8][1]), docs[9], docs[9]]
    items = [(i, prose(rng.randint(1, 30))) for i in range(25)]
    items += [(50, docs[3][1]), (51, docs[8][1].upper()), (52, None), (53, "..."), (54, "unknownword"), (55, "w1 w1 w1"),
              (None, "w2 语言"), (7, "b c naïve"), (8, "A1"), (8, "A1")]
    return docs, items


def results(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("item_terms", [1 << 17, 60])
def test_search_matches_scoring_every_document(spark, item_terms):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, 1, "x", 2, .5) for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(search.build_index(frame), frame, bench, item_terms=item_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert results(got) == slow_search(docs, items)


def test_top_is_a_parameter(spark):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert results(search.search(search.build_index(frame), frame, bench, top=3)) == slow_search(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none = frame.limit(0)
    assert search.search(search.build_index(none), none, bench).count() == 0
    assert search.search(search.build_index(frame), frame, bench.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "?!")], "doc_id long, text string")
    assert search.search(search.build_index(blank), blank, bench).count() == 0


def test_bounds_are_never_below_the_scores():
    rng = np.random.default_rng(5)
    hashes = search.mix64(np.arange(1, 400, dtype=np.uint64))
    group = search.ItemGroup(np.repeat(np.arange(20), 15), rng.choice(hashes, 300), rng.integers(1, 9000, 300))
    tight = []
    for width in (256, 1024, 16384):
        rows, docs = [], []
        for i in range(50):
            mine = np.sort(rng.choice(hashes, 60, replace=False))
            tf = rng.geometric(.4, 60)
            elements = np.concatenate([search.tier_elements(mine[tf >= least], j) for j, least in enumerate(search.TIERS)])
            rows.append(search.positions(elements, width).ravel())
            docs.append((mine, tf, int(tf.sum())))
        lengths = np.array([d[2] for d in docs])
        bounds = group.bounds(width, lengths, search.sliced(rows, width).tobytes(), 50, int(lengths.sum()))
        exact = np.array([group.scores(np.arange(20), mine, tf, n, 50, int(lengths.sum())) for mine, tf, n in docs]).T
        assert (bounds >= exact).all()
        tight.append((bounds - exact).mean())
    assert tight[0] > 5 * tight[-1]
