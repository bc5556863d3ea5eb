"""Vantage-point SimHash against all pairs, tree properties and edge rows."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from ratestat.llm import simhash_tree as tree

SCHEMA = "doc_id long, text string, print long, rep long, home boolean, shard string"


def slow_print(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + ([word] if word else []), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    grams = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, distance=3):
    """doc -> least doc reachable; nodes are (doc, fingerprint)."""
    group = {d: d for d, _ in nodes}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d
    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if (x ^ y).bit_count() <= distance:
                lo, hi = sorted((find(a), find(b)))
                group[hi] = lo
    return {d: find(d) for d, _ in nodes}


def test_fingerprint_matches_the_definition(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one Two", "a b c", "a b c a b c a", "naïve Ünï ÀB 语言 x", "x\x0by\x0cz\x1fq w",
             " ".join(rng.choice(["Ab", "cd", "ef", "ÉÀ"]) for _ in range(300))]
    texts += [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)) for n in (2, 3, 4, 70, 5000)]
    assert [tree.fingerprint(t) for t in texts] == [slow_print(t) for t in texts]
    shown = spark.createDataFrame([("One two three",)], "t string").selectExpr("xxhash64(lower(t)) h").collect()[0]["h"]
    assert tree.fingerprint("One two THREE") == shown % (1 << 64)


def near(rng, print_, bits):
    for b in rng.sample(range(64), bits):
        print_ ^= 1 << b
    return print_


def prints():
    """Random fingerprints, chains of near ones, a dense cluster and copies."""
    rng = random.Random(4)
    out = [rng.getrandbits(64) for _ in range(1200)]
    for base in out[:150]:
        for _ in range(rng.randint(1, 3)):
            base = near(rng, base, rng.randint(1, 5))
            out.append(base)
    centre = rng.getrandbits(64)
    return out + [near(rng, centre, rng.randint(0, 3)) for _ in range(300)] + [0, 7, 1 << 63]


@pytest.mark.parametrize("limits", [{}, {"shard": 20, "sample": 400}, {"shard": 50, "homes": 15, "visitors": 40}])
def test_links_give_the_components_of_all_pairs(spark, limits):
    values = sorted(set(prints()))
    frame = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "rep long, print long")
    group = {i: i for i in range(len(values))}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d
    for r in tree.near_links(frame.repartition(3), **limits).collect():
        lo, hi = sorted((find(r["a"]), find(r["b"])))
        group[hi] = lo
    assert {i: find(i) for i in group} == slow_components(list(enumerate(values)))


def test_visits_reach_every_point_within_the_radius():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 32, 3000).astype(np.uint64)
    for radius in (1, 2):
        queries = points.copy()
        for _ in range(radius):
            queries ^= np.uint64(1) << rng.integers(0, 32, len(points)).astype(np.uint64)
        grown, leaves = tree.build_tree(points, radius, 40)
        home = tree.home_leaf(grown, points)
        visited = {(leaf, q) for leaf, at in tree.visit(grown, queries, radius) for q in at.tolist()}
        assert leaves > 20 and len(visited) < .8 * leaves * len(points)
        assert all((home[q], q) in visited for q in range(len(points)))


def test_classes_settle():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    found = tree.Classes(500)
    for k in range(0, 300, 50):
        found.add(a[k:k + 50], b[k:k + 50])
        found.settle()
    neighbours = {i: {i} for i in range(500)}
    for x, y in zip(a.tolist(), b.tolist()):
        union = neighbours[x] | neighbours[y]
        for z in union:
            neighbours[z] = union
    assert found.root.tolist() == [min(neighbours[i]) for i in range(500)]


def test_dedup_of_texts(spark):
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i * 5 % 307, prose(rng.randint(1, 80))) for i in range(200)]
    base = prose(800).split(" ")
    for k in range(25):
        copy = list(base)
        copy[rng.randrange(800)] = f"edit{k}"
        rows.append((400 + k, " ".join(copy)))
    rows += [(500, " ".join(base).upper()), (501, None), (502, ""), (503, " \n "), (450 + 60, "x " * 50), (512, "x " * 30),
             (None, " ".join(base)), (None, None), rows[4], (520, "long " + prose(20000)), (521, rows[0][1]), (521, rows[1][1])]
    frame = spark.createDataFrame([(i, t, 1, 2, True, "s") for i, t in rows], SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in tree.simhash_dedup(frame).collect())
    named = [(i, slow_print(t)) for i, t in rows]
    known = slow_components([(i, p) for i, p in named if i is not None])
    assert got == Counter((i, f"{p:016x}", None if i is None else known[i]) for i, p in named)
    assert known[501] == known[502] == known[503] and len({known[400 + k] for k in range(25)}) < 25
    assert tree.simhash_dedup(frame.limit(0)).count() == 0
