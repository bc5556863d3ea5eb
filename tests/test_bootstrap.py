"""The bootstrap's tree of binomial splits and weight blocks."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from ratestat.functions.hashing import mix_keys, mix_numbers
from ratestat.operators import effects


def split(draws, replicates, sizes, seed):
    before = np.concatenate([[0], np.cumsum(sizes)])
    return np.array([effects.tree_counts(draws, replicates, before, b, seed, 0) for b in range(len(sizes))])


def test_every_replicate_keeps_its_draws():
    sizes = np.array([5, 0, 9, 1, 0, 0, 40, 13])
    counts = split(1000, 300, sizes, 7)
    assert (counts.sum(axis=0) == 1000).all() and (counts[sizes == 0] == 0).all()
    share = counts.sum(axis=1) / counts.sum()
    assert np.allclose(share, sizes / sizes.sum(), atol=.01)
    # multinomial spread and covariance of two buckets
    p = sizes / sizes.sum()
    assert counts[6].var() == pytest.approx(1000 * p[6] * (1 - p[6]), rel=.25)
    assert np.cov(counts[6], counts[7])[0, 1] == pytest.approx(-1000 * p[6] * p[7], rel=.35)


def test_tree_gives_the_multinomial_law():
    """Three draws over eight rows: every outcome as often as it should be."""
    reps = 200_000
    seen = Counter(map(tuple, split(3, reps, np.ones(8, dtype=int), 11).T.tolist()))
    chi, cells = 0.0, 0
    for picks in itertools.combinations_with_replacement(range(8), 3):
        cell = tuple(picks.count(i) for i in range(8))
        expected = reps * math.factorial(3) / math.prod(map(math.factorial, cell)) / 8 ** 3
        chi += (seen[cell] - expected) ** 2 / expected
        cells += 1
    assert sum(seen.values()) == reps and len(seen) <= cells
    assert abs(chi - (cells - 1)) < 5 * math.sqrt(2 * (cells - 1))


def test_buckets_and_partitions_do_not_change_the_law(spark):
    df = spark.range(3000).selectExpr("id as k", "if(id % 3 = 0, 'A', 'B') as g", "cast(id % 97 as double) as x")
    one = effects.bootstrap_replicates(df, "g", "x", "k", ["A", "B"], 400, None, 5)
    many = effects.bootstrap_replicates(df, "g", "x", "k", ["A", "B"], 400, None, 5, bucket_rows=100)
    again = effects.bootstrap_replicates(df.repartition(6), "g", "x", "k", ["A", "B"], 400, None, 5, bucket_rows=100)
    many, again = (f.orderBy("rep").collect() for f in (many, again))
    assert np.allclose(np.array(many, dtype=float), np.array(again, dtype=float))
    x = np.arange(0, 3000, 3) % 97
    for rows in (one.orderBy("rep").collect(), many):
        assert len(rows) == 400 and all(r["n1"] == 1000 and r["n2"] == 2000 for r in rows)
        means = np.array([r["mean1"] for r in rows])
        assert abs(means.mean() - x.mean()) < .3
        assert .85 < means.std() / (x.std() / math.sqrt(len(x))) < 1.15
        assert abs(np.mean([r["var1"] for r in rows]) - x.var()) < 15


def test_one_bucket_draws_match_a_plain_loop(spark):
    df = spark.range(40).selectExpr("id as k", "if(id < 15, 'A', 'B') as g", "cast(id * id as double) as x")
    got = {r["rep"]: r for r in effects.bootstrap_replicates(df, "g", "x", "k", ["A", "B"], 6, 9, 3).collect()}
    from ratestat.operators import indexing
    ranked = {(r["g"], r["idx"]): r["x"] for r in indexing.hash_rank(df, ["g"], ["k"], 3).collect()}
    for rep in range(6):
        for i, (g, n) in enumerate([("A", 15), ("B", 25)]):
            number = np.arange(9) + i * 6 * 9 + rep * 9
            wide = [int(a) << 31 | int(b) for a, b in zip(mix_numbers(number.copy(), mix_keys(3, "high")),
                                                            mix_numbers(number.copy(), mix_keys(3, "low")))]
            drawn = [ranked[g, w % n] for w in wide]
            assert got[rep][f"mean{i + 1}"] == pytest.approx(np.mean(drawn))
            assert got[rep][f"var{i + 1}"] == pytest.approx(np.var(drawn, ddof=1))


def test_poisson_weights_match_the_shares():
    keys = mix_keys(1, "p")
    weights = effects.poisson_weights(np.arange(4000) * 7919 % 2 ** 31, np.arange(200), keys)
    number = 5 * 7919 + (np.int64(17) << 31)
    u = int(mix_numbers(np.array([number]), keys)[0])
    assert weights[5, 17] == sum(u >= limit for limit in effects.POISSON_LIMITS)
    for k in range(5):
        assert (weights == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=.002)


def test_nothing_but_sums_is_shuffled(spark):
    df = spark.range(1000).selectExpr("id as k", "if(id % 2 = 0, 'A', 'B') as g", "cast(id as double) as x")
    plan = effects.poisson_replicates(df, "g", "x", "k", ["A", "B"], 50, 1)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
