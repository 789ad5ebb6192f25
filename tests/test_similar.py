"""The similarity join of names against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import similar

WORDS = "токарный фрезерный станок патрон тиски optimum tu 2304 2304v pro max набор резцов для по металлу 125 мм x y".split()


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@settings(max_examples=400, deadline=None)
@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_bounds_hold(a, b):
    """What the index proves of a pair is true: shared grams and letters bound the ratio."""
    total, matched = len(a) + len(b), round(ratio(a, b) * (len(a) + len(b)) / 2)
    shared = (similar.grams(a) & similar.grams(b)).total()
    assert total == 0 or shared >= 2 * matched - total / 2 - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c1", max_size=10), min_size=1, max_size=25, unique=True), st.text("ab c1", max_size=10), st.sampled_from([0.5, 0.6, 0.75, 1.0]), st.integers(1, 4))
def test_index_by_brute_force(names, name, least, top):
    found = dict(similar.GramIndex(names).alike(name, least, top))
    every = sorted(((ratio(name, n), n) for n in names if ratio(name, n) >= least), reverse=True)
    assert all(found[n] == r for r, n in every if n in found)
    needed = [n for r, n in every if r >= every[min(top, len(every)) - 1][0]]
    assert set(needed) <= set(found)


def names_of(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("cell", [2048, 16])
def test_join_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    rng = random.Random(cell)
    left = [(f"s{i}", rng.choice(["a", "b", "c"]), n) for i, n in enumerate(names_of(rng, 150))]
    right = [(i, rng.choice(["a", "b", "d"]), n) for i, n in enumerate(names_of(rng, 250))]
    got = similar.similar_pairs(
        spark.createDataFrame(left, "key string, block string, name string"), spark.createDataFrame(right, "key bigint, block string, name string"), 0.6, 3, F.col("right_key").cast("string").desc()
    )
    expected = []
    for key, block, name in left:
        scored = sorted(((ratio(name, n), str(k), k) for k, b, n in right if b == block and ratio(name, n) >= 0.6), reverse=True)
        expected += [(key, k, r) for r, _, k in scored[:3]]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_one_large_block(spark):
    """A block of 5,000 names: as all pairs, which a sample of its sources is compared with."""
    rng = random.Random(5)
    right = list(dict.fromkeys(f"{n} {rng.randint(0, 900)}" for n in names_of(rng, 5000)))
    left = names_of(rng, 40)
    made = spark.createDataFrame([("a", n) for n in left], "block string, name string"), spark.createDataFrame([("a", n) for n in right], "block string, name string")
    found = {}
    for r in similar.similar_names(*made, 0.6, 10).collect():
        found.setdefault(r.left_name, {})[r.right_name] = r.ratio
    for name in set(left):
        every = sorted(((ratio(name, n), n) for n in right if ratio(name, n) >= 0.6), reverse=True)
        needed = {n: r for r, n in every if r >= every[min(10, len(every)) - 1][0]}
        assert needed.items() <= found.get(name, {}).items()


def test_low_ratios_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], "block string, name string")
    with pytest.raises(ValueError, match="one half"):
        similar.similar_names(df, df, 0.4, 1)
