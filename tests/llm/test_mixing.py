"""Targets, apportionment and taken words."""

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tensorweft.llm import mixing

from .conftest import awkward


def plain_targets(sizes):
    """sizes: source to size, in order; water-filling by repetition."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    total, done = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        rest = [s for s in sizes if s not in done]
        if not rest:
            return done
        level = (total - sum(done.values())) / sum(weights[s] for s in rest)
        above = [s for s in rest if level * weights[s] > 2 * sizes[s]]
        if not above:
            return done | {s: level * weights[s] for s in rest}
        done |= {s: Fraction(2 * sizes[s]) for s in above}


def plain_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("votes, seats", [([53, 24, 23], 10), ([1, 1, 1, 1], 2), ([1000, 1, 1], 7), ([7] * 9, 13), ([5, 0, 3], 4), ([100] * 30 + [1], 55), ([3], 5), ([10**6, 3, 2, 2, 1, 1, 1, 1], 40)])
def test_apportionment(spark, votes, seats):
    df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, votes long, seats long").withColumn("g", F.lit(1))
    got = {r.i: r.blocks for r in mixing.apportion(df, "votes", "seats", ["g"], ["i"], "blocks").collect()}
    assert [got[i] for i in range(len(votes))] == plain_seats(votes, seats)


def test_groups_of_shards(spark, monkeypatch):
    """With few documents a shard and few shards a group, targets are met as with one."""
    monkeypatch.setattr(mixing, "GROUP", 3)
    rows = [(i, "w " * (1 + i * 7 % 40), "ab"[i % 3 == 0]) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard=10).collect()
    for s in "ab":
        part = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 2 * mixing.BLOCK and all(r.taken <= 2 * r.size for r in part)


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(awkward())
    sizes = {}
    for _, t, _, s, _ in awkward():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    want = plain_targets({s: sizes[s] for s in order})
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= 2 * mixing.BLOCK


def test_many_shards_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 37), "s" if i % 3 else f"t{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = mixing.mix(df.coalesce(1), shard=100).collect()
    two = mixing.mix(df.orderBy(F.rand(3)).repartition(7), shard=100).collect()
    assert sorted(one) == sorted(two)
    for s in {r.source for r in one}:
        mine = [r for r in one if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * mixing.BLOCK and all(r.taken <= 2 * r.size for r in mine)


def test_empty_and_clashes(none, clashing, spark):
    assert mixing.mix(none).count() == 0
    assert mixing.mix(clashing).count() == len(awkward())
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()] == [0, 0]


def test_native(docs):
    assert not re.search("Python|Pandas|Arrow", mixing.mix(docs)._jdf.queryExecution().toString())
