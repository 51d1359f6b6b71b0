"""Ordered greedy selection: few jobs for long chains, the same result by every way."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loamworks.functions import text as T
from loamworks.operators import dedup, joins


def sequential(n, edges):
    before, kept = {}, set()
    for a, b in edges:
        before.setdefault(b, []).append(a)
    for i in range(n):
        if not any(a in kept for a in before.get(i, [])):
            kept.add(i)
    return kept


def test_a_chain_takes_few_jobs(spark):
    n = 10_000
    nodes, edges = spark.range(n), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "greedy over a chain")
    got = {r.id for r in dedup.greedy(nodes, edges, "id").collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == set(range(0, n, 2)) and jobs < 30


@pytest.mark.parametrize("small, rounds", [(2_000_000, 6), (60, 2), (40, 3), (0, 100)])
def test_all_ways_agree(spark, monkeypatch, small, rounds):
    """One task, components of bounded size, larger ones in rounds, rounds alone."""
    monkeypatch.setattr(dedup, "SMALL", small)
    monkeypatch.setattr(dedup, "ROUNDS", rounds)
    dice = random.Random(1)
    edges = {(i, i + 1) for i in range(0, 12)} | {tuple(sorted(dice.sample(range(100, 160), 2))) for _ in range(120)} | {tuple(sorted(dice.sample(range(20, 99), 2))) for _ in range(50)}
    df = spark.createDataFrame([Row(a=a, b=b) for a, b in edges])
    assert {r.id for r in dedup.greedy(spark.range(170), df, "id").collect()} == sequential(170, edges)
    assert dedup.greedy(spark.range(5), df.limit(0), "id").count() == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 501), (501, 600), (700, 650)]
    from loamworks.session import Workspace

    got = {r.node: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 500: 500, 501: 500, 600: 500, 700: 650, 650: 650}


def test_equal_sets_have_one_pair_each(spark):
    rows = [Row(id=i, v=["a", "b", "c", str(i % 2)]) for i in range(40)] + [Row(id=90, v=[]), Row(id=91, v=[])]
    pairs = joins.jaccard_classes(spark.createDataFrame(rows), "id", "v", 0.6).collect()
    assert sorted((r.a, r.b, round(r.similarity, 3)) for r in pairs) == sorted([(0, 1, 0.6)] + [(i % 2, i, 1.0) for i in range(2, 40)])


def test_fuzzy_drops_rows_of_equal_grams(spark):
    rows = [Row(id=0, t="abcabcabcabc"), Row(id=1, t="abc abcabcabcabc"), Row(id=2, t="something else here"), Row(id=3, t="ab"), Row(id=4, t="xy"), Row(id=5, t="bcabcabcabca")]
    assert sorted(r.id for r in dedup.fuzzy(spark.createDataFrame(rows), "id", "t").collect()) == [0, 2, 3, 4]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_grams_are_those_of_the_texts(spark, n):
    """Each text's grams are told apart as strings are, and so many as the column function gives; no substring is taken for each of them."""
    texts = ["", "ab", "abcabcab", "患者 abc患者abc", "😀😀a😀😀a", "a b\nc\td", "é" * 9, "é" * 9]
    sets = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", T.char_grams(F.col("t"), n).alias("want"), F.replace("t", F.lit(" "), F.lit("")).cast("binary").alias("body"))
    rows = {r.k: r.want for r in sets.collect()}
    got = {r.key: r for r in sets.select("k", "body").mapInArrow(dedup._grams(n), "key long, grams array<long>, print binary").collect()}
    for i in rows:
        assert len(set(got[i].grams)) == len(got[i].grams) == len(rows[i]) and (got[i].print is None) == (not rows[i])
        for j in rows:
            assert len(set(got[i].grams) & set(got[j].grams)) == len(set(rows[i]) & set(rows[j]))
            assert not rows[i] or (got[i].print == got[j].print) == (set(rows[i]) == set(rows[j]))
