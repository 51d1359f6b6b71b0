import math
import random

import numpy as np
import pytest
from pyspark.sql import Row

from loamworks.llm import segment_search

SCHEMA = "vec_id long, embedding array<double>, dim int, score long, rank int"


def brute(rows, k=5, every=50):
    fine = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for n, (q, v) in enumerate(fine):
        if q is None or q % every:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i is None, i or 0, i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v)]
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


def test_odd_vectors(spark):
    dice = random.Random(2)
    vector = lambda n: [dice.gauss(0, 1) for _ in range(n)]
    rows = [Row(vec_id=i, embedding=vector(19), dim=1, score=1, rank=1) for i in range(0, 400)]
    rows += [Row(vec_id=i, embedding=vector(7), dim=None, score=None, rank=None) for i in (100, 1000, 1001, 1002)]  # another length, few of them
    rows += [Row(vec_id=None, embedding=vector(19), dim=1, score=1, rank=1), Row(vec_id=None, embedding=rows[50].embedding, dim=1, score=1, rank=1)]
    rows += [Row(vec_id=50, embedding=rows[50].embedding, dim=1, score=1, rank=1)] * 2  # repeated rows
    rows += [Row(vec_id=500 + i, embedding=rows[100].embedding, dim=1, score=1, rank=1) for i in range(150)]  # ties
    rows += [Row(vec_id=2000, embedding=v, dim=1, score=1, rank=1) for v in (None, [], [math.nan] * 19, [1.0, None], [math.inf] * 19)]
    rows += [Row(vec_id=2050, embedding=[], dim=1, score=1, rank=1)]
    rows += [Row(vec_id=i, embedding=[2.0**40 + i, 3.0, -(2.0**30)], dim=1, score=1, rank=1) for i in range(3000, 3012)]  # beyond 2**53
    rows += [Row(vec_id=i, embedding=[(-1) ** i * 1e300, 3.0, 1.0], dim=1, score=1, rank=1) for i in range(3100, 3103)]  # beyond a long
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(segment_search.digest(df)) == brute(rows)
    assert segment_search.digest(df.limit(0)).count() == 0
    assert segment_search.digest(df.where("vec_id = 50")).count() == 3 * 2  # fewer candidates than k


def test_rounds_groups_and_pruning(spark, monkeypatch):
    """Small blocks, several groups of queries and rounds; clustered vectors, so bounds of each level have work."""
    for name, value in (("BLOCK", 32 * 40), ("ASKED", 32 * 3), ("SENT", 2000), ("GROWTH", 3)):
        monkeypatch.setattr(segment_search, name, value)
    dice = np.random.default_rng(4)
    centres = dice.normal(size=(12, 32))
    rows = [Row(vec_id=i, embedding=[float(x) for x in centres[i % 12] + 0.05 * dice.normal(size=32)], dim=1, score=1, rank=1) for i in range(600)]
    assert found(segment_search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 40)) == brute(rows, 3, 40)


@pytest.mark.parametrize("dim", [1, 3, 16, 50, 64])
def test_bounds_hold_on_every_level(dim):
    dice = np.random.default_rng(dim)
    a, b = np.floor(256 * dice.normal(size=(40, dim))), np.floor(256 * dice.normal(size=(60, dim)))
    sa, sb = segment_search.statistics(a), segment_search.statistics(b)
    last = None
    for level in segment_search._levels(dim):
        bound = sa[:, level] @ sb[:, level].T
        assert (bound >= a @ b.T - 1e-6 * np.abs(bound) - 1e-6).all()
        assert last is None or (bound <= last + 1e-6 * np.abs(last) + 1e-6).all()  # finer is tighter
        last = bound
    assert segment_search.statistics(a).shape[1] == segment_search._levels(dim)[-1].stop


def test_survivors_leave_out_only_hopeless_pairs():
    dice = np.random.default_rng(9)
    centre = dice.normal(size=64) * 300
    q, c = np.floor(centre + dice.normal(size=(5, 64))), np.floor(np.vstack([centre + dice.normal(size=(20, 64)), -centre + dice.normal(size=(500, 64)), dice.normal(size=(500, 64))]))
    exact = q @ c.T
    floor = np.sort(exact, axis=1)[:, -5].astype(float)
    i, j, scores = segment_search._survivors(q, segment_search.statistics(q), c, segment_search.statistics(c), floor, 5)
    assert set(j) <= set(range(20)) and (exact[i, j] == scores).all()
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= floor[:, None]))} == set(zip(i, j))
