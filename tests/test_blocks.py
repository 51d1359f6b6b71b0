"""Joins of blocks of vectors, and admission control over hot keys."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loamworks.operators import blocks, joins, ledgers
from loamworks.operators import valuation as V
from loamworks.streaming import state

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    """query: ([(distance, id)], n, mean, spread) by all pairs."""
    fine = [(i, np.array(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    out = {}
    for q, v in fine:
        if q in queries:
            sims = [(cosine(v, w), i) for i, w in fine if i != q and len(w) == len(v)]
            if sims:
                near = sorted((round(1 - s, 12), i) for s, i in sims)[:k]
                out[q] = [i for _, i in near], len(sims), np.mean([s for s, _ in sims]), np.std([s for s, _ in sims])
    return out


@pytest.mark.parametrize("sent", [64 << 20, 4000])
def test_all_rows_meet_all_rows(spark, monkeypatch, sent):
    """Sent to all tasks, or dealt to cells; odd vectors, ties, and vectors of another length."""
    for name, value in (("BLOCK", 200), ("ASKED", 90), ("SENT", sent)):
        monkeypatch.setattr(blocks, name, value)
    dice = random.Random(1)
    rows = [(i, [dice.gauss(0, 1) for _ in range(9)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, [0.0] * 9), (301, None), (302, [1.0, None] + [0.0] * 7), (303, [float("nan")] * 9), (304, [1.0, 2.0]), (305, [2.0, 1.0]), (306, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows were collected"))
    near = joins.neighbours(df, df, 4)
    monkeypatch.undo()
    got = {r.query: ([x.id for x in r.near], r.n, r["mean"], r.spread) for r in near.collect()}
    want = brute(rows, {i for i, _ in rows}, 4)
    assert set(got) == set(want)
    for q, (ids, n, mean, spread) in want.items():
        assert got[q][:2] == (ids, n) and abs(got[q][2] - mean) < 1e-9 and abs(got[q][3] - spread) < 1e-7, q


def test_bootstrap_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 40)
    dice = np.random.default_rng(2)
    rows = [(i, [float(x) for x in dice.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    inside = {(r.vec_id, b): r.m[b] for r in df.select("vec_id", V.members(F.col("vec_id"), 6, 0.7, 5).alias("m")).collect() for b in range(6)}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for r in V.bootstrap_scores(df.where("vec_id % 7 = 0"), df, rounds=6, seed=5).collect():
        gains = []
        for b in range(6):
            some = [i for i, _ in rows if i != r.query and inside[i, b]]
            total = sum(np.array(rows[i][1]) for i in some)
            away = np.clip(1 - unit[r.query] @ total / np.linalg.norm(total), 0, 2) / 2
            gains.append(0.6 * away + 0.4 * np.clip((1 - max(unit[r.query] @ unit[i] for i in some)) / 2, 0, 1))
        assert abs(r.score - (10 + 90 * np.mean(gains))) < 0.006
        assert abs(r.confidence - max(0, 1 - np.std(gains) / np.mean(gains))) < 6e-4


@pytest.mark.parametrize("kind", ["window", "bucket"])
def test_hot_keys_are_cut_at_pauses(spark, kind):
    """A third of all rows have one key, busy and quiet in turn; null keys and ties in time too."""
    dice = random.Random(3)
    rows, t = [], 0
    for n in range(3000):
        t += dice.choice((0, 1, 1, 2, 9)) if n % 40 else 80
        key = "hot" if n % 3 == 0 else dice.choice(("a", "b", None, *"cdefgh"))
        rows.append((n, key, 1_700_000_000.25 + t))
    df = spark.createDataFrame(rows, "id long, u string, s double").select("id", "u", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts")).repartition(7)
    want = {}
    for key in {k for _, k, _ in rows}:
        own = sorted((t, n) for n, k, t in rows if k == key)
        times = [t for t, _ in own]
        ok = state.window_step(times, [], 5, 30.0)[0] if kind == "window" else state.bucket_step(times, 4.0, None, 4.0, 0.2)[0]
        want |= dict(zip([n for _, n in own], ok, strict=True))
    out = state.rate_limit(df, "u", "ts", "id", 5, 30.0) if kind == "window" else state.token_bucket(df, "u", "ts", "id", 4.0, 0.2)
    got = out.collect()
    assert len(got) == 3000 and {r.id: r.allowed for r in got} == want and len(set(want.values())) == 2
    assert state.rate_limit(df.limit(0), "u", "ts", "id", 5, 30.0).count() == 0


def test_numbers_within_a_hot_group(spark):
    dice = random.Random(4)
    rows = [Row(id=i, g=None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", at=dice.randrange(100)) for i in range(2000)]
    got = {r.id: r.number for r in ledgers.numbered(spark.createDataFrame(rows).repartition(9), "g", ["at", "id"]).collect()}
    for g in {r.g for r in rows}:
        own = sorted((r.at, r.id) for r in rows if r.g == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_a_task_keeps_a_bounded_number_of_queries(spark, monkeypatch):
    """More queries than a task keeps: parts are given out early, and the result is that of all pairs."""
    for name, value in (("BLOCK", 90), ("ASKED", 45)):
        monkeypatch.setattr(blocks, name, value)
    dice = random.Random(9)
    rows = [(i, [dice.gauss(0, 1) for _ in range(9)]) for i in range(70)] + [(100 + i, [1.0] * 9) for i in range(20)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    monkeypatch.setattr(joins, "HELD", 10)
    monkeypatch.setattr(joins, "STRIP", 2)
    made = []
    keep = joins._Near
    monkeypatch.setattr(joins, "_Near", lambda ids: made.append(len(ids)) or keep(ids))
    pairs = [(f"q{a}", [i for i, _ in rows[a : a + 5]], [i for i, _ in rows[b : b + 10]]) for b in range(0, 90, 10) for a in range(0, 90, 5)]
    block = lambda ids: np.array([unit[i] for i in ids]).tobytes()
    batch = pa.RecordBatch.from_pydict({"dim": pa.array([9] * len(pairs), pa.int32()), "q_at": [p[0] for p in pairs], "q_ids": [p[1] for p in pairs], "q_data": [block(p[1]) for p in pairs], "ids": [p[2] for p in pairs], "data": [block(p[2]) for p in pairs]})
    found = {}
    for out in joins._nearest(4)(iter([batch])):
        assert out.num_rows <= 5
        for r in out.to_pylist():
            known = found.setdefault(r["query"], [[], 0])
            known[0] += [(x["distance"], x["id"]) for x in r["near"]]
            known[1] += r["n"]
    want = brute(rows, {i for i, _ in rows}, 4)
    assert {q: ([i for _, i in sorted(near)[:4]], n) for q, (near, n) in found.items()} == {q: w[:2] for q, w in want.items()}
    assert len(made) > 18  # given out and begun anew
