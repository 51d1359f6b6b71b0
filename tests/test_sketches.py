"""Sketches that merge, the table function, and the two-step hand-over."""

import math
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from loamworks.functions import registry, sketches
from loamworks.operators import ledgers


def test_quantiles_within_a_thirty_second_however_they_are_merged(spark):
    dice = random.Random(1)
    rows = [Row(g=dice.choice("ab"), part=dice.randrange(5), v=int(dice.lognormvariate(6, 2)) if dice.random() < 0.9 else dice.randrange(3)) for _ in range(4000)]
    df = spark.createDataFrame([*rows, Row(g="a", part=0, v=None), Row(g="b", part=1, v=-7)], "g string, part int, v long")
    stored = sketches.quantile_sketch(df, ["g", "part"], F.col("v"))
    merged = sketches.merged_quantiles(stored, ["g"])
    at_once = sketches.quantile_sketch(df, ["g"], F.col("v"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, at_once.collect())) and merged.count() < 1200
    for r in sketches.quantiles(merged, ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        own = sorted(max(x.v, 0) for x in [*rows, Row(g="b", part=1, v=-7)] if x.g == r.g)
        exact = own[max(math.ceil(r.share * len(own)), 1) - 1]
        assert r.value <= exact <= r.value * (1 + 1 / 32) + 1e-9


def test_distinct_counts_however_they_are_merged(spark):
    rows = [Row(g="many", part=i % 7, v=f"v{i % 5000}") for i in range(12_000)] + [Row(g="few", part=i % 3, v=f"v{i % 40}") for i in range(300)] + [Row(g="few", part=0, v=None)]
    df = spark.createDataFrame(rows)
    merged = sketches.merged_distinct(sketches.distinct_sketch(df, ["g", "part"], "v"), ["g"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, sketches.distinct_sketch(df, ["g"], "v").collect()))
    kinds = {r.g: r.kinds for r in sketches.distinct_counts(merged, ["g"]).collect()}
    assert kinds["few"] == 40 and abs(kinds["many"] - 5000) < 5000 * 4 / 16


def test_visits_go_on_over_batches(spark):
    dice = random.Random(2)
    rows = [Row(key=dice.choice(("a", "b", "c")), t=float(dice.randrange(20_000))) for _ in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    registry.register_visits(spark, "lw_test_visits", 100.0)
    got = spark.sql("SELECT * FROM lw_test_visits(TABLE(SELECT * FROM {r}) PARTITION BY key ORDER BY t)", r=spark.createDataFrame(rows)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for key in "abc":
        times = sorted(r.t for r in rows if r.key == key)
        for n, t in enumerate(times):
            if n and t - times[n - 1] < 100:
                want[-1] = (key, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((key, t, t, 1))
    assert sorted(map(tuple, got)) == sorted(want)


def test_hand_over_takes_two_steps(spark):
    steps = [("transfer", 5, 7), ("accept", 7, None), ("transfer", 0, None), ("transfer", 0, 7), ("pause", 7, None), ("accept", 8, None), ("accept", 7, None), ("pause", 0, None), ("pause", 7, None), ("accept", 7, None), ("other", 1, 1), ("unpause", 7, None), ("pause", None, None)]
    rows = [Row(c=c, n=n, at=n, kind=k, actor=a, target=t) for c in (1, 2) for n, (k, a, t) in enumerate(steps)]
    got = ledgers.administered(spark.createDataFrame(rows).repartition(5), "c", "at", "n", 0).where("c = 2").orderBy("n").collect()
    assert [r.ok for r in got] == [False, False, False, True, False, False, True, False, True, False, True, True, False]
    assert (got[3].admin, got[3].pending) == (0, 7) and (got[6].admin, got[6].pending) == (7, None) and [r.paused for r in got[8:12]] == [True, True, True, False]
