"""Streams with state and timers against their twins over tables: out of order, and over a restart from the checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from loamworks.operators import ledgers
from loamworks.operators import valuation as V
from loamworks.streaming import timed

START = 1_700_000_000


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get(timed.STORE[0])
    spark.conf.set(*timed.STORE)
    yield
    spark.conf.set(timed.STORE[0], before)


def run(spark, tmp_path, parts, schema, make):
    """The rows of a stream over parts, one file each and a new query for each: every one goes on from the checkpoint."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(s) AS ts").drop("s").coalesce(1).write.parquet(f"{tmp_path}/all/part={n}")
        spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(s) AS ts").drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        query = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/all").drop("part")


def shuffled(rows, dice, parts=3, spread=300):
    """rows (with seconds at s) in parts, each out of order by less than spread seconds; a last row far on lets all times pass."""
    rows = sorted(rows, key=lambda r: r[0] + dice.random() * spread)
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_demand_equals_its_table(spark, tmp_path):
    dice = random.Random(1)
    rows = [(START + dice.randrange(6000) + dice.choice((0.0, 0.25)), n, dice.choice("ab")) for n in range(300)]
    parts = shuffled(rows, dice) + [[(START + 1e6, -1, "end")]]
    got, table = run(spark, tmp_path, parts, "s double, id long, domain string", lambda s: timed.stream_demand(s, "domain", "ts", "id", F.lit(1000), F.lit(25)))
    want = V.demand_ledger(table.where("id >= 0"), "domain", "ts", "id", F.lit(1000), F.lit(25)).select("domain", "id", "demand", "price")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 300


def test_access_equals_its_table(spark, tmp_path):
    dice = random.Random(2)
    rows = []
    for n in range(500):
        kind = dice.choice(("purchase", "call", "call", "call", "call", "revoke" if n % 3 == 0 else "call"))
        rows.append((START + dice.randrange(9000), n, f"a{dice.randrange(2)}", f"c{dice.randrange(4)}", kind, dice.choice((1, 3, 5)) if kind == "purchase" else None, dice.choice((200.0, 900.0)) if kind == "purchase" else None))
    parts = shuffled(rows, dice) + [[(START + 10**6, -1, "end", "end", "call", None, None)]]
    got, table = run(spark, tmp_path, parts, "s long, id long, asset string, caller string, kind string, quota long, ttl double", lambda s: timed.stream_access(s, "asset", "caller", "ts", "id"))
    want = ledgers.access_calls(table.where("id >= 0"), ["asset", "caller"], "ts", "id").collect()
    calls = got.where("kind = 'call'").collect()
    decided = lambda rows: sorted((r.asset, r.caller, r.id, r.granted) for r in rows)
    assert decided(calls) == decided(want) and {r.granted for r in want} == {True, False}
    granted = {r.id: r.used for r in want if r.granted}
    assert granted == {r.id: r.used for r in calls if r.granted}
    assert got.where("kind = 'expired'").count() > 10


def test_access_equals_a_sequential_model(spark):
    dice = random.Random(3)
    rows = []
    for n in range(600):
        kind = dice.choice(("purchase", "call", "call", "call", "revoke"))
        rows.append((START + dice.randrange(300), n, f"c{dice.randrange(3)}", kind, dice.choice((0, 1, 4)) if kind == "purchase" else None, dice.choice((5.0, 40.0)) if kind == "purchase" else None))
    table = spark.createDataFrame(rows, "s long, id long, caller string, kind string, quota long, ttl double").withColumn("ts", F.timestamp_seconds("s"))
    tokens, want = {}, {}
    for s, n, caller, kind, quota, ttl in sorted(rows, key=lambda r: (r[0], ledgers.RANK[r[3]], r[1])):
        token = tokens.get(caller)
        if kind == "purchase":
            tokens[caller] = [s + ttl, quota, False]
        elif kind == "revoke" and token:
            token[2] = True
        elif kind == "call":
            want[n] = bool(token and not token[2] and s < token[0] and token[1] > 0)
            if want[n]:
                token[1] -= 1
    assert {r.id: r.granted for r in ledgers.access_calls(table, ["caller"], "ts", "id").collect()} == want


def test_jobs_end_or_time_out(spark, tmp_path):
    steps = ["annotating", "scoring", "packaging"]
    rows = [(START + j * 10 + 60 * k, 10 * j + k, f"j{j}", stage) for j in range(20) for k, stage in enumerate(steps)]
    rows += [(START + j * 10 + 200, 10 * j + 8, f"j{j}", "done" if j % 4 == 0 else "failed") for j in range(0, 20, 2)]
    rows += [(START + j * 10 + 260, 10 * j + 9, f"j{j}", "scoring") for j in range(0, 20, 2)]  # after the end
    rows += [(START + j * 10 + 700, 10 * j + 9, f"j{j}", "done") for j in range(1, 20, 4)]  # too late
    dice = random.Random(4)
    parts = shuffled(rows, dice, spread=60) + [[(START + 10**5, -1, "end", "done")]]
    got, table = run(spark, tmp_path, parts, "s long, id long, job string, stage string", lambda s: timed.stream_progress(s, "job", "ts", "id", late="2 minutes"))
    want = ledgers.job_progress(table.where("id >= 0"), "job", "ts", "id")
    plain = lambda df: sorted((r.job, r.at, r.stage, r.error or "") for r in df.where("job <> 'end'").collect())
    assert plain(got) == plain(want)
    ends = {r[0]: r for r in plain(want)}  # the last row of each
    assert all(ends[f"j{j}"][2:] == (("done" if j % 4 == 0 else "failed", "") if j % 2 == 0 else ("failed", "timeout")) for j in range(20))


def test_newest_alerts_stay_bounded(spark, tmp_path):
    dice = random.Random(5)
    rows = [(START + dice.randrange(4000), f"k{n:03d}") for n in range(400)]
    parts = shuffled(rows, dice) + [[(START + 10**6, "end")]]
    got, table = run(spark, tmp_path, parts, "s long, id string", lambda s: timed.stream_newest(s, "ts", "id", n=20, shards=4, late="10 minutes"))
    got = got.where("id <> 'end'")
    assert got.groupBy("shard", "version").count().agg(F.max("count")).first()[0] == 20
    want = ledgers.retained(table.where("id <> 'end'"), ["ts", "id"], 20)
    assert [r.id for r in timed.newest_of(got, 20).collect()] == [r.id for r in want.collect()]


def test_alerts_fire_and_resolve(spark):
    none = spark.createDataFrame([], "severity string, job string, stage string, message string, at timestamp, resolved boolean, alert_id string")
    two = ledgers.fired(ledgers.fired(none, "j1", "qc", "warning", "slow", "2024-01-01 00:00:00"), "j2", "qc", "critical", "stopped", "2024-01-02 00:00:00")
    first = two.where("job = 'j1'").select("alert_id")
    after = ledgers.resolved(two, first.unionByName(first))
    assert [r.job for r in ledgers.shown_alerts(after).collect()] == ["j2"]
    assert [r.job for r in ledgers.shown_alerts(after, include_resolved=True).collect()] == ["j2", "j1"] and two.columns == after.select(two.columns).columns
