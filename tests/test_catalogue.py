"""Every query of the catalogue against DuckDB on the same tables, or against a plain sequential model."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loamworks.plans import catalogue
from loamworks.streaming.state import bucket_step, window_step

from .conftest import SF


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value).removesuffix("+00:00")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_oracle(spark, tables, name):
    got = catalogue.queries()[name](spark, SF)
    want = tables.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    wanted = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall())
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()  # all columns are computed
    assert rows and all(any(r[c] is not None for r in rows) for c in got.columns)


def test_entry_runs(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    rows = out.collect()
    assert rows and out.columns == ["source", "samples", "avg_quality", "ratio", "creator_share", "platform_fee"]
    assert math.isclose(sum(r.ratio for r in rows), 1, abs_tol=1e-4)


@pytest.mark.parametrize("name, step", [("rate_limit", lambda t: window_step(t, [], 2, 86400.0)[0]), ("token_bucket", lambda t: bucket_step(t, 3.0, None, 3.0, 3 / 86400)[0])])
def test_admission_equals_sequential_model(spark, name, step):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).collect()
    want = {}
    for user in {r.user_id for r in events}:
        own = sorted((r.t, r.event_id) for r in events if r.user_id == user)
        want |= dict(zip([e for _, e in own], step([t for t, _ in own]), strict=True))
    got = catalogue.queries()[name](spark, SF).collect()
    assert {r.event_id: r.allowed for r in got} == want and len(set(want.values())) == 2
