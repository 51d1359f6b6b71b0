"""Stateful operators: rate limits, token buckets and ledgers, as streams and over tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamworks.session import Workspace

#: Idle seconds after which a key's state goes.
IDLE_S = 3600

# Capacity of each route's bucket, refilled once a minute.
ROUTES = {"valuate": 20, "history": 60, "ingest": 30, "batch": 5, "produce": 10, "sell": 20, "login": 10, "register": 5}


# Prefixes with a lasting limit: requests, and seconds in which they count.
LASTING = {"/api/auth/login": (10, 60.0), "/api/auth/register": (5, 60.0), "/api/dataset/batch_ingest": (5, 60.0)}


def window_step(times: list[float], accepted: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Accepts a request unless limit requests were accepted in the window before it; only accepted ones count."""
    state, out = deque(accepted), []
    for t in times:
        out.append(_window(state, t, limit, window))
    return out, list(state)


def _window(accepted: deque, t: float, limit: int, window: float) -> bool:
    while accepted and accepted[0] <= t - window:
        accepted.popleft()
    ok = len(accepted) < limit
    if ok:
        accepted.append(t)
    return ok


def bucket_step(times: list[float], level: float, last: float | None, capacity: float, rate: float) -> tuple[list[bool], float, float | None]:
    """Takes a token for each request if there is one; tokens come back at a rate up to the capacity."""
    out = []
    for t in times:
        level = min(capacity, level + (t - (last if last is not None else t)) * rate)
        last = t
        out.append(level >= 1)
        level -= level >= 1
    return out, level, last


def rate_limit(events: DataFrame, key: str, time: str, order: str, limit: int | Column, window: float | Column) -> DataFrame:
    """Each row of a table with allowed (ST-01); limit and window may differ by key."""
    return _by_key(events, key, time, order, "window", limit, window)


def token_bucket(events: DataFrame, key: str, time: str, order: str, capacity: float | Column, rate: float | Column) -> DataFrame:
    """Each row of a table with allowed (ST-02); capacity and rate may differ by key."""
    return _by_key(events, key, time, order, "bucket", capacity, rate)


def _by_key(events: DataFrame, key: str, time: str, order: str, kind: str, most: float | Column, pace: float | Column) -> DataFrame:
    """Requests decided in turn for each key, whatever share of all rows a key has.

    Rows are dealt by range of (key, time), so a key may lie in many partitions. Where a pause is so long that a
    key's state is that of a new one (all accepted requests are out of the window, or the bucket is full again), its
    requests are cut; numbers of such pieces go on from partition to partition by two small tables, a row for each
    partition. A piece then streams through one task in order, in memory for its state (limit times, or a level).
    Rows without a time are left out.
    """
    work = Workspace(events.sparkSession, "admission")
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    lean = events.select(
        F.col(key).alias("key"), F.col(order).alias("id"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"), column(most).cast("double").alias("most"), column(pace).cast("double").alias("pace")
    )
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema}
    dealt = work.table(lean.where("t IS NOT NULL").repartitionByRange("key", "t", "id").withColumn("part", F.spark_partition_id()), "dealt")
    here = F.struct(F.col("key").isNotNull().alias("some"), F.col("key").alias("key"), F.col("t").alias("t"))
    parts = Window.orderBy("part")
    before = dealt.groupBy("part").agg(F.max(here).alias("end")).select("part", F.lag("end").over(parts).alias("before"))
    line = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "t", "id")
    prior = F.coalesce(F.lag(here).over(line), F.col("before"))
    quiet = prior["t"] <= F.col("t") - F.col("pace") if kind == "window" else (F.col("t") - prior["t"]) * F.col("pace") >= F.col("most")
    fresh = prior.isNull() | ~prior["key"].eqNullSafe(F.col("key")) | quiet
    cut = dealt.join(F.broadcast(before), "part").withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("long"))
    cut = cut.withColumn("own", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("before", "fresh")
    cut = work.table(cut, "cut")
    ahead = cut.groupBy("part").agg(F.max("own").alias("n")).select("part", F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    pieces = cut.join(F.broadcast(ahead), "part").select("key", "id", "t", "most", "pace", (F.col("own") + F.col("ahead")).alias("piece"))
    pieces = pieces.repartition("piece").sortWithinPartitions("piece", "t", "id")
    out = pieces.mapInArrow(_decided(kind), f"key {kinds['key']}, id {kinds['id']}, allowed boolean")
    return out.withColumnsRenamed({"key": key, "id": order})


def _decided(kind: str):
    """A function for mapInArrow: rows of pieces one after another, with allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, accepted, level, last = None, deque(), 0.0, None
        for batch in batches:
            out = []
            for t, most, pace, piece in zip(*(batch.column(c).to_pylist() for c in ("t", "most", "pace", "piece")), strict=True):
                if piece != now:
                    now, accepted, level, last = piece, deque(), most, None
                if kind == "window":
                    out.append(_window(accepted, t, most, pace))
                else:
                    (ok,), level, last = bucket_step([t], level, last, most, pace)
                    out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(out, pa.bool_())], ["key", "id", "allowed"])

    return run


def client(forwarded: Column, host: Column) -> Column:
    """Who asks: the first forwarded address, else the host (ST-10)."""
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), host, F.lit("unknown"))


def routed_limits(requests: DataFrame, path: str, who: str, time: str, order: str, lasting: dict = LASTING, buckets: dict | None = None) -> DataFrame:
    """Each request with allowed: the first matching prefix's limit, and then the bucket of its exact path (ST-10).

    All prefixes are decided in one pass, by prefix and client, and all buckets in a second.
    """
    buckets = {f"/api/{k}": v for k, v in ROUTES.items()} if buckets is None else buckets
    of = lambda table, column: F.coalesce(*[F.when(F.col(column) == k, F.lit(float(v))) for k, v in table.items()], F.lit(None).cast("double"))
    prefix = F.coalesce(*[F.when(F.col(path).startswith(p), p) for p in lasting], F.lit(None).cast("string"))
    rows = requests.select(path, who, time, order, prefix.alias("prefix"))
    some = rows.where("prefix IS NOT NULL").withColumn("__lw_key", F.struct("prefix", who))
    limits = {p: v[0] for p, v in lasting.items()}, {p: v[1] for p, v in lasting.items()}
    first = rate_limit(some, "__lw_key", time, order, of(limits[0], "prefix"), of(limits[1], "prefix")).select(order, F.col("allowed").alias("first"))
    rows = rows.join(first, order, "left").withColumn("first", F.coalesce("first", F.col("prefix").isNull()))
    some = rows.where(F.col("first") & F.col(path).isin(*buckets)).withColumn("__lw_key", F.struct(path, who))
    second = token_bucket(some, "__lw_key", time, order, of(buckets, path), of({k: v / 60 for k, v in buckets.items()}, path)).select(order, F.col("allowed").alias("second"))
    bucketed = F.col("first") & F.col(path).isin(*buckets)
    rows = rows.where(F.col(time).isNotNull() | (F.col("prefix").isNull() & ~F.col(path).isin(*buckets)))
    return rows.join(second, order, "left").select(order, F.when(bucketed, F.coalesce("second", F.lit(False))).otherwise(F.col("first")).alias("allowed"))


def stream_rate_limit(events: DataFrame, key: str, time: str, order: str, limit: int, window: float) -> DataFrame:
    """The same over a stream: state holds the accepted times, and goes after IDLE_S without requests (ST-01, ST-03)."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        accepted = list(state.get[0]) if state.exists else []
        allowed, accepted = window_step(rows["t"].tolist(), accepted, limit, window)
        state.update((accepted,))
        state.setTimeoutDuration(IDLE_S * 1000)
        yield rows.assign(allowed=allowed)[["key", "id", "allowed"]]

    return _stateful(events, key, time, order, run, "accepted array<double>")


def stream_token_bucket(events: DataFrame, key: str, time: str, order: str, capacity: float, rate: float) -> DataFrame:
    """Token buckets over a stream (ST-02, ST-03)."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        level, last = state.get if state.exists else (capacity, None)
        allowed, level, last = bucket_step(rows["t"].tolist(), level, last, capacity, rate)
        state.update((float(level), float(last)))
        state.setTimeoutDuration(IDLE_S * 1000)
        yield rows.assign(allowed=allowed)[["key", "id", "allowed"]]

    return _stateful(events, key, time, order, run, "level double, last double")


def _stateful(events: DataFrame, key: str, time: str, order: str, run, state: str) -> DataFrame:
    lean = events.select(F.col(key).alias("key"), F.col(order).alias("id"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema}
    out = lean.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, id {kinds['id']}, allowed boolean", state, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumnsRenamed({"key": key, "id": order})


def stream_balances(ledger: DataFrame, owner: str, signed: Column) -> DataFrame:
    """Running balances, for output mode update (ST-07, A-13)."""
    return ledger.groupBy(owner).agg(F.sum(signed).alias("balance"), F.count("*").alias("entries"))


def stream_windows(events: DataFrame, time: str, group: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows with a watermark."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(w.alias("w"), *group).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *group, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def score_and_grow(events: DataFrame, corpus_path: str, score, target_path: str, checkpoint: str):
    """Scores each micro-batch against the corpus as it stands, then adds the batch to it (ST-06). Batches are told apart by id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        score(batch, spark.read.parquet(corpus_path)).write.mode("overwrite").parquet(f"{target_path}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{corpus_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
