"""Streams that take rows in the order of their times: demand ledgers, access tokens, job progress, retained alerts.

Rows wait in state until the watermark has passed them, so rows that come out of order give what the tables
in operators.ledgers give; rows behind the watermark are late and left out. State lives in the RocksDB store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loamworks.operators.ledgers import LAST, RANK, TIMEOUT_S

#: The state store that timers need; set it for the session before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Hands a key's rows on in the order of t (microseconds) and what sorts() says, once their time has passed.

    Map state holds the waiting rows by millisecond; a timer at each one takes them out, so no timer looks at more
    than its own rows. passed() is asked at every timer, for states that end at some time.
    """

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows string")
        self.opened(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for frame in rows:
            for row in json.loads(frame.drop(columns="ts").to_json(orient="records")):
                new.setdefault(-(-row["t"] // 1000), []).append(row)
        for at, some in new.items():
            kept = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (json.dumps(kept + some),))
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.waiting.containsKey((at,)):
            rows = json.loads(self.waiting.getValue((at,))[0])
            self.waiting.removeKey((at,))
            for row in sorted(rows, key=lambda r: (r["t"], *self.sorts(r))):
                out += self.row(key, row)
        out += self.passed(key, at)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Makes further state."""

    def sorts(self, row: dict) -> tuple:
        return (row["id"],)

    def row(self, key, row: dict) -> list[tuple]:
        """What a row gives."""
        return []

    def passed(self, key, at: int) -> list[tuple]:
        """What the passing of a time gives, after its rows."""
        return []


class Demand(InOrder):
    """Purchases of a domain with the demand before them and the price at it (W-04)."""

    columns = ["domain", "id", "demand", "price"]

    def opened(self, handle) -> None:
        self.demand = handle.getValueState("demand", "n long")

    def row(self, key, row: dict) -> list[tuple]:
        n = self.demand.get()[0] if self.demand.exists() else 0
        self.demand.update((n + 1,))
        return [(key[0], row["id"], n, row["base"] * (1000 + n * row["slope"]) // 1000)]


class Access(InOrder):
    """Calls with granted and used; a row of kind expired when a token's time is over (J-14, W-10).

    Value state holds the token, list state the times of its granted calls, and a timer ends both.
    """

    columns = ["asset", "caller", "id", "kind", "granted", "used"]

    def opened(self, handle) -> None:
        self.token = handle.getValueState("token", "ends long, quota long, revoked boolean")
        self.calls = handle.getListState("calls", "t long")

    def sorts(self, row: dict) -> tuple:
        return RANK[row["kind"]], row["id"]

    def row(self, key, row: dict) -> list[tuple]:
        if row["kind"] == "purchase":
            ends = row["t"] + int((row["ttl"] or 0) * 1_000_000)
            self.token.update((ends, int(row["quota"] or 0), False))
            self.calls.clear()
            self.handle.registerTimer(-(-ends // 1000))
            return []
        ends, quota, revoked = self.token.get() if self.token.exists() else (0, 0, True)
        if row["kind"] == "revoke":
            if self.token.exists():
                self.token.update((ends, quota, True))
            return []
        used = sum(1 for _ in self.calls.get()) if self.token.exists() else 0
        granted = not revoked and row["t"] < ends and used < quota
        if granted:
            self.calls.appendValue((row["t"],))
        return [(*key, row["id"], "call", granted, used + granted)]

    def passed(self, key, at: int) -> list[tuple]:
        if not self.token.exists() or -(-self.token.get()[0] // 1000) != at:
            return []
        used = sum(1 for _ in self.calls.get())
        self.token.clear()
        self.calls.clear()
        return [(*key, None, "expired", None, used)]


class Progress(InOrder):
    """A job's updates until a terminal stage, or its failure when its time is over (ST-04)."""

    columns = ["job", "at", "stage", "error"]

    def __init__(self, timeout_s: float):
        self.timeout = int(timeout_s * 1_000_000)

    def opened(self, handle) -> None:
        self.state = handle.getValueState("state", "start long, over boolean")

    def row(self, key, row: dict) -> list[tuple]:
        start, over = self.state.get() if self.state.exists() else (row["t"], False)
        if not self.state.exists():
            self.handle.registerTimer(-(-(start + self.timeout) // 1000))
        if over or row["t"] > start + self.timeout:
            return []
        self.state.update((start, row["stage"] in LAST))
        return [(key[0], row["t"] / 1e6, row["stage"], None)]

    def passed(self, key, at: int) -> list[tuple]:
        start, over = self.state.get() if self.state.exists() else (0, True)
        if over or -(-(start + self.timeout) // 1000) != at:
            return []
        self.state.update((start, True))
        return [(key[0], (start + self.timeout) / 1e6, "failed", "timeout")]


class Newest(InOrder):
    """The newest rows of a shard, in list state of a fixed length, handed out whenever they change (ST-09)."""

    columns = ["shard", "version", "t", "id"]

    def __init__(self, n: int):
        self.n = n

    def opened(self, handle) -> None:
        self.kept = handle.getListState("kept", "t long, id string")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((at,)):
            rows = [(r["t"], str(r["id"])) for r in json.loads(self.waiting.getValue((at,))[0])]
            self.waiting.removeKey((at,))
            kept = sorted([*map(tuple, self.kept.get()), *rows])[-self.n :]
            self.kept.put(kept)
            yield pd.DataFrame([(key[0], at, *k) for k in kept], columns=self.columns)


def _timed(rows: DataFrame, time: str, late: str, by: list[Column], fields: list[Column], processor: InOrder, schema: str) -> DataFrame:
    marked = rows.withWatermark(time, late)
    lean = marked.select(*by, *fields, F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(time).alias("ts")).where("t IS NOT NULL")
    names = lean.columns[: len(by)]
    return lean.groupBy(*names).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def stream_demand(purchases: DataFrame, domain: str, time: str, order: str, base: Column, slope: Column, late: str = "10 minutes") -> DataFrame:
    """domain, id, demand and price of each purchase, as valuation.demand_ledger gives them (ST-08)."""
    fields = [F.col(order).cast("long").alias("id"), base.cast("long").alias("base"), slope.cast("long").alias("slope")]
    return _timed(purchases, time, late, [F.col(domain).cast("string").alias("domain")], fields, Demand(), "domain string, id long, demand long, price long")


def stream_access(log: DataFrame, asset: str, caller: str, time: str, order: str, late: str = "10 minutes") -> DataFrame:
    """Calls as ledgers.access_calls decides them, and a row for each token that expires (ST-08)."""
    by = [F.col(asset).cast("string").alias("asset"), F.col(caller).cast("string").alias("caller")]
    fields = [F.col(order).cast("long").alias("id"), "kind", F.col("quota").cast("long").alias("quota"), F.col("ttl").cast("double").alias("ttl")]
    return _timed(log, time, late, by, fields, Access(), "asset string, caller string, id long, kind string, granted boolean, used long")


def stream_progress(updates: DataFrame, job: str, time: str, order: str, timeout_s: float = TIMEOUT_S, late: str = "10 seconds") -> DataFrame:
    """Updates as ledgers.job_progress gives them; a job without an end fails when the watermark passes its timeout (ST-04)."""
    fields = [F.col(order).cast("long").alias("id"), F.col("stage")]
    return _timed(updates, time, late, [F.col(job).cast("string").alias("job")], fields, Progress(timeout_s), "job string, at double, stage string, error string")


def stream_newest(alerts: DataFrame, time: str, order: str, n: int = 500, shards: int = 16, late: str = "10 seconds") -> DataFrame:
    """Versions of the n newest rows of each shard; the newest of all are among the last versions' (ST-09)."""
    shard = F.pmod(F.xxhash64(order), F.lit(shards)).cast("string").alias("shard")
    return _timed(alerts, time, late, [shard], [F.col(order).cast("string").alias("id")], Newest(n), "shard string, version long, t long, id string")


def newest_of(versions: DataFrame, n: int = 500) -> DataFrame:
    """t and id of the n newest rows in the last version of each shard."""
    last = versions.groupBy("shard").agg(F.max("version").alias("version"))
    return versions.join(last, ["shard", "version"]).select("t", "id").orderBy(F.desc("t"), F.desc("id")).limit(n)
