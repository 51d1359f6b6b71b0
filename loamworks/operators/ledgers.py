"""Ledgers over tables: numbered purchases, access by token, job progress, alerts. Twins of the streams in streaming.timed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.session import Workspace

#: What happens first at one time: a purchase, then a withdrawal, then a call.
RANK = {"purchase": 0, "revoke": 1, "call": 2}
#: Stages that end a job, and seconds after which one without them has failed.
LAST = ("done", "failed")
TIMEOUT_S = 600


def numbered(rows: DataFrame, by: str, order: list[str], name: str = "number") -> DataFrame:
    """rows with their number from 1 within by, in order (W-04).

    Rows are dealt by range of (by, order) and written, so a group with most of all rows lies in many partitions.
    Numbers count within a partition, on from the group's rows before it; a border between partitions cuts one
    group at most, so the counts that are sent to all tasks are twice the partitions. Nulls come first; ties have any order.
    """
    work = Workspace(rows.sparkSession, "numbered")
    dealt = work.table(rows.repartitionByRange(by, *order).withColumn("__lw_part", F.spark_partition_id()), "dealt")
    key = F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    dealt = dealt.withColumn("__lw_by", key)
    before = Window.partitionBy("__lw_by").orderBy("__lw_part").rowsBetween(Window.unboundedPreceding, -1)
    cut = dealt.groupBy("__lw_by", "__lw_part").count().withColumn("__lw_before", F.sum("count").over(before))
    cut = cut.where("__lw_before IS NOT NULL").drop("count")
    within = Window.partitionBy("__lw_by", "__lw_part").orderBy(*order)
    out = dealt.withColumn("__lw_own", F.row_number().over(within)).join(F.broadcast(cut), ["__lw_by", "__lw_part"], "left")
    number = F.col("__lw_own") + F.coalesce("__lw_before", F.lit(0))
    return out.select(*rows.columns, number.cast("long").alias(name))


def access_calls(log: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """Each call of a log with granted, and used: the calls that its token had granted up to then (J-14, W-10, ST-08).

    log has kind (purchase, revoke or call), quota and ttl (seconds) for purchases. The latest purchase gives the
    token; a call is granted while the token is not revoked nor expired and has quota left. Rows of one time go by
    RANK, then order. Without a token nothing is granted.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in RANK.items()])
    at = (F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    line = Window.partitionBy(*by).orderBy(time, rank, order).rowsBetween(Window.unboundedPreceding, 0)
    bought = F.col("kind") == "purchase"
    rows = log.withColumn("__lw_token", F.count(F.when(bought, 1)).over(line))
    token = Window.partitionBy(*by, "__lw_token").orderBy(time, rank, order).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.max(F.when(bought, c)).over(token)
    rows = rows.withColumns({"__lw_quota": first(F.coalesce("quota", F.lit(0))), "__lw_ends": first(at + F.coalesce("ttl", F.lit(0.0))), "__lw_off": F.max(F.when(F.col("kind") == "revoke", 1).otherwise(0)).over(token)})
    good = (F.col("kind") == "call") & F.coalesce((at < F.col("__lw_ends")) & (F.col("__lw_off") == 0), F.lit(False))
    rows = rows.withColumn("__lw_good", good).withColumn("__lw_turn", F.sum(F.col("__lw_good").cast("int")).over(token))
    granted = F.col("__lw_good") & (F.col("__lw_turn") <= F.col("__lw_quota"))
    used = F.coalesce(F.least("__lw_turn", "__lw_quota"), F.lit(0))
    return rows.where("kind = 'call'").select(*by, order, granted.alias("granted"), used.cast("long").alias("used"))


def job_progress(updates: DataFrame, job: str, time: str, order: str, timeout_s: float = TIMEOUT_S, until: Column | None = None) -> DataFrame:
    """A job's updates up to its first terminal stage, or up to timeout_s after its first update and then a row of its failure (ST-04).

    Columns: job, at (seconds), stage, error. until: the time that has passed; jobs whose timeout lies behind it are still open.
    """
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    line = Window.partitionBy(job).orderBy(time, order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    final = F.col("stage").isin(*LAST)
    rows = updates.withColumn("at", at).withColumn("__lw_start", F.min("at").over(Window.partitionBy(job)))
    rows = rows.where(F.col("at") <= F.col("__lw_start") + timeout_s).withColumn("__lw_over", F.coalesce(F.max(F.when(final, 1)).over(before), F.lit(0)))
    shown = rows.where("__lw_over = 0")
    ends = shown.groupBy(job).agg((F.min("__lw_start") + timeout_s).alias("at"), F.max(final.cast("int")).alias("__lw_final")).where("__lw_final = 0")
    ends = ends if until is None else ends.where(F.col("at") < until)
    late = ends.select(job, "at", F.lit("failed").alias("stage"), F.lit("timeout").alias("error"))
    return shown.select(job, "at", "stage", F.lit(None).cast("string").alias("error")).unionByName(late)


def retained(rows: DataFrame, newest: list[str], n: int) -> DataFrame:
    """The n rows that come last in order (ST-09); each task keeps n at most."""
    return rows.orderBy(*[F.col(c).desc() for c in newest]).limit(n)


def fired(alerts: DataFrame, job: str, stage: str, severity: str, message: str, at: str) -> DataFrame:
    """alerts with one more row, unresolved, under an id made of its fields (MO-05)."""
    row = alerts.sparkSession.range(1).select(
        F.lit(severity).alias("severity"), F.lit(job).alias("job"), F.lit(stage).alias("stage"), F.lit(message).alias("message"), F.lit(at).cast("timestamp").alias("at"), F.lit(False).alias("resolved")
    )
    return alerts.unionByName(row.withColumn("alert_id", alert_id(row)))


def alert_id(rows: DataFrame) -> Column:
    return F.md5(F.concat_ws("|", *[rows[c] for c in ("severity", "job", "stage", "message")], F.unix_micros(rows["at"]).cast("string")))


def resolved(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """alerts, those with an id of ids resolved (MO-02)."""
    known = ids.select("alert_id").distinct().withColumn("__lw_now", F.lit(True))
    return alerts.join(known, "alert_id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("__lw_now", F.lit(False))).drop("__lw_now")


def shown_alerts(alerts: DataFrame, include_resolved: bool = False, limit: int = 100) -> DataFrame:
    """The newest alerts, those that are resolved only if asked for (MO-02)."""
    return retained(alerts if include_resolved else alerts.where(~F.col("resolved")), ["at", "alert_id"], limit)


def administered(rows: DataFrame, contract: str, time: str, order: str, first: int) -> DataFrame:
    """Each event of a contract with ok and the state after it: admin, pending and paused (P-15).

    rows have kind, actor and target. Only the admin transfers, pauses and unpauses; a transfer names who may accept,
    and only who was named last becomes the admin by accepting. Other kinds are ok and change nothing; a transfer
    without a target is refused. A contract's events stream through one task in order, in memory for one state.
    """
    lean = rows.select(F.col(order).cast("long").alias("id"), F.col(contract).cast("long").alias("contract"), "kind", F.col("actor").cast("long").alias("actor"), F.col("target").cast("long").alias("target"), F.col(time).alias("at"))
    lean = lean.repartition("contract").sortWithinPartitions("contract", "at", "id").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, admin, pending, paused = object(), first, None, False
        for batch in batches:
            out = []
            for key, kind, actor, target in zip(*(batch.column(c).to_pylist() for c in ("contract", "kind", "actor", "target")), strict=True):
                if key != now:
                    now, admin, pending, paused = key, first, None, False
                ok = actor is not None and (actor == admin if kind in ("transfer", "pause", "unpause") else actor == pending) if kind in ("transfer", "pause", "unpause", "accept") else True
                ok = ok and not (kind == "transfer" and target is None)
                if ok and kind == "transfer":
                    pending = target
                elif ok and kind == "accept":
                    admin, pending = pending, None
                elif ok and kind in ("pause", "unpause"):
                    paused = kind == "pause"
                out.append((ok, admin, pending, paused))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("contract"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "contract", "ok", "admin", "pending", "paused"])

    out = lean.mapInArrow(run, "id long, contract long, ok boolean, admin long, pending long, paused boolean")
    return out.withColumnsRenamed({"id": order, "contract": contract})
