"""Reads, reports and running sums over asset, package, sale and ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, time: str, key: str, n: int, where: Column | None = None) -> DataFrame:
    """The newest n rows, ties by key (P-01, O-02, O-08)."""
    return (df if where is None else df.where(where)).orderBy(F.desc(time), F.asc(key)).limit(n)


def top(df: DataFrame, value: str, key: str, n: int, where: Column | None = None) -> DataFrame:
    """The n rows with the largest value, ties by key (O-01, O-03)."""
    return (df if where is None else df.where(where)).orderBy(F.desc(value), F.asc(key)).limit(n)


def search(df: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns contains a word, case ignored (P-02)."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False))
    return df.where(found)


def market(df: DataFrame, keyword: str | None = None, columns: tuple[str, ...] = (), equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Conjunction of the predicates that are given (P-04, P-13)."""
    out = search(df, keyword, list(columns)) if keyword else df
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    for c, v in (at_least or {}).items():
        out = out.where(F.col(c) >= v)
    for c, v in (at_most or {}).items():
        out = out.where(F.col(c) <= v)
    return out


def page(df: DataFrame, sort: str, key: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """One page in a chosen order, with the number of all rows (P-05)."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.desc(sort) if descending else F.asc(sort), F.asc(key)).offset(offset).limit(limit)
    return rows.join(F.broadcast(total))


def ellipsis(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis where more follow (P-11)."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def price_check(price: Column, listed: Column) -> Column:
    """Why a price is refused, or null (P-12)."""
    return F.when(price.isNull() | F.isnan(price), "not a number").when(price <= 0, "not positive").when(price > 1_000_000, "too large").when(price > 2 * listed, "above twice the list price")


def tier(score: Column, bounds: tuple[float, float, float] = (9.0, 7.0, 5.0)) -> Column:
    """platinum, gold, silver or rejected; the market's own bounds start at 8.5 (AN-05)."""
    return F.when(score >= bounds[0], "platinum").when(score >= bounds[1], "gold").when(score >= bounds[2], "silver").otherwise("rejected")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, which falls in the last; empty bins are left out (A-20)."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("lo")) / F.when(step > 0, step)), F.lit(bins - 1))).otherwise(0).cast("int")
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, group: str, digits: int = 6) -> DataFrame:
    """Rows of each group and their share of all (A-22, W-11)."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def share_of_sum(df: DataFrame, group: str, value: Column, digits: int = 6) -> DataFrame:
    """Sums by group and their share of all; no rows if all is 0 (A-08)."""
    sums = df.groupBy(group).agg(F.sum(value).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy())
    return sums.withColumn("total", total).where(F.col("total") > 0).select(group, F.round("amount", digits).alias("amount"), F.round(F.col("amount") / F.col("total"), digits).alias("ratio"))


def running_balance(ledger: DataFrame, owner: str, time: str, key: str, signed: Column) -> DataFrame:
    """The balance after each entry (W-03)."""
    return ledger.withColumn("balance_after", F.sum(signed).over(Window.partitionBy(owner).orderBy(time, key).rowsBetween(Window.unboundedPreceding, 0)))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order: upserts, and first occurrences (SNK-05, SNK-06, W-06)."""
    return df.withColumn("__lw_turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__lw_turn") == 1).drop("__lw_turn")


def first_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in an order (W-05, W-07)."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("turn") <= n)


def settle(balances: DataFrame, least: float = 10.0) -> DataFrame:
    """Pending amounts from least on move to paid (A-14)."""
    due = F.col("pending") >= least
    return balances.select("*", F.when(due, F.col("pending")).otherwise(0).alias("settled"), F.when(due, 0).otherwise(F.col("pending")).alias("pending_after"))


def snapshots(versions: DataFrame, name: str, time: str, measures: list[str]) -> DataFrame:
    """Version numbers and changes from the version before (W-01, W-02, VS-01, J-13)."""
    order = Window.partitionBy(name).orderBy(time)
    out = versions.withColumn("version", F.concat(F.lit("1.0."), (F.row_number().over(order) - 1).cast("string"))).withColumn("previous", F.lag(time).over(order))
    for m in measures:
        out = out.withColumn(f"delta_{m}", F.round(F.col(m) - F.coalesce(F.lag(m).over(order), F.lit(0)), 4))
    return out


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target with the rows whose key it lacks; of equal new keys one (SNK-04, SNK-10)."""
    fresh = rows.join(target.select(F.col(key).alias("__lw_key")), F.col(key) == F.col("__lw_key"), "left_anti").dropDuplicates([key])
    return target.unionByName(fresh)


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target with rows replaced or added by key (SNK-05)."""
    both = target.withColumn("__lw_new", F.lit(0)).unionByName(rows.withColumn("__lw_new", F.lit(1)))
    return latest(both, key, F.desc("__lw_new")).drop("__lw_new")


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that meet a condition with new values (SNK-07, P-09, P-10, P-15, MO-02)."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def without(df: DataFrame, where: Column) -> DataFrame:
    """Rows that don't meet a condition (SNK-08)."""
    return df.where(~F.coalesce(where, F.lit(False)))


def job_rollup(stages: DataFrame, job: str = "job") -> DataFrame:
    """Sums, mean positive score and pass rate of each job (A-17, A-18).

    Scores and seconds are added as whole units of 0.0001 and divided once, halves up, so no order of rows matters.
    """
    units = lambda c: F.round(F.col(c) * 10_000).cast("long")
    good = F.col("score") > 0
    sums = stages.groupBy(job).agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), F.sum(F.when(good, units("score"))).alias("_score"), F.count(F.when(good, 1)).alias("_n"), F.sum(units("seconds")).alias("_seconds")
    )
    mean = F.when(F.col("_n") > 0, F.floor((2 * F.col("_score") + F.col("_n")) / F.when(F.col("_n") > 0, 2 * F.col("_n"))) / 10_000)
    sums = sums.select(job, "rows_in", "rows_out", mean.alias("avg_score"), (F.floor((F.col("_seconds") + 50) / 100) / 100).alias("seconds"))
    return sums.withColumn("pass_rate", F.round(F.coalesce(F.try_divide(F.col("rows_out"), F.col("rows_in")), F.lit(0.0)), 4))


def stage_alerts(stages: DataFrame, seconds: float = 300, score: float = 3, failed: float = 40, passed: float = 30) -> DataFrame:
    """None to four alerts for each row, all bounds strict (MO-01)."""
    c = F.col
    rules = F.array(
        F.when(c("seconds") > seconds, "slow"),
        F.when((c("score") > 0) & (c("score") < score), "low_score"),
        F.when(c("failed_pct") > failed, "failures"),
        F.when((c("stage") == "scoring") & (c("pass_pct") < passed), "low_pass"),
    )
    return stages.withColumn("alert", F.explode(F.array_compact(rules)))


def exposition(metrics: DataFrame, name: str = "metric", value: str = "value", help: str = "help") -> DataFrame:
    """Metrics as lines of the text exposition format (SNK-09)."""
    n = F.col(name)
    return metrics.select(F.concat(F.lit("# HELP "), n, F.lit(" "), F.col(help), F.lit("\n# TYPE "), n, F.lit(" gauge\n"), n, F.lit(" "), F.col(value).cast("string")).alias("line"))


def ledger_entries(records: DataFrame) -> DataFrame:
    """Revenue records (record_id, creator_id, creator_share, package_id, created_at) as entries of an account (P-18)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    note = F.concat(F.lit("package "), F.substring(text("package_id"), 1, 8), F.lit("…"))
    return records.select(
        text("record_id").alias("entry_id"), text("creator_id").alias("creator_id"), F.coalesce("creator_share", F.lit(0.0)).alias("amount"), F.lit(0.0).alias("balance_after"),
        F.lit("credit").alias("entry_type"), text("package_id").alias("reference_id"), note.alias("note"), "created_at",
    )


def next_version(version: Column) -> Column:
    """The version with its last number up by one; 1.0.0 without one or where it isn't a number (W-02)."""
    numbered = version.rlike(r"^(?:[^.]*\.)*[0-9]{1,18}$")
    tail = F.regexp_extract(version, r"([0-9]+)$", 1)
    return F.when(numbered, F.concat(F.regexp_extract(version, r"^(.*?)[0-9]+$", 1), (tail.cast("long") + 1).cast("string"))).otherwise("1.0.0")


def latest_state(log: DataFrame, key: str, time: str, entry: str, values: list[str], pauses: Column) -> DataFrame:
    """The latest values of each key in an event log, entries inside a pause left out (P-15).

    pauses: true for entries that the pause guard refuses. Ties in time go to the larger entry id.
    """
    order = F.struct(time, entry)
    kept = log.where(~F.coalesce(pauses, F.lit(False)))
    return kept.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.count("*").alias("changes"))


def open_jobs(jobs: DataFrame, alerts: DataFrame, job: str, resolved: str) -> DataFrame:
    """Jobs with has_alert: whether an alert of theirs is unresolved (J-07)."""
    waiting = alerts.where(~F.coalesce(F.col(resolved), F.lit(False))).select(F.col(job).alias("__lw_job")).distinct().withColumn("__lw_has", F.lit(True))
    return jobs.join(waiting, F.col(job) == F.col("__lw_job"), "left").withColumn("has_alert", F.coalesce("__lw_has", F.lit(False))).drop("__lw_job", "__lw_has")


def hash_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """About a share of the rows, chosen by their keys' digests: the same ones on every run and partitioning."""
    edge = f"{int(share * 16**6):06x}"
    return df.where(F.substring(F.md5(F.col(key).cast("string")), 1, 6) < edge)
