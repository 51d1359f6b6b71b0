"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.session import Workspace

# Source weights in turn, the share of all sizes to take, and how often a document may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
WORD = r"[^ \t-\r]+"


def size_of(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source its weight and target, from source and source_size; one small row for each source.

    Targets share the budget by weight and stop at epochs times the source's size; the excess goes to the others.
    Sources that stop are those with the smallest size per weight, so with running sums in that order the
    level of the rest comes out directly.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    each = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    each = each.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * share
    level = (budget - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    each = each.withColumn("own", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("own"))
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("own").alias("level")))).over(everything)["level"]
    return each.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight"))).select("source", "source_size", "weight", "target")


def with_small(rows: DataFrame, table: DataFrame, key: str, bound: int = 20_000) -> DataFrame:
    """Rows joined with a table of one row for each value of key, nulls matching; broadcast only up to bound rows."""
    small = table.withColumnRenamed(key, "__lw_key")
    if table.limit(bound + 1).count() <= bound:
        small = F.broadcast(small)
    return rows.join(small, F.col(key).eqNullSafe(F.col("__lw_key"))).drop("__lw_key")


def _slice(unit: Column, rows: Column) -> Column:
    """One of about sqrt(rows) slices for a number from 0; that many sums, and that many rows in each."""
    return F.floor(unit * F.ceil(F.sqrt(rows)))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "0", **options) -> DataFrame:
    """All rows of docs with __lw_size, __lw_order, __lw_words and __lw_target (of the source) and __lw_copies (how often the mix takes the row).

    Each source's documents come in an order shuffled by digest of the key, whole passes one after another. A
    copy's virtual finish time is the source's words so far, itself included, over the target; copies are taken by
    that time while their words fit the budget. Running sums go over slices of a source's order, then of virtual
    time: sums of slices first, then the rows of a slice, so a source with a third of all rows is dealt out too.
    What is taken of a source in a pass is a prefix of its order, so texts are never shuffled: each row is
    compared with its source's last taken place. Null texts and empty ones have size 0; ties go by source, pass,
    digest and size; repeated rows count each; no rows give no rows.
    """
    work = Workspace(docs.sparkSession, "mix")
    share, epochs = options.get("share", SHARE), options.get("epochs", EPOCHS)
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = docs.withColumn("__lw_size", size_of(F.col(text))).withColumn("__lw_order", digest)
    lean = work.table(sized.select("source", "__lw_order", "__lw_size"), "lean")
    sources = work.table(lean.groupBy("source").agg(F.sum("__lw_size").alias("source_size"), F.count("*").alias("_rows")), "sources")
    rows = sources.select(F.col("source").alias("_s"), "_rows")
    aims = targets(sources, **options).join(rows, F.col("source").eqNullSafe(F.col("_s"))).select("source", "_rows", "source_size", "target")
    aims = work.table(aims, "targets")

    unit = F.conv(F.substring("__lw_order", 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = with_small(lean, aims, "source").withColumn("_slice", _slice(unit, F.col("_rows")))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "_slice").agg(F.sum("__lw_size").alias("_sum"))
    sums = sums.select(F.col("source").alias("_s"), F.col("_slice").alias("_t"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("source", "_slice").orderBy("__lw_order", "__lw_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_own", F.sum("__lw_size").over(within)).join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_t")))
    copies = placed.select("source", "__lw_order", "__lw_size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("_pass"), (F.col("_before") + F.col("_own")).alias("_cum"), "source_size", "target")
    copies = work.table(copies.withColumn("_time", F.coalesce(F.try_divide(F.col("_pass") * F.col("source_size") + F.col("_cum"), F.col("target")), F.lit(0.0))), "copies")

    whole = aims.agg(F.sum("_rows").alias("rows"), F.sum("source_size").alias("words")).first()
    budget = (whole["words"] or 0) * share
    steps = copies.withColumn("_step", _slice(F.col("_time"), F.lit(float(whole["rows"] or 1))))
    running = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    levels = steps.groupBy("_step").agg(F.sum("__lw_size").alias("_sum")).withColumn("_upto", F.sum("_sum").over(running))
    cut = levels.where(F.col("_upto") > budget).orderBy("_step").first()
    if cut is None:
        taken = steps
    else:
        line = Window.orderBy("_time", F.col("source").asc_nulls_last(), "_pass", "__lw_order", "__lw_size").rowsBetween(Window.unboundedPreceding, 0)
        last = steps.where(F.col("_step") == cut["_step"]).withColumn("_upto", F.sum("__lw_size").over(line) + (cut["_upto"] - cut["_sum"]))
        taken = steps.where(F.col("_step") < cut["_step"]).unionByName(last.where(F.col("_upto") <= budget).drop("_upto"))
    ends = taken.groupBy("source", "_pass").agg(F.max(F.struct("__lw_order", "__lw_size")).alias("_end"))
    ends = ends.groupBy("source").agg(F.collect_list("_end").alias("__lw_ends")).withColumnRenamed("source", "_s")
    places = aims.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.col("source_size").alias("__lw_words"), F.col("target").alias("__lw_target"), "__lw_ends")
    places = work.table(places, "places")
    out = with_small(sized, places, "source")
    reached = F.filter(F.coalesce("__lw_ends", F.array()), lambda e: F.struct("__lw_order", "__lw_size") <= e)
    return out.withColumn("__lw_copies", F.size(reached)).drop("__lw_ends")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: a row for each copy taken, with mix_pass 0 for the first; columns of docs besides."""
    taken = schedule(docs, **options).where(F.col("__lw_copies") > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("__lw_copies") - 1)).alias("mix_pass"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it."""
    size = F.col("__lw_size")
    return schedule(docs).select("doc_id", size.alias("size"), F.col("__lw_words").alias("source_size"), F.col("__lw_target").alias("target"), (size * F.col("__lw_copies")).alias("taken"))
