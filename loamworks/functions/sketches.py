"""Mergeable sketches as tables: quantiles by buckets of bounded relative error, distinct counts by least digests.

A sketch is made of rows, a bounded number for each group, so it is stored as a table and merged by a union and the
same aggregation again; partial aggregation keeps what is shuffled to that bound for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value that tell its bucket: a bucket's ends differ by less than one part in 2 ** (BITS - 1).
BITS = 6
#: Least digests that a distinct count keeps; its relative standard error is about 1 / sqrt(LEAST).
LEAST = 256
#: Digests are 60 bits.
RANGE = float(1 << 60)


def bucket(value: Column) -> Column:
    """The least whole number with the same BITS leading bits and length as value, a whole number from 0."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    kept = F.call_function("shiftright", value, shift)
    return F.call_function("shiftleft", kept, shift)


def quantile_sketch(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, bucket and n: how many whole values from 0 each bucket has; nulls are left out, negative ones count as 0."""
    whole = F.greatest(value.cast("long"), F.lit(0))
    return df.where(value.isNotNull()).groupBy(*by, bucket(whole).alias("bucket")).agg(F.count("*").alias("n"))


def merged_quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """A sketch of coarser groups from stored ones."""
    return sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """by, share and value: the bucket of the value at rank ceil(share n); the value itself is at most one part in 32 larger."""
    line = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = sketch.withColumn("upto", F.sum("n").over(line)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    each = run.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    met = each.where(F.col("upto") >= F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1)))
    return met.groupBy(*by, "share").agg(F.min("bucket").alias("value"))


def distinct_sketch(df: DataFrame, by: list[str], value: str, least: int = LEAST) -> DataFrame:
    """by and digest: the least digests of distinct values of each group; nulls are left out."""
    digest = F.conv(F.substring(F.md5(F.col(value).cast("string")), 1, 15), 16, 10).cast("long")
    return merged_distinct(df.where(F.col(value).isNotNull()).select(*by, digest.alias("digest")), by, least)


def merged_distinct(sketch: DataFrame, by: list[str], least: int = LEAST) -> DataFrame:
    """A sketch of coarser groups from stored ones."""
    once = sketch.select(*by, "digest").distinct()
    order = Window.partitionBy(*by).orderBy("digest")
    return once.withColumn("__lw_rank", F.row_number().over(order)).where(F.col("__lw_rank") <= least).drop("__lw_rank")


def distinct_counts(sketch: DataFrame, by: list[str], least: int = LEAST) -> DataFrame:
    """by and kinds: the count itself below least digests, else the estimate by the largest of them."""
    sums = sketch.groupBy(*by).agg(F.count("*").alias("n"), F.max("digest").alias("last"))
    return sums.select(*by, F.when(F.col("n") < least, F.col("n").cast("double")).otherwise(F.round((least - 1) / (F.col("last") / RANGE), 2)).alias("kinds"))
