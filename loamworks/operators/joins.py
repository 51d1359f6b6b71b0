"""Similarity and time joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.operators import blocks, similar
from loamworks.session import Workspace

#: Queries whose neighbours a task keeps at a time, and rows of similarities that it has in memory.
HELD, STRIP = 1 << 17, 128


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], allow_equal: bool = True) -> DataFrame:
    """Each left row with the values of the latest right row at or before its time; null where there is none (J-13, J-14).

    Both sides are put in one order, so no pair is made. Right rows come before left ones of the same time if
    allow_equal; of several right rows at a time the last by their values counts.
    """
    found = F.struct(*values)
    kind = right.select(found.alias("x")).schema["x"].dataType
    names = [c for c in left.columns if c not in (*by, time)]
    row = F.struct(*names)
    lrow = left.select(row.alias("x")).schema["x"].dataType
    a = left.select(*by, F.col(time).alias("__t"), F.lit(1 if allow_equal else 0).alias("__side"), row.alias("__row"), F.lit(None).cast(kind).alias("__found"), F.lit(True).alias("__left"))
    b = right.select(*by, F.col(time).alias("__t"), F.lit(0 if allow_equal else 1).alias("__side"), F.lit(None).cast(lrow).alias("__row"), found.alias("__found"), F.lit(False).alias("__left"))
    order = Window.partitionBy(*by).orderBy("__t", "__side", "__found").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__found", ignorenulls=True).over(order))
    return both.where("__left").select(*by, F.col("__t").alias(time), "__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def token_access(calls: DataFrame, tokens: DataFrame, by: list[str], time: str, quota: int, valid: Column) -> DataFrame:
    """Calls with granted: the latest token at the time, its first quota valid calls (J-14, W-10).

    tokens have time and granted_at, expires_at and revoked; valid tests them.
    """
    joined = asof_join(calls, tokens, by, time, ["granted_at", "expires_at", "revoked"])
    good = F.coalesce(valid, F.lit(False))
    turn = F.sum(good.cast("int")).over(Window.partitionBy(*by, "granted_at").orderBy(time, *[c for c in calls.columns if c not in (*by, time)]).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("granted", good & (turn <= quota))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs in which at lies in [start, end), by way of time bins of a width near the intervals' lengths."""
    bin_ = lambda c: F.floor(F.unix_timestamp(c) / width)
    a = left.withColumn("__bin", bin_(at))
    b = right.withColumn("__bin", F.explode(F.sequence(bin_(start), bin_(end))))
    return a.join(b, [*by, "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query its k nearest corpus rows, itself excluded: query, near (distance, id), and n, mean, spread of all similarities (J-08, O-04).

    queries may be all rows of the corpus. Blocks of both meet in the executors (blocks.met); a task keeps k and three
    sums for each query that it sees, and nothing comes to the driver. Vectors that are null or not finite are left
    out, those of another length than the query's never meet it. Distances count to twelve places; ties go to the smaller id.
    """
    work = Workspace(corpus.sparkSession, "near")
    asked = blocks.packed(queries, key, vector, blocks.ASKED, work, "queries")
    held = blocks.packed(corpus, key, vector, blocks.BLOCK, work, "corpus")
    pairs = blocks.met(asked, held).select("dim", "q_at", "q_ids", "q_data", "ids", "data")
    parts = work.table(pairs.mapInArrow(_nearest(k), "query long, near array<struct<distance:double,id:long>>, n long, s1 double, s2 double"), "parts")
    order = Window.partitionBy("query").orderBy("x.distance", "x.id")
    best = parts.select("query", F.explode("near").alias("x")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list("x")).alias("near"))
    sums = parts.groupBy("query").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean = F.col("s1") / F.col("n")
    return sums.join(best, "query").select("query", "near", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))).alias("spread"))


class _Near:
    """The k nearest of each query of a block so far, as rows in order of (query, distance, id), and sums of similarities."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n, self.s1, self.s2 = ids, np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        self.rows = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def see(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> None:
        """The queries' vectors and a block of corpus rows.

        Sums come from the block's own sums. Similarities are made in single precision, whose error is bounded; only where a
        row may be among the k nearest so far, or a query hasn't k of them yet, are they made in double.
        """
        order = np.argsort(ids, kind="stable")
        first, last = np.searchsorted(ids[order], self.ids), np.searchsorted(ids[order], self.ids, "right")
        mine = np.repeat(np.arange(len(q)), last - first)  # pairs of a query with itself
        same = order[np.arange(len(mine)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)]
        own = np.einsum("ij,ij->i", q[mine], c[same])
        self.n += len(ids) - (last - first)
        self.s1 += q @ c.sum(axis=0) - np.bincount(mine, own, len(q))
        self.s2 += np.einsum("ij,ij->i", q @ (c.T @ c), q) - np.bincount(mine, own**2, len(q))
        held = np.searchsorted(self.rows[0], np.arange(len(q) + 1))
        edge = np.full(len(q), np.inf)
        full = held[1:] - held[:-1] == k
        edge[full] = self.rows[1][held[1:][full] - 1]
        q32, c32, slack = q.astype(np.float32), c.astype(np.float32).T, 1.2e-7 * (c.shape[1] + 4)
        found, few = [], k + int((last - first).max())
        for at in range(0, len(q), STRIP):
            to = min(at + STRIP, len(q))
            sims = q32[at:to] @ c32
            least = 1 - edge[at:to] - 1e-12
            if not full[at:to].all() and sims.shape[1] > few:  # the best ones of this block, of which some may be the query
                least = np.maximum(least, np.partition(sims, -few, axis=1)[:, -few] - slack)
            i, j = np.nonzero(sims >= (least - slack).astype(np.float32)[:, None])
            found.append((i + at, j))
        i, j = (np.concatenate(p) for p in zip(*found, strict=True))
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        away = np.concatenate([np.round(1 - np.einsum("ij,ij->i", q[i[x : x + HELD]], c[j[x : x + HELD]]), 12) for x in range(0, len(i), HELD)] or [np.zeros(0)])
        near = away <= edge[i]
        if near.any():
            i, d, x = (np.concatenate((old, new)) for old, new in zip(self.rows, (i[near], away[near], ids[j[near]]), strict=True))
            order = np.lexsort((x, d, i))
            i, d, x = i[order], d[order], x[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            self.rows = i[best], d[best], x[best]

    def batch(self) -> pa.RecordBatch:
        i, d, x = self.rows
        ends = np.searchsorted(i, np.arange(len(self.ids) + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d), pa.array(x)], ["distance", "id"]))
        return pa.RecordBatch.from_pydict({"query": pa.array(self.ids), "near": near, "n": pa.array(self.n), "s1": pa.array(self.s1), "s2": pa.array(self.s2)})


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, _Near] = {}
        for at, q_ids, q, ids, c in blocks.matrices(batches):
            if at not in best and sum(len(some.ids) for some in best.values()) >= HELD:
                for some in best.values():
                    yield some.batch()
                best.clear()
            if at not in best:
                best[at] = _Near(q_ids)
            best[at].see(q, c, ids, k)
        for some in best.values():
            yield some.batch()

    return run


def hamming_first(df: DataFrame, key: str, bits: Column, group: list[str], most: int = 5) -> DataFrame:
    """Rows with the smallest earlier key of the same group whose 64 bits differ in most places at most, or null (J-10).

    Equal bits fall together first. Of 8 bands of 8 bits, 8 - most are equal in any pair that counts, so pairs meet
    on each choice of that many bands. Both sides are shuffled, nothing goes through the driver.
    """
    base = df.select(key, *group, bits.alias("bits")).where(F.col("bits").isNotNull())
    kinds = base.groupBy(*group, "bits").agg(F.min(key).alias("first"))
    band = lambda i: F.shiftrightunsigned("bits", 8 * i).bitwiseAND(F.lit(255))
    turns = enumerate(combinations(range(8), 8 - most))
    keys = F.array(*[F.xxhash64(F.lit(turn), *map(band, some)) for turn, some in turns])
    # A row has many keys, which the optimizer's estimate of a size leaves out: without the hints it sends all of them through the driver.
    banded = kinds.withColumn("band", F.explode(keys))
    other = banded.select(*group, "band", F.col("bits").alias("other"), F.col("first").alias("earlier"))
    near = banded.join(other.hint("merge"), [*group, "band"]).where((F.col("bits") != F.col("other")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= most))
    least = near.groupBy(*group, "bits").agg(F.min("earlier").alias("near"))
    found = kinds.join(least.hint("merge"), [*group, "bits"], "left").select(*group, "bits", "first", "near")
    out = base.join(found.hint("merge"), [*group, "bits"])
    same = F.when(F.col("first") < F.col(key), F.col("first"))
    close = F.when(F.col("near") < F.col(key), F.col("near"))
    return out.select(key, *group, F.least(same, close).alias("earlier"))


def equal_sets(sets: DataFrame, key: str, values: str) -> DataFrame:
    """id and first of each row: the smallest key of the rows with the same distinct values; an empty array is alone."""
    digest = F.when(F.size(values) > 0, F.sha2(F.array_join(F.transform(F.array_sort(values), lambda v: v.cast("string")), "\0"), 256))
    each = Workspace(sets.sparkSession, "equal").table(sets.select(F.col(key).alias("id"), digest.alias("print")), "prints")
    firsts = each.where("print IS NOT NULL").groupBy("print").agg(F.min("id").alias("first"))
    return each.join(firsts, "print", "left").select("id", F.coalesce("first", "id").alias("first"))


def jaccard_classes(sets: DataFrame, key: str, values: str, least: float, text: str | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of jaccard_join between the first rows of different texts, and of each first row with its copies (U-03).

    Copies are rows of equal texts (null ones too), or of equal sets if no text is given; a group of c copies has c - 1
    pairs. Equal sets are compared once, and each pair of them stands for all pairs of their different texts.
    """
    work = Workspace(sets.sparkSession, "classes")
    classes = work.table(equal_sets(sets, key, values), "classes")
    firsts = sets.join(classes.where("first = id").select(F.col("id").alias(key)), key, "left_semi")
    pairs = jaccard_join(sets, key, values, least, classes.where("first = id").select(F.col("id").cast("long").alias("id")))
    if text is None:
        copies = classes
    else:
        prints = sets.select(F.col(key).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("print"))
        prints = work.table(prints, "prints")
        least_ids = prints.groupBy("print").agg(F.min("id").alias("first"))
        copies = work.table(prints.join(least_ids, prints["print"].eqNullSafe(least_ids["print"])).select("id", "first"), "copies")
        own = work.table(classes.join(copies.where("first = id").select("id"), "id", "left_semi").select(F.col("first").alias("of"), "id"), "texts")
        one, two = own.select(F.col("of").alias("a"), F.col("id").alias("x")), own.select(F.col("of").alias("b"), F.col("id").alias("y"))
        between = pairs.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
        within = one.join(two, F.col("a") == F.col("b")).where("x < y").join(firsts.where(F.size(values) > 0).select(F.col(key).alias("a")), "a", "left_semi")
        pairs = between.unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity")))
    return pairs.unionByName(copies.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def jaccard_join(sets: DataFrame, key: str, values: str, least: float, only: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of rows whose arrays of distinct values have a Jaccard similarity of least or more (U-03).

    Exact: sizes and sketches rule out pairs before arrays are fetched and compared (similar.pairs). Keys are
    integers and unique. Empty arrays pair with nothing. If only (id) is given, just its rows count; no set is moved to find them.
    """
    base = sets.select(F.col(key).cast("long").alias("id"), F.col(values).alias("set")).where(F.size(values) > 0)
    return similar.pairs(base, least, Workspace(sets.sparkSession, "jaccard"), only)
