"""Exact search for the largest inner products, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.session import Workspace

#: Components in a segment, coarse to fine.
SEGMENTS = (16, 4)
#: Components in a block of vectors, of queries, and bytes of query blocks that are sent to all tasks at once.
BLOCK = 1 << 17
ASKED = 1 << 16
SENT = 64 << 20
#: Each round sees so many times the vectors of the rounds before, under the bounds that they have given.
GROWTH = 16
#: Below this share of pairs left, products are computed pair by pair.
SPARSE = 0.05
#: Sums of products up to here are exact in floating point; larger ones are made of Python's integers.
EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1

BLOCKS = "at string, dim int, ids array<long>, rows array<string>, data binary, stats binary, peak double"
FOUND = "row string, query_id long, score long, vec_id long, found string"


def quantised(vector: Column) -> Column:
    """256 x of each component as a double, exactly; null where the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: x.cast("double") * 256.0))


def statistics(data: np.ndarray) -> np.ndarray:
    """Per vector and level its segments' means and deviations, each times the root of the segment's length.

    A product of two such rows bounds the vectors' inner product from above on that level: within a segment of
    length m it is m (mean mean' + deviation deviation') at most, which is the bound on the distance of the two
    that means and deviations give.
    """
    levels = []
    for length in SEGMENTS:
        starts = np.arange(0, data.shape[1], length)
        sizes = np.minimum(length, data.shape[1] - starts).astype(float)
        means = np.add.reduceat(data, starts, axis=1) / sizes
        rest = data - np.repeat(means, sizes.astype(int), axis=1)
        deviations = np.sqrt(np.add.reduceat(rest * rest, starts, axis=1) / sizes)
        levels += [means * np.sqrt(sizes), deviations * np.sqrt(sizes)]
    return np.hstack(levels) if data.shape[1] else np.zeros((len(data), 0))


def _levels(dim: int) -> list[slice]:
    """Columns of each level in statistics()."""
    out, at = [], 0
    for length in SEGMENTS:
        n = 2 * -(-dim // length)
        out.append(slice(at, at + n))
        at += n
    return out


def _wide(peak: float, other: float, dim: int) -> bool:
    """Whether inner products of vectors with such largest components may be inexact in floating point."""
    return not peak * other * dim < EXACT


def _packed(size: int, name: str):
    """A function for mapInPandas from part, vec_id, row, wide, vector to blocks of about size components, each of one dimension and width."""

    def block(key: tuple[int, bool], kept: list, at: str) -> pd.DataFrame:
        # A null id sorts behind all others; its row's name says what it is.
        ids = [MOST if pd.isna(i) else int(i) for i, _, _ in kept]
        rows = [r or f"{at}-{k}{'-null' if pd.isna(i) else ''}" for k, (i, r, _) in enumerate(kept)]
        data = np.floor(np.array([v for _, _, v in kept], dtype=float).reshape(len(kept), key[0]))
        stats = statistics(data) if not key[1] else np.zeros((len(data), 0))
        peak = float(np.abs(data).max(initial=0))
        return pd.DataFrame([{"at": at, "dim": key[0], "ids": ids, "rows": rows, "data": data.tobytes(), "stats": stats.tobytes(), "peak": peak}])

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple[int, bool], list] = {}
        part, n = None, 0
        for frame in frames:
            for part, vec_id, row, wide, vector in zip(frame["part"], frame["vec_id"], frame["row"], frame["wide"], frame["vector"], strict=True):
                kept = open_.setdefault((len(vector), bool(wide)), [])
                kept.append((vec_id, row, vector))
                if len(kept) * max(1, len(vector)) >= size:
                    yield block((len(vector), bool(wide)), open_.pop((len(vector), bool(wide))), f"{name}{part}-{n}")
                    n += 1
        for key, kept in open_.items():
            yield block(key, kept, f"{name}{part}-{n}")
            n += 1

    return pack


def index(vectors: DataFrame, work: Workspace, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The written blocks of all vectors with their statistics; every vector gets a row name, so repeated ids stay apart."""
    lean = vectors.select(F.spark_partition_id().cast("string").alias("part"), F.col(vec_id).cast("long").alias("vec_id"), F.lit(None).cast("string").alias("row"), quantised(F.col(vector)).alias("vector"))
    peak = F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    wide = ~(peak * peak * F.size("vector") < EXACT)
    lean = lean.where("vector IS NOT NULL").select("part", "vec_id", "row", wide.alias("wide"), "vector")
    return work.table(lean.mapInPandas(_packed(BLOCK, "v"), BLOCKS), "index")


def asked(blocks: DataFrame, every: int, work: Workspace) -> DataFrame:
    """Blocks of those vectors whose id is divisible by every, under their names in the index."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                data = np.frombuffer(b.data).reshape(len(b.ids), b.dim)
                mine = [k for k, (i, row) in enumerate(zip(b.ids, b.rows, strict=True)) if i % every == 0 and not row.endswith("null")]
                if mine:
                    wide = _wide(b.peak, b.peak, b.dim)
                    yield pd.DataFrame({"part": b.at, "vec_id": [b.ids[k] for k in mine], "row": [b.rows[k] for k in mine], "wide": wide, "vector": [data[k] for k in mine]})

    lean = blocks.select("at", "dim", "ids", "rows", "data", "peak").mapInPandas(unpack, "part string, vec_id long, row string, wide boolean, vector array<double>")
    return work.table(lean.mapInPandas(_packed(ASKED, "q"), BLOCKS), "asked")


def _exact(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of all rows of a and b: exact in floating point, or made of Python's integers and held to what a long holds."""
    if not wide:
        return a @ b.T
    left, right = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), LEAST), MOST) for q in right] for p in left], dtype=np.int64).reshape(len(a), len(b))


def _survivors(q: np.ndarray, q_stats: np.ndarray, c: np.ndarray, c_stats: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, vector numbers, exact products) of pairs that may be among a query's k best: bounds on every level, then products reach its floor."""
    rows, columns, live = np.arange(len(q)), np.arange(len(c)), np.ones((len(q), len(c)), dtype=bool)
    lengths = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    for level in _levels(q.shape[1]):
        slack = 1e-9 * (lengths[0][rows] * lengths[1].max(initial=0) + 1)
        live &= q_stats[rows, level] @ c_stats[columns, level].T >= (floor[rows] - slack)[:, None]
        r, n = live.any(axis=1), live.any(axis=0)
        rows, columns, live = rows[r], columns[n], live[np.ix_(r, n)]
        if not live.size:
            return rows[:0], columns[:0], np.zeros(0)
    if live.mean() < SPARSE:
        i, j = np.nonzero(live)
        i, j = rows[i], columns[j]
        step = max(1, 8 * BLOCK // max(1, q.shape[1]))
        exact = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + step]], c[j[s : s + step]]) for s in range(0, len(i), step)])
        good = exact >= floor[i]
        return i[good], j[good], exact[good]
    exact = np.where(live, _exact(q[rows], c[columns], wide=False), -np.inf)
    i, j = np.nonzero((exact >= _own_floor(exact, k, floor[rows])[:, None]) & live)
    return rows[i], columns[j], exact[i, j]


def _own_floor(exact: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """The k-th best score of each row, the query itself left out, where that is above its floor."""
    if exact.shape[1] <= k:
        return floor
    return np.maximum(floor, np.partition(exact, -k - 1, axis=1)[:, -k - 1])


class _Best:
    """The k best found so far for each query of a block, ties to the smaller id; floor: the k-th score, which others must reach."""

    def __init__(self, ids: list[int], rows: list[str], floor: np.ndarray, k: int):
        self.ids, self.rows, self.k, self.floor = ids, rows, k, floor
        self.kept: list[list[tuple[int, int, str]]] = [[] for _ in ids]

    def take(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((ids, -scores, i))
        i, scores, ids, rows = i[order], scores[order], ids[order], rows[order]
        for q, first, n in zip(*np.unique(i, return_index=True, return_counts=True), strict=True):
            # One more than k, since the query itself may be among them.
            places = range(first, min(first + n, first + self.k + 1))
            new = [(-int(scores[x]), int(ids[x]), rows[x]) for x in places if rows[x] != self.rows[q]]
            best = self.kept[q] = sorted(self.kept[q] + new)[: self.k]
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], float(-best[-1][0]))

    def found(self) -> Iterator[tuple]:
        for vec_id, row, best in zip(self.ids, self.rows, self.kept, strict=True):
            for score, other, name in best:
                yield row, vec_id, -score, None if name.endswith("null") else other, name


def _scan(k: int):
    """A function for mapInPandas: pairs of a block of vectors and a block of queries to the k best of each query in this task."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, _Best] = {}
        for frame in frames:
            for b in frame.itertuples():
                q, c = (np.frombuffer(d).reshape(-1, b.dim) if b.dim else np.zeros((n, 0)) for d, n in ((b.q_data, len(b.q_ids)), (b.data, len(b.ids))))
                if b.q_at not in best:
                    floors = np.full(len(q), -np.inf) if b.q_floors is None else np.array(b.q_floors, dtype=float)
                    best[b.q_at] = _Best(list(b.q_ids), list(b.q_rows), floors, k)
                mine, ids, rows = best[b.q_at], np.array(b.ids, dtype=np.int64), np.array(b.rows, dtype=object)
                if _wide(b.peak, b.q_peak, b.dim) or not b.dim:
                    exact = _exact(q, c, wide=True)
                    i, j = np.nonzero(exact >= _own_floor(exact, k, mine.floor)[:, None])
                    mine.take(i, exact[i, j], ids[j], rows[j])
                else:
                    stats = (np.frombuffer(d).reshape(n, -1) for d, n in ((b.q_stats, len(q)), (b.stats, len(c))))
                    q_stats, c_stats = (s if s.shape[1] else statistics(m) for s, m in zip(stats, (q, c), strict=True))
                    i, j, scores = _survivors(q, q_stats, c, c_stats, mine.floor, k)
                    mine.take(i, scores, ids[j], rows[j])
        out = [row for m in best.values() for row in m.found()]
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at : at + 10_000], columns=["row", "query_id", "score", "vec_id", "found"]).astype({"vec_id": "Int64"})

    return scan


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """found with rank: the k best of each query row."""
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row whose id is divisible by every, the k other rows of the largest inner products.

    Components count as floor(256 x). All rows are candidates but the query's own, so a repeated id is one; ties go to the
    smaller id, null ids last. Vectors that are null or hold null or non-finite components take no part. Vectors
    of different lengths have no inner product and never meet; those without components all score 0. Scores
    beyond a long stop at its ends. Fewer candidates give fewer rows; an empty table gives none.

    Vectors are packed into blocks, written with the means and deviations of their segments. Blocks of queries are sent to all
    tasks in groups of SENT bytes, so the corpus is read where it lies and never shuffled. In rounds, each over
    GROWTH times the vectors before, tasks bound the products of a block pair on each level, coarse to fine, against
    the k-th score that a query already has, and compute the products of what is left. A task hands on k rows for
    each query.
    """
    work = Workspace(vectors.sparkSession, "search")
    blocks = index(vectors, work, vec_id, vector)
    queries = asked(blocks, every, work)
    size = F.length("data") + F.length("stats") + 64 * F.size("ids")
    running = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row for each block of queries
    dealt = queries.select("at", size.alias("size")).withColumn("group", F.floor(F.sum("size").over(running) / SENT)).drop("size")
    dealt = work.table(dealt, "dealt")
    groups = [row["group"] for row in dealt.select("group").distinct().collect()]
    rounds = max(1, math.ceil(math.log(max(1, blocks.count()), GROWTH)))
    place = F.pmod(F.xxhash64("at"), F.lit(1 << 30)) / float(1 << 30)
    results = vectors.sparkSession.createDataFrame([], FOUND + ", rank int")
    for group in sorted(groups):
        mine = queries.join(F.broadcast(dealt.where(F.col("group") == group).select("at")), "at", "left_semi").select(F.col("dim"), *[F.col(c).alias(f"q_{c}") for c in ("at", "ids", "rows", "data", "stats", "peak")])
        best = None
        for turn in range(rounds):
            share = [0.0 if turn + n == 0 else float(GROWTH) ** (turn + n - rounds) for n in (0, 1)]
            part = blocks.where((place >= share[0]) & (place < share[1]))
            if best is None:
                known = mine.withColumn("q_floors", F.lit(None).cast("array<double>"))
            else:
                reached = best.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
                each = mine.select("q_at", F.posexplode("q_rows").alias("n", "row")).join(reached, "row", "left")
                floors = each.groupBy("q_at").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))))["floor"].alias("q_floors"))
                known = mine.join(floors, "q_at")
            found = part.join(F.broadcast(known), "dim").mapInPandas(_scan(k), FOUND)
            best = work.table(_best_of(found if best is None else found.unionByName(best.drop("rank")), k), f"best-{group}-{turn}")
        results = best if len(groups) == 1 else results.unionByName(best)
    return results.select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """The 5 best of every row whose vec_id is divisible by 50."""
    return top_k(vectors)
