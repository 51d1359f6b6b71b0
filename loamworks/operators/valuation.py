"""Prices, contribution scores, collisions and revenue."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.functions.text import let
from loamworks.operators import blocks
from loamworks.operators.joins import neighbours
from loamworks.operators.ledgers import numbered
from loamworks.session import Workspace


#: Scenes whose prototypes are sent to all tasks at most.
PROTOTYPES = 1000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def scene_table(spark: SparkSession) -> DataFrame:
    """Scenes with demand, slope, multiplier and weights; about twenty rows (P-16, J-04, J-05)."""
    rows = [(s, float(d), float(a), fixed.MULTIPLIER.get(s, 1.0), [float(w) for w in fixed.WEIGHTS.get(s, fixed.WEIGHTS["photo"])], *fixed.SHAPES.get(s, (2.0, 1.0))) for s, (d, a) in fixed.CURVE.items()]
    return spark.createDataFrame(rows, "scene string, demand double, slope double, multiplier double, weights array<double>, alpha double, beta double")


def with_scene(df: DataFrame, scene: str = "scene") -> DataFrame:
    """Rows with their scene's table row, or the general one's (J-04)."""
    table = scene_table(df.sparkSession)
    known = F.when(F.col(scene).isin(*fixed.CURVE), F.col(scene)).otherwise("general")
    return df.withColumn("__lw_scene", known).join(F.broadcast(table.withColumnRenamed("scene", "__lw_scene")), "__lw_scene").drop("__lw_scene")


def composite(metrics: Column, weights: Column) -> Column:
    """Weighted sum of the six dimensions (V-17)."""
    return F.aggregate(F.zip_with(metrics, weights, lambda m, w: m * w), F.lit(0.0), lambda s, x: s + x)


def base_value(quality: Column, unit: Column, multiplier: Column) -> Column:
    """Composite quality times units times multiplier times 2; nothing below 35 (V-17)."""
    return F.when(quality < 35, 0.0).otherwise(quality * unit * multiplier * 2.0)


def curve_price(base: Column, demand: Column, slope: Column, confidence: Column = None) -> Column:
    """Bonding-curve price with confidence boost and damping (V-18)."""
    confidence = F.lit(0.5) if confidence is None else confidence
    effective = demand * (1 + 0.1 * F.greatest(F.lit(0.0), (confidence - 0.7) / 0.3))
    return F.round(base * (1000 + effective * slope) / 1000 * (0.7 + 0.3 * 500 / (F.sqrt(base) + 500)), 2)


def chain_price(base: Column, demand: Column, slope: Column) -> Column:
    """Whole-number price on the ledger (W-04)."""
    return F.floor(base * (1000 + demand * slope) / 1000).cast("long")


def creator_ratio(shapley: Column) -> Column:
    return F.round(72 + 18 * shapley / 100, 4)


def volatility(scarcity: Column, shapley: Column, confidence: Column) -> Column:
    return clamp(0.08 + 0.52 * scarcity / 100 + 0.30 * shapley / 100 + 0.06 * (confidence - 0.5), 0.08, 0.92)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by its Taylor series around 0, to about 1e-12 within 6 deviations."""
    z = clamp(x, -6.0, 6.0)
    step = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(z.alias("term"), z.alias("sum")), step, lambda s: s["sum"])
    return 0.5 + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def option_value(spot: Column, sigma: Column, rate: float = 0.03, years: float = 1.0, strike: float = 0.6) -> Column:
    """Black-Scholes call at a strike of 0.6 of the spot price (V-19)."""
    d1 = (math.log(1 / strike) + (rate + sigma * sigma / 2) * years) / (sigma * math.sqrt(years))
    d2 = d1 - sigma * math.sqrt(years)
    return F.when(spot > 0, F.round(spot * normal_cdf(d1) - spot * strike * math.exp(-rate * years) * normal_cdf(d2), 2)).otherwise(0.0)


def scarcity(near: Column, k: int = 5) -> Column:
    """Half the mean distance of the nearest, within bounds; 0.88 without any (J-09, V-12)."""
    some = F.slice(near, 1, k)
    mean = F.aggregate(some, F.lit(0.0), lambda s, x: s + x["distance"]) / F.size(some)
    return F.when(F.size(some) > 0, F.round(clamp(mean / 2, 0.05, 0.98), 4)).otherwise(0.88)


def collisions(near: DataFrame, same: float = 0.08, close: float = 0.15, like: float = 0.40) -> DataFrame:
    """Counts by level, largest similarity and verdict of each query (A-11, V-25)."""
    count = lambda low, high: F.size(F.filter("near", lambda x: (x["distance"] >= low) & (x["distance"] < high)))
    out = near.select("query", count(-1.0, same).alias("duplicates"), count(same, close).alias("high"), count(close, like).alias("similar"), F.round(1 - F.get("near", F.lit(0))["distance"], 6).alias("max_similarity"))
    verdict = F.when(F.col("duplicates") > 0, "COLLISION").when(F.col("high") > 0, "HIGH_RISK").when(F.col("similar") > 0, "SIMILAR").otherwise("SAFE")
    return out.withColumn("verdict", verdict)


def centroid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The element-wise mean, as one row of an array (A-25)."""
    each = df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def shapley_scores(queries: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, alpha: float | None = None, beta: float = 1.0, keep: tuple[Column, ...] = ()) -> DataFrame:
    """Nearest-neighbour contribution score and confidence of each query (V-13); with alpha and beta the weighted variant (V-14).

    The centroid is the corpus's with the query's own vector taken out where it is in it. keep: further columns, made of near,
    the query's k nearest, which are searched once for all.
    """
    from loamworks.functions.vectors import cosine

    near = neighbours(queries, corpus, k, key, vector)
    total = centroid(corpus, vector).withColumn("whole", F.lit(corpus.where(F.col(vector).isNotNull()).count()))
    rows = near.join(queries.select(F.col(key).alias("query"), F.col(vector).alias("v")), "query").join(F.broadcast(total))
    rest = F.zip_with("centroid", "v", lambda c, x: (c * F.col("whole") - F.when(F.col("whole") > F.col("n"), x).otherwise(0.0)) / F.col("n"))
    gap = clamp((1 - cosine(F.col("v"), rest)) / 2, 0.0, 1.0)
    m = F.size("near")

    def weight(i: Column) -> Column:
        w = 1.0 / (i + 1)
        if alpha is None:
            return w
        x = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), i / m))
        return w * F.pow(x, alpha - 1) * F.pow(1 - x, beta - 1)

    weighted = F.transform("near", lambda x, i: F.struct((weight((i + 1).cast("double")) * x["distance"]).alias("a"), weight((i + 1).cast("double")).alias("b")))
    sums = F.aggregate(weighted, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] + x["a"]).alias("a"), (s["b"] + x["b"]).alias("b")))
    phi = clamp(F.coalesce(F.try_divide(sums["a"], sums["b"]), F.lit(0.0)), 0.0, 1.0)
    spread = F.least(F.lit(1.0), 5 * F.col("spread"))
    score = F.round(clamp(10 + 90 * (0.55 * phi + 0.30 * gap + 0.15 * spread), 10.0, 100.0), 2)
    return rows.select("query", score.alias("score"), F.round(0.4 + 0.6 * gap, 3).alias("confidence"), *keep)


def members(key: Column, rounds: int, share: float, seed: int) -> Column:
    """Whether a key is in each of the rounds' subsets, by digest."""
    place = lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), b, key.cast("long"))), 1, 8), 16, 10).cast("long") % 1000
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda b: place(b) < int(1000 * share))


def bootstrap_scores(queries: DataFrame, corpus: DataFrame, rounds: int = 10, share: float = 0.7, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Out-of-bag contribution: mean gain over seeded subsets of about share of the corpus (V-15).

    A row's membership in a subset follows from its key and the seed, so any partitioning gives the same subsets.
    A subset's total is one sum for all queries, from which a query's own vector is taken out where it is a
    member; the most similar member comes from blocks that meet in the executors. Nothing comes to the driver.
    """
    from loamworks.functions.vectors import cosine

    work = Workspace(corpus.sparkSession, "bootstrap")
    inside = members(F.col(key), rounds, share, seed)
    marked = corpus.withColumn("__lw_in", inside)
    asked = blocks.packed(queries, key, vector, blocks.ASKED, work, "queries")
    held = blocks.packed(marked, key, vector, blocks.BLOCK, work, "corpus", "__lw_in")
    pairs = blocks.met(asked, held).select("dim", "q_at", "q_ids", "q_data", "ids", "data", "members")
    best = pairs.mapInArrow(_subsets(rounds), "query long, b int, n long, best double").groupBy("query", "b").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    each = marked.where(F.col(vector).isNotNull()).select(F.posexplode("__lw_in").alias("b", "in"), F.col(vector).alias("v")).where("in").select("b", F.posexplode("v").alias("i", "x"))
    sums = each.groupBy("b", "i").agg(F.sum(F.col("x").cast("double")).alias("x")).groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    mine = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).alias("v"))
    own = corpus.select(F.col(key).cast("long").alias("query")).distinct().join(mine, "query").select("query", F.posexplode(members(F.col("query"), rounds, share, seed)).alias("b", "member"))
    rows = best.join(own, ["query", "b"], "left").join(F.broadcast(sums), "b").join(mine, "query")  # rounds rows of sums
    rest = F.when(F.coalesce("member", F.lit(False)), F.zip_with("c", "v", lambda c, x: c - x)).otherwise(F.col("c"))
    gain = 0.6 * clamp(1 - cosine(F.col("v"), rest), 0.0, 2.0) / 2 + 0.4 * clamp((1 - F.col("best")) / 2, 0.0, 1.0)
    mean, sd = F.avg("gain"), F.stddev_pop("gain")
    return rows.select("query", gain.alias("gain")).groupBy("query").agg(F.round(clamp(10 + 90 * mean, 10.0, 100.0), 2).alias("score"), F.round(clamp(1 - sd / F.greatest(mean, F.lit(1e-6)), 0.0, 1.0), 3).alias("confidence"))


def _subsets(rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for at, q_ids, q, ids, c, members in blocks.matrices(batches, "members"):
            inside = np.frombuffer(members.as_buffer(), bool).reshape(len(ids), rounds)
            _, n, best = found.setdefault(at, (q_ids, np.zeros((len(q), rounds), np.int64), np.full((len(q), rounds), -1.0)))
            sims = np.where(ids[None, :] == q_ids[:, None], np.nan, q @ c.T)
            for b in range(rounds):
                use = sims[:, inside[:, b]]
                n[:, b] += np.isfinite(use).sum(axis=1)
                best[:, b] = np.maximum(best[:, b], np.nan_to_num(use, nan=-1.0).max(axis=1, initial=-1.0))
        for q_ids, n, best in found.values():
            columns = [pa.array(np.repeat(q_ids, rounds)), pa.array(np.tile(np.arange(rounds, dtype=np.int32), len(q_ids))), pa.array(n.reshape(-1)), pa.array(best.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "b", "n", "best"])

    return run


def dispatch_scores(queries: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", alpha: float = 4.0, beta: float = 1.0) -> DataFrame:
    """query and score by the way that fits the corpus's size (V-16): none, a gap to its mean, subsets, or neighbours.

    Only the way that is taken is computed. An empty corpus gives 75.
    """
    from loamworks.functions.vectors import cosine

    n = corpus.where(F.col(vector).isNotNull()).count()
    mine = queries.where(F.col(vector).isNotNull())
    if n == 0:
        return mine.select(F.col(key).cast("long").alias("query"), F.lit(75.0).alias("score"))
    if n < 5:
        rows = mine.select(F.col(key).cast("long").alias("query"), F.col(vector).alias("v")).join(F.broadcast(centroid(corpus, vector)))
        return rows.select("query", F.round(clamp(10 + 90 * (1 - cosine(F.col("v"), F.col("centroid"))) / 2, 10.0, 100.0), 2).alias("score"))
    if n < 50:
        return bootstrap_scores(queries, corpus, 10, key=key, vector=vector).select("query", "score")
    weighed = shapley_scores(queries, corpus, key, vector, alpha=alpha, beta=beta).select("query", F.col("score").alias("weighed"))
    if n < 500:
        other, share = bootstrap_scores(queries, corpus, 8, key=key, vector=vector), 0.65
    else:
        other, share = shapley_scores(queries, corpus, key, vector), 0.5
    return weighed.join(other.select("query", F.col("score").alias("other")), "query").select("query", F.round(F.round(share * F.col("weighed") + (1 - share) * F.col("other"), 6), 2).alias("score"))


def split_revenue(sales: DataFrame, sale: str, ratios: str, creator_share: float = 0.70) -> DataFrame:
    """Each sale's pool dealt by contribution (RV-01): creator, creator_share and platform_fee in decimals."""
    money = lambda c: F.round(c.cast("decimal(28,10)"), 4).cast("decimal(18,4)")
    each = sales.select(*[c for c in sales.columns if c not in (sale, ratios)], F.col(sale).alias("sale"), F.explode(ratios).alias("creator", "ratio"))
    pool, fee = money(F.col("sale") * creator_share), money(F.col("sale") * (1 - creator_share))
    return each.withColumn("creator_share", money(pool * F.col("ratio").cast("decimal(9,6)"))).withColumn("platform_fee", money(fee * F.col("ratio").cast("decimal(9,6)")))


def split_on_chain(value: Column, ratio: Column) -> Column:
    """Whole-number split between creator, platform and fund (RV-02)."""
    creator = F.floor(value * ratio / 1000).cast("long")
    platform = F.floor((value - creator) * 60 / 100).cast("long")
    return F.struct(creator.alias("creator"), platform.alias("platform"), (value - creator - platform).alias("fund"))


def demand_ledger(purchases: DataFrame, domain: str, time: str, key: str, base: Column, slope: Column) -> DataFrame:
    """Each purchase's price at the demand before it; a domain with most of all purchases is dealt out (W-04)."""
    rows = numbered(purchases, domain, [time, key], "demand").withColumn("demand", F.col("demand") - 1)
    return rows.withColumn("price", chain_price(base, F.col("demand"), slope))


def curve_table(assets: DataFrame, base: Column, last: int = 60, step: int = 2) -> DataFrame:
    """assets (with slope) once for each demand from 0 to last, with demand and price (V-27)."""
    each = assets.withColumn("demand", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(step))))
    return each.withColumn("price", curve_price(base, F.col("demand").cast("double"), F.col("slope")))


def commitment(df: DataFrame, asset: str, scene: str, value: str, salt: str, creator: str, hour: str) -> DataFrame:
    """Value floor, nullifier hash and commitment by SHA3-256 (V-21)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = lambda x: "0x" + hashlib.sha3_256(x.encode()).hexdigest()
        for batch in batches:
            out = []
            for key, what, v, s, who, epoch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                floor = int(v // 500) * 500
                secret = h(f"{key}|{floor}|{s}")
                nh = h(h(f"{secret}|{who}|{epoch}"))
                out.append((key, floor, nh, h(f"{nh}|{h(what)[:18]}|{floor}")))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["asset", "value_floor", "nullifier_hash", "commitment"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [text(asset), text(scene), F.coalesce(F.col(value).cast("double"), F.lit(0.0)), text(salt), text(creator), text(hour)]
    lean = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    return lean.mapInArrow(run, "asset string, value_floor long, nullifier_hash string, commitment string")


def simhash(words: Column) -> Column:
    """64 bits, each the sign of all words' votes by the low half of their MD5 digests (V-22); no words give 0."""
    half = lambda w, at: F.conv(F.substring(F.md5(w), at, 8), 16, 10).cast("long")
    hashes = F.transform(words, lambda w: F.shiftleft(half(w, 17), 32).bitwiseOR(half(w, 25)))

    def voted(hashes: Column) -> Column:
        vote = lambda i: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.getbit(h, i) == 1, 1).otherwise(-1))
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(vote(i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))

    return let(hashes, voted)


def fingerprint(description: Column, n: int = 16) -> Column:
    """What stands for a fingerprint without the media itself (V-33)."""
    return F.upper(F.substring(F.sha2(description, 256), 1, n))


def fused(video: dict[str, Column], audio: dict[str, Column]) -> dict[str, Column]:
    """Video measures fused with audio ones, where there are any (J-16, V-11)."""
    # The video's share of each dimension.
    share = {"entropy": 0.55, "snr": 0.55, "structure": 0.50, "scarcity": 0.70, "llm_value": 0.60, "shapley": 0.65}
    both = lambda d, v: F.least(F.lit(100.0), F.round(v * share[d] + audio[d] * (1 - share[d]), 6))
    return {d: F.round(F.coalesce(both(d, v), v), 1) for d, v in video.items()}


def acoustic_print(rms: Column) -> Column:
    """Fingerprint of an energy envelope: a bit for each frame above the mean (V-23)."""
    mean = F.aggregate(rms, F.lit(0.0), lambda s, x: s + x) / F.size(rms)
    bits = F.array_join(F.transform(rms, lambda x: F.when(x > mean, "1").otherwise("0")), "")
    count = F.ceil(F.length(bits) / 8).cast("int")
    padded = F.rpad(bits, count * 8, F.lit("0"))
    octet = lambda i: F.lpad(F.conv(F.substr(padded, (i - 1) * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), count), octet), ""))
    return F.when(F.size(rms) > 0, F.concat(F.lit("0xAFP_"), F.upper(F.substring(F.sha2(body, 256), 1, 12))))


def alignment(df: DataFrame, prototypes: DataFrame, vector: str, scene: str) -> DataFrame:
    """Rows with align, 0 to 100: the cosine to the scene's prototype, or the best of all for a scene without one (V-24).

    prototypes (scene, prototype) has a row for each scene, PROTOTYPES at most, as they go to all tasks; a null vector gives 50.
    """
    from loamworks.functions.vectors import cosine

    if prototypes.limit(PROTOTYPES + 1).count() > PROTOTYPES:
        raise ValueError(f"more than {PROTOTYPES} prototypes")
    table = prototypes.select(F.collect_list(F.struct("scene", "prototype")).alias("__lw_p"))
    score = lambda p: clamp((cosine(F.col(vector), p["prototype"]) + 1) / 2 * 100, 0.0, 100.0)
    own = F.filter("__lw_p", lambda p: p["scene"] == F.col(scene))
    used = F.when(F.size(own) > 0, own).otherwise(F.col("__lw_p"))
    best = F.array_max(F.transform(used, score))
    return df.join(F.broadcast(table)).withColumn("align", F.when(F.col(vector).isNull(), 50.0).otherwise(F.coalesce(best, F.lit(50.0)))).drop("__lw_p")


def refused(value: Column, least: float, most: float) -> Column:
    """Why a value can't be valued, or null."""
    odd = F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))
    return F.when(value.isNull(), "missing").when(odd, "not finite").when(~value.between(least, most), "out of bounds")


def batch_valued(assets: DataFrame, batch: str, order: str, value: Column, why: Column, limit: int = 20) -> DataFrame:
    """batch, index (from 0), status, detail, value and n (of the whole batch) of the first limit assets of each batch (V-26).

    An asset with a reason in why fails alone: its value isn't computed, and the others' are. A null value fails, too.
    """
    rows = assets.withColumn("__lw_why", why)
    rows = rows.withColumn("__lw_value", F.when(F.col("__lw_why").isNull(), value))
    index = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    rows = rows.select(batch, index.alias("index"), F.coalesce("__lw_why", F.when(F.col("__lw_value").isNull(), "no value")).alias("detail"), F.col("__lw_value").alias("value")).where(F.col("index") <= limit)
    sizes = assets.groupBy(batch).agg(F.count("*").alias("n"))
    rows = rows.join(sizes.withColumnRenamed(batch, "__lw_batch"), F.col(batch).eqNullSafe(F.col("__lw_batch")))
    return rows.select(batch, (F.col("index") - 1).alias("index"), F.when(F.col("detail").isNull(), "ok").otherwise("error").alias("status"), "detail", "value", "n")


def batch_report(results: DataFrame, batch: str, worth: str | None = None) -> DataFrame:
    """Totals of each batch: results, ok, errors, and whether the batch was cut (V-26); worth: a column to sum."""
    ok = F.count(F.when(F.col("status") == "ok", 1))
    more = [F.coalesce(F.sum(worth), F.lit(0)).alias("worth")] if worth else []
    return results.groupBy(batch).agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("errors"), (F.max("n") > F.count("*")).alias("truncated"), *more)


def configuration(spark: SparkSession) -> DataFrame:
    """All tables of scenes and kinds as one row of maps: weights, curves, multipliers, shapes, tiers and kinds of samples (P-16)."""
    table = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    weights = table({k: F.array(*[F.lit(float(x)) for x in w]) for k, w in fixed.WEIGHTS.items()})
    curves = table({k: F.struct(F.lit(float(d)).alias("demand"), F.lit(float(a)).alias("slope")) for k, (d, a) in fixed.CURVE.items()})
    shapes = table({k: F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for k, (a, b) in fixed.SHAPES.items()})
    plain = {"multipliers": fixed.MULTIPLIER, "tiers": fixed.TIER_WEIGHT, "kinds": fixed.KIND_WEIGHT}
    return spark.range(1).select(weights.alias("weights"), curves.alias("curves"), shapes.alias("shapes"), *[table({k: F.lit(float(v)) for k, v in t.items()}).alias(n) for n, t in plain.items()])
