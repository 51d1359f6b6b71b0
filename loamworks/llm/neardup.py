"""Near-duplicates by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm.components import components
from loamworks.llm.skew import HOT, looked_up
from loamworks.llm.words import mixed, raw, shingles, word_hashes
from loamworks.session import Workspace

#: Smallest hash values that a sketch retains, at first and where a text shares most of those with many others.
SKETCH, WIDE = 64, 2048
#: Values of both sketches that the estimate of a pair looks at.
ESTIMATE = 32
#: Standard deviations by which a sketch may fall short of a similarity before a pair is passed over.
SIGMAS = 6
#: Texts that a short list holds at most.
SHORT = 32
#: Ids of candidates that are sent to all tasks at most; more are joined by shuffle.
SENT = 500_000
#: Rounds in which each list is compared with one member, before what is left is compared in full.
PIVOTS = 2


def _sets(k: int, sketch: int):
    """Per row its id, text print, number of shingles, two set digests, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for first, last, words, at in word_hashes(data, offsets):
                sets = [shingles(words[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = {"id": batch.column(0).slice(first, last - first), "print": batch.column(2).slice(first, last - first), "n": pa.array([len(s) for s in sets], pa.int32())}
                whole = [s.view(np.uint64) for s in sets]
                cols["sum_a"] = pa.array(np.array([s.sum(dtype=np.uint64) for s in whole], np.uint64).view(np.int64))
                cols["sum_b"] = pa.array(np.array([mixed(s).sum(dtype=np.uint64) for s in whole], np.uint64).view(np.int64))
                low = [s[:sketch] for s in sets]
                cols["sketch"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, low)]), pa.int32()), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and text, compressed: less than half of what a set takes in a shuffle."""
    for batch in batches:
        data, offsets = raw(batch.column(1))
        sizes = np.diff(offsets)
        packed = [pa.compress(data[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"node": batch.column(0), "size": pa.array(sizes, pa.int64()), "text": pa.array(packed, pa.binary())})


def least_shared(k: Column, percent: int, sketch: int) -> Column:
    """Of k retained values, how many a similar text's sketch shares at least; exact while sketches hold whole sets."""
    t = percent / 100
    fewest = F.floor(k * t - F.sqrt(k * (t * (1 - t))) * SIGMAS)
    return F.when(k <= F.lit(t * sketch), F.floor((k * percent + 99) / 100)).otherwise(F.greatest(fewest, F.lit(1))).cast("int")


def _estimated(percent: int):
    """Of pairs with their sketches those that may be similar: a, b, and whether the sketches, as whole sets, prove it."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sure = [], []
            sizes = zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True)
            for (n, m), x, y in zip(sizes, batch.column("x"), batch.column("y"), strict=True):
                a, b = (np.asarray(v.values, np.int64) for v in (x, y))
                low = np.sort(np.concatenate((a, b)))
                same = low[1:] == low[:-1]
                whole = n <= len(a) and m <= len(b)
                sure.append(whole)
                if whole:
                    both = int(same.sum())
                    keep.append(100 * both >= percent * (n + m - both))
                    continue
                distinct = np.concatenate(([True], ~same))
                k = min(int(distinct.sum()), ESTIMATE)
                share = int((same & (low[1:] <= low[distinct][k - 1])).sum()) / k
                keep.append(share >= t - SIGMAS * sqrt(t * (1 - t) / k))
            out = pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "sure": pa.array(sure, pa.bool_())})
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def _similar(k: int, percent: int):
    """Pairs whose whole sets are similar; a set that comes again for the next pair is made once."""

    def made(size: int, packed: pa.BinaryScalar) -> np.ndarray:
        data = np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=size, codec="zstd"), np.uint8)
        words = [h for *_, h, _ in word_hashes(data, np.array([0, size]))]
        return shingles(np.concatenate(words), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            col = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                if (node := col["a"][i].as_py()) != last:
                    last, held = node, made(col["size_a"][i].as_py(), col["text_a"][i])
                other = made(col["size_b"][i].as_py(), col["text_b"][i])
                low = np.sort(np.concatenate((held, other)), kind="stable")
                both = int((low[1:] == low[:-1]).sum())
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Texts:
    """The distinct sets of a corpus, each with one text that has it: node, id, print, n, sketch."""

    def __init__(self, docs: DataFrame, texts: DataFrame, unique: bool, k: int, percent: int, work: Workspace):
        self.docs, self.texts, self.unique, self.k, self.percent, self.work = docs, texts, unique, k, percent, work

    def bodies(self, nodes: DataFrame, name: str) -> DataFrame:
        """node, text and print of the nodes given as (node), one row each; up to SENT ids are sent to the texts, which then aren't shuffled."""
        wanted = self.texts.join(nodes, "node", "left_semi").select("node", F.col("id").alias("of"), F.col("print").alias("mark"))
        wanted = self.work.table(wanted, f"{name}-wanted")
        few = wanted.limit(SENT + 1).count() <= SENT
        found = self.docs.join(F.broadcast(wanted) if few else wanted, (F.col("id") == F.col("of")) & (F.col("print") == F.col("mark")))
        return (found if self.unique else found.dropDuplicates(["node"])).select("node", "text", "print")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of nodes whose full sets are similar: sketches estimate first, then texts are fetched for the rest."""
        work = self.work
        ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        pairs = work.table(pairs, f"{name}-pairs")
        sketches = self.texts.join(ends(pairs), "node", "left_semi").select("node", "n", F.slice("sketch", 1, ESTIMATE).alias("s"))
        right = sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("s").alias("y"))
        left = sketches.select(F.col("node").alias("a"), "n", F.col("s").alias("x"))
        near = pairs.join(right, "b").join(left, "a").select("a", "b", "n", "m", "x", "y")
        near = work.table(near.mapInArrow(_estimated(self.percent), "a long, b long, sure boolean"), f"{name}-near")
        open_ = near.where("NOT sure")
        packed = work.table(self.bodies(ends(open_), name).select("node", "text").mapInArrow(_packed, "node long, size long, text binary"), f"{name}-texts")
        right = packed.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("text").alias("text_b"))
        left = packed.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("text").alias("text_a"))
        both = open_.join(right, "b").join(left, "a").select("a", "b", "size_a", "text_a", "size_b", "text_b")
        edges = both.mapInArrow(_similar(self.k, self.percent), "a long, b long")
        return near.where("sure").select("a", "b").unionByName(edges)


def _listed(texts: DataFrame, percent: int, sketch: int, count: int, work: Workspace, name: str) -> DataFrame:
    """Lists that each text (id, n, sketch) must share with any similar one: id, n, v, long, top.

    Of its retained values in order of rarity a text takes as many as leave fewer than it must share. Texts that
    share no value of a short list share at most what is left, so in long lists top bounds their overlap. The sketch
    of a larger text ends at a smaller hash, and a value beyond that end is rare though shared. So top counts only as
    many of the smallest values as any similar text's sketch reaches, and scales their share to the whole set; it is
    exact where even the largest similar text is retained whole.
    """
    t = percent / 100
    reach = max(1, int(sketch * t - SIGMAS * sqrt(sketch * t * (1 - t))))
    entries = texts.select("id", "n", F.size("sketch").alias("k"), F.posexplode("sketch").alias("pos", "v"))
    entries = entries.withColumn("early", (F.col("n") * 100 <= sketch * percent) | (F.col("pos") < reach)).drop("pos")
    lists = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").withColumn("hot", F.col("df") * HOT > max(count, HOT * SHORT))
    lists = work.table(lists, f"{name}-df")
    shared = looked_up(entries, lists, "v").groupBy("id", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "v", "early"))).alias("values"))
    room = F.size("values") - least_shared(F.col("k"), percent, sketch) + 1
    common = F.size(F.filter("values", lambda x: (x["df"] > SHORT) & x["early"]))
    guess = F.least(F.col("n"), common * F.col("n") / F.lit(reach) + F.col("n") * (SIGMAS / 2 / sqrt(reach)))
    top = F.when(F.col("n") * 100 <= sketch * percent, common).otherwise(guess).cast("double")
    taken = shared.withColumn("top", top).withColumn("room", room).where("room > 0")
    each = taken.select("id", "n", "top", F.explode(F.slice("values", 1, F.col("room"))).alias("x"))
    long = F.col("x.df") > SHORT
    return work.table(each.select("id", "n", F.col("x.v").alias("v"), long.alias("long"), F.when(long, F.col("top")).otherwise(F.col("n").cast("double")).alias("top")), name)


def _pairs(near: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a list's members with its others (p, m, cap, q), of components yet apart, that sizes and bounds allow."""
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    near = near.where((F.col("label") != F.col("q")) & fits & (F.least("top", "cap") * (100 + percent) >= (F.col("n") + F.col("m")) * percent))
    return near.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _split(open_: DataFrame, count: int) -> DataFrame:
    """Lists whose members are in different components: v and hot."""
    sides = open_.groupBy("v").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y"))
    return sides.where("x <> y").select("v", (F.col("c") * HOT > max(count, HOT * SHORT)).alias("hot"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: key, n_shingles and component_id, the smallest key that chains of similar texts reach.

    Texts with equal sets fall together first. Each remaining text puts into inverted lists those of its retained
    values that it must share with any similar text: its rarest ones, so that common passages make no pairs. A list
    is compared with one member a round while members of different components remain, and in the end every member
    outside the largest component with all others of near size; links within a component add nothing. Estimates from
    the union of two sketches pass over pairs, and exact Jaccard on full sets of whole texts decides.

    Null and empty texts, and rows with a null key, are linked with nothing. Repeated rows fall together. Where a key
    occurs with different texts, each is linked by its own words. Very long texts are hashed in pieces, whole.
    """
    work = Workspace(docs.sparkSession, "neardup")
    lean = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    rows = work.table(lean.mapInArrow(_sets(k, SKETCH), "id long, print long, n int, sum_a long, sum_b long, sketch array<long>"), "sketches")
    used = rows.where("n > 0 AND id IS NOT NULL")
    texts = used.groupBy("n", "sum_a", "sum_b").agg(F.min(F.struct("id", "print")).alias("first"), F.first("sketch").alias("sketch"))
    texts = work.table(texts.select("first.*", "n", "sum_a", "sum_b", "sketch", F.col("first.id").alias("node")), "texts")
    unique = used.groupBy("id", "print").count().where("count > 1").isEmpty()
    clash = not texts.groupBy("id").count().where("count > 1").isEmpty()
    if clash:  # the second and further texts of a key get nodes of their own
        turn = F.row_number().over(Window.partitionBy("id").orderBy("sum_a", "sum_b", "n"))
        own = F.when(F.col("turn") == 1, F.col("id")).otherwise(F.xxhash64("id", "sum_a", "sum_b", "n"))
        texts = work.table(texts.withColumn("turn", turn).withColumn("node", own).drop("turn"), "nodes")
    count = texts.count()
    source = _Texts(lean, texts, unique, k, percent, work)

    first = _listed(texts.select(F.col("node").alias("id"), "n", "sketch"), percent, SKETCH, count, work, "lists")
    crowded = work.table(first.where("long").select(F.col("id").alias("node")).distinct(), "crowded")
    wide = source.bodies(crowded, "wide").mapInArrow(_sets(k, WIDE), "id long, print long, n int, sum_a long, sum_b long, sketch array<long>")
    second = _listed(work.table(wide.select("id", "n", "sketch"), "wide"), percent, WIDE, count, work, "wide-lists").withColumn("v", F.col("v").bitwiseXOR(F.lit(1)))
    listed = first.where("NOT long").unionByName(second)

    labels = None
    for turn in range(PIVOTS + 1):
        if labels is None:
            open_ = listed.withColumn("label", F.col("id"))
        else:
            open_ = work.table(listed.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")), f"labelled-{turn}")
        lists = work.table(_split(open_, count), f"split-{turn}")
        if lists.isEmpty():
            break
        open_ = work.table(looked_up(open_, lists, "v"), f"open-{turn}")
        hot = lists.select("v", "hot")
        if turn < PIVOTS:
            order = F.struct((-F.col("top") / F.col("n") if turn == 0 else F.lit(0.0)).alias("o"), F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("p"), F.col("n").alias("m"), F.col("top").alias("cap"), F.col("label").alias("q"))
            others = open_.groupBy("v").agg(F.min(order).alias("first")).select("v", "first.p", "first.m", "first.cap", "first.q")
            others = work.table(others.join(hot, "v"), f"pivots-{turn}")
            near = looked_up(open_, others, "v")
        else:
            sizes = open_.groupBy("v", "label").agg(F.count("*").alias("c"))
            main = sizes.groupBy("v").agg(F.max(F.struct("c", "label")).getField("label").alias("main"))
            main = work.table(main.join(hot, "v"), f"main-{turn}")
            step = F.floor(F.log("n") / -F.log(F.lit(percent / 100))).cast("int")
            outside = looked_up(open_, main, "v").where("label <> main")
            outside = outside.select("v", F.col("id").alias("p"), F.col("n").alias("m"), F.col("top").alias("cap"), F.col("label").alias("q"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
            near = work.table(open_.withColumn("step", step), "sized").join(work.table(outside, "outside"), ["v", "step"])
        labels = components(source.verified(_pairs(near, percent), f"round-{turn}"), work, f"labels-{turn}", labels)
    if labels is None:
        labels = texts.select("node", F.col("node").alias("label")).limit(0)
    classes_ = texts.join(labels.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(F.col("n").alias("m"), F.col("sum_a").alias("x"), F.col("sum_b").alias("y"), "id", F.coalesce("label", "node").alias("class"))
    if clash:
        least = classes_.groupBy("class").agg(F.min("id").alias("class_id"))
        classes_ = work.table(classes_, "classes").join(work.table(least, "least"), "class").withColumn("class", F.col("class_id"))
    classes_ = classes_.select("m", "x", "y", "class")
    out = rows.join(classes_, (F.col("n") == F.col("m")) & (F.col("sum_a") == F.col("x")) & (F.col("sum_b") == F.col("y")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("class", "id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document the size of its set of 4-word shingles, its component, and whether it stands for it."""
    found = classes(docs.select("doc_id", "text"), k=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near-duplicates: the one with the smallest key. Empty texts and null keys all stay."""
    found = classes(docs.select(key, text), key, text, k, percent)
    keep = found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("__lw_key")).agg(F.max("n_shingles").alias("__lw_n"))
    best = Window.partitionBy(key).orderBy(F.xxhash64(text))
    rows = docs.join(keep, F.col(key) == F.col("__lw_key")).withColumn("__lw_turn", F.row_number().over(best))
    return rows.where((F.col("__lw_turn") == 1) | (F.col("__lw_n") == 0)).select(docs.columns).unionByName(docs.where(F.col(key).isNull()))
