"""The trie of conversation prefixes: members, children, leaves and shared text below every node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm.skew import HOT, looked_up
from loamworks.session import Workspace

# Conversations of one family share the first turns of the one whose id is a multiple of FAMILY.
FAMILY = 100
SHARED = 6
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

#: Depths of a path, and member ids of a node, that are summed up or listed at once.
BLOCK = 1024
IDS = 10_000


def numbered(convs: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, place (from 1), d1, d2 (digests of role and text) and size (code points of the text) for each turn.

    Turns go by turn, null first, then role and text. They are dealt by range, so one conversation with a
    third of all rows lies in many partitions; places count within a partition, from the turns before it on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lean = convs.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit("second"), text, role).alias("d2"), F.length(text).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("d1"), F.col("d2")]
    dealt = lean.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = work.table(dealt, "dealt")
    counts = dealt.groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Each border between partitions cuts one conversation at most: no more rows than twice the partitions.
    cut = counts.withColumn("before", F.sum("count").over(before)).where("before IS NOT NULL").select("conv_id", "part", "before")
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    rows = dealt.withColumn("own", F.row_number().over(within)).join(F.broadcast(cut), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "d1", "d2", "size")


def rebuilt(turns: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, depth, d1, d2, size and last (the conversation ends there) of every conversation's rebuilt turns; depth 0 is the root.

    A conversation c takes the first h turns of c - c % FAMILY, h = crc32(c) % SHARED, and then its own behind its first h.
    """
    turns = work.table(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    ids = work.table(convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")), "ids")
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = ids.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = work.table(heads.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "heads")
    bases = turns.where(f"conv_id % {FAMILY} = 0 AND place < {SHARED}").withColumnRenamed("conv_id", "base")  # at most 5 turns of a family, for at most 199 members
    shared = heads.join(bases, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "d1", "d2", "size", "length")
    own = turns.join(heads.select("conv_id", "h", "taken", "length"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "d1", "d2", "size", "length")
    root = heads.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).cast("long").alias("size"), "length")
    out = shared.unionByName(own).unionByName(root)
    return out.select("conv_id", "depth", "d1", "d2", "size", (F.col("depth") == F.col("length")).alias("last"))


def keyed(steps: DataFrame, work: Workspace) -> DataFrame:
    """steps with key and parent: 128-bit digests of the turns up to depth, and up to the one before.

    A prefix's digest is the exclusive or of its turns' digests, each hashed with its depth, which can be summed
    up in any order: first over blocks of depths, then within a block.
    """
    tagged = steps.withColumns({f"t{n}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(n), "depth", "d1", "d2")).otherwise(F.lit(0).cast("long")) for n in (1, 2)})
    tagged = work.table(tagged.withColumn("block", F.floor(F.col("depth") / BLOCK)).select("conv_id", "depth", "block", "t1", "t2", "size", "last"), "tagged")
    far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.where(f"depth >= {BLOCK}").select("conv_id").distinct()  # only conversations of several blocks
    sums = tagged.join(sums, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    sums = sums.withColumns({f"x{n}": F.bit_xor(f"x{n}").over(far) for n in (1, 2)}).where("x1 IS NOT NULL")
    near = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.withColumns({f"k{n}": F.bit_xor(f"t{n}").over(near) for n in (1, 2)}).join(sums, ["conv_id", "block"], "left")
    rows = rows.withColumns({f"k{n}": F.col(f"k{n}").bitwiseXOR(F.coalesce(f"x{n}", F.lit(0).cast("long"))) for n in (1, 2)})
    name = lambda back: F.concat(*[F.lpad(F.hex(F.col(f"k{n}").bitwiseXOR(F.col(f"t{n}")) if back else F.col(f"k{n}")), 16, "0") for n in (1, 2)])
    return rows.select("conv_id", "depth", "size", "last", name(False).alias("key"), F.when(F.col("depth") > 0, name(True)).alias("parent"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of its pieces, which come one after another, in order."""
    now, sha = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                keys.append(now)
                digests.append(sha.hexdigest())
            now, sha = key, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the ids of conversations that end there, ascending, comma-joined.

    Ids are first listed in blocks of IDS neighbouring ones; a node's blocks then pass through one digest in order.
    """
    listed = rows.where("last").groupBy("key", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    listed = listed.select("key", "block", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    listed = listed.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return listed.mapInArrow(_hash_lists, "key string, ends_sha256 string")


def trie(steps: DataFrame, work: Workspace) -> DataFrame:
    """One row for each node of the trie over steps (conv_id, depth, d1, d2, size, last; each conversation from depth 0 on without gaps).

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Each node's child with the most members (ties: the smaller conv_id) is heavy; a
    heavy path runs from a light node, or the root, to a leaf, and is named by the leaf's smallest member, whose
    own turns run along it. A light child has half its parent's members at most, so there are
    at most log2(conversations) light nodes above any: the paths hand their sums to the parents of their
    heads in as many rounds, deepest first, and suffix sums along all paths give the subtrees.
    """
    rows = work.table(keyed(steps, work), "rows")
    nodes = work.table(rows.groupBy("key", "parent", "depth", "size").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    total = rows.count()
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), "key")).alias("heavy"))
    children = work.table(children.select("parent", "n_children", F.col("heavy.key").alias("heavy")), "children")
    known = nodes.join(children.select(F.col("heavy").alias("key"), F.lit(False).alias("not_light")), "key", "left")
    known = known.withColumn("light", F.coalesce("not_light", F.lit(True))).drop("not_light")
    known = known.join(children.select(F.col("parent").alias("key"), "n_children"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = work.table(known.withColumn("hot", F.col("n_convs") > total / HOT), "known")

    # Heavy paths: a leaf's smallest member, from its last light node on.
    leaves = known.where("n_children = 0").select("conv_id")
    led = looked_up(rows.join(leaves, "conv_id", "left_semi").select("conv_id", "depth", "key"), known.select("key", "hot", "light", "parent", "n_convs", "n_children", "size"), "key")
    led = work.table(led, "led")
    heads = led.groupBy("conv_id").agg(F.max(F.when(F.col("light"), F.col("depth"))).alias("top"), F.sum(F.when(F.col("light") & (F.col("depth") > 0), 1).otherwise(0)).alias("level"))
    own = led.join(heads, "conv_id").where("depth >= top").select(
        F.col("conv_id").alias("path"), "depth", "key", "parent", "level", (F.col("depth") == F.col("top")).alias("head"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_convs") > total / HOT).alias("hot"),
    )
    own = work.table(own, "own")

    # Rounds: the sums of whole paths, handed to the node above each head.
    paths = own.groupBy("path", "level").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    tops = own.where("head AND parent IS NOT NULL").select("path", F.col("parent").alias("key"))
    above = looked_up(tops, own.select("key", "hot", F.col("path").alias("above")), "key")
    paths = work.table(paths.join(above, "path", "left"), "paths")
    handed, done = None, None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        whole = paths.where(F.col("level") == level)
        if handed is not None:
            whole = whole.join(handed, "path", "left").withColumns({name: F.col(name) + F.coalesce(f"more_{name}", F.lit(0)) for name in ("leaf", "saved")})
        whole = work.table(whole.select("path", "key", "above", "leaf", "saved"), f"level-{level}")
        handed = whole.groupBy(F.col("above").alias("path")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
        done = whole if done is None else done.unionByName(whole)
    if done is not None:
        hung = done.groupBy("key").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
        own = own.join(hung, "key", "left").withColumns({name: F.col(name) + F.coalesce(f"more_{name}", F.lit(0)) for name in ("leaf", "saved")})
    own = work.table(own.select("path", "depth", F.floor(F.col("depth") / BLOCK).alias("block"), "key", "leaf", "saved"), "summed")

    # Suffix sums along the paths, over blocks of depths first.
    far = Window.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("path", "block").agg(F.sum("leaf").alias("far_leaf"), F.sum("saved").alias("far_saved"))
    sums = sums.withColumns({name: F.sum(name).over(far) for name in ("far_leaf", "far_saved")}).where("far_leaf IS NOT NULL")
    near = Window.partitionBy("path", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = own.withColumns({name: F.sum(name).over(near) for name in ("leaf", "saved")}).join(sums, ["path", "block"], "left")
    below = below.select("key", (F.col("leaf") + F.coalesce("far_leaf", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("far_saved", F.lit(0))).alias("saved_tokens"))

    out = known.join(below, "key").join(ends(rows), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    out = work.table(out.select("key", "parent", "hot", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "out")
    parents = known.select(F.col("key").alias("parent"), "hot", F.col("conv_id").alias("parent_conv_id"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = looked_up(out.where("parent IS NOT NULL").drop("hot"), parents, "parent").select(*shown)
    return inner.unionByName(out.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shown))


def digest(convs: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Turns with
    one number go by role and digest of the text; repeated rows are turns each. A conversation without rebuilt
    turns is a member of the root only; an empty table has no nodes. Texts of any length are digested where they
    are read; only digests and lengths are shuffled. Other columns are ignored.
    """
    work = Workspace(convs.sparkSession, "trie")
    return trie(rebuilt(numbered(convs, work), work), work)
