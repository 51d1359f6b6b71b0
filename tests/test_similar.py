"""Similarity joins against all pairs: one group of tasks or cells, small and large sets, ends of size classes; many common values."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamworks.operators import joins, similar
from loamworks.plans import values
from loamworks.session import Workspace


def brute(rows, least):
    return {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len(x & y) >= least * len(x | y) - 1e-12}


@pytest.mark.parametrize("least, sent, block", [(0.85, 32 << 20, 512), (0.85, 3000, 7), (0.6, 3000, 7), (1.0, 32 << 20, 7)])
def test_pairs_equal_all_pairs(spark, monkeypatch, least, sent, block):
    monkeypatch.setattr(similar, "SENT", sent)
    monkeypatch.setattr(similar, "ROWS", block)
    dice = random.Random(5)
    rows = []
    for size in (1, 2, 3, 6, 7, 17, 20, 40, 100, 340, 400, 1200):
        start = set(dice.sample(range(4000), size))
        for n in range(12):
            change = dice.randint(0, max(1, size // 6))
            rows.append((len(rows), set(list(start)[change * (n % 2):]) | set(dice.sample(range(4000), change * (n % 3 > 0)))))
    whole = set(range(5000, 5400))
    rows += [(900 + i, set(dice.sample(sorted(whole), 400 - 20 * i))) for i in range(6)] + [(950, set()), (951, set()), (7_000_000_000, whole)]
    df = spark.createDataFrame([(i, sorted(v)) for i, v in rows], "id long, v array<int>").repartition(5)
    got = {(r.a, r.b): r.similarity for r in joins.jaccard_join(df, "id", "v", least).collect()}
    sets = dict(rows)
    assert set(got) == brute(rows, least) and len(got) > 10
    assert all(abs(s - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-12 for (a, b), s in got.items())


def test_common_values_make_few_candidates(spark):
    """A thousand sets of 300 out of 700 values: each value is in nearly half of them, and no two are similar."""
    dice = random.Random(6)
    df = spark.createDataFrame([(i, dice.sample(range(700), 300)) for i in range(1000)], "id long, set array<int>")
    assert similar.candidates(df, 0.85, Workspace(spark, "test")).count() < 100


def test_near_prints_are_not_sent_through_the_driver(spark, tmp_path):
    dice = random.Random(7)
    rows = [(i, "xy"[i % 2], dice.getrandbits(63)) for i in range(300)]
    rows += [(300 + i, k, v ^ (1 << i % 60) ^ (1 << i * 7 % 61)) for i, (_, k, v) in enumerate(rows)]
    df = Workspace(spark, "prints").table(spark.createDataFrame(rows, "id long, g string, b long"), "prints")
    out = joins.hamming_first(df, "id", F.col("b"), ["g"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {i: min((j for j, h, w in rows if h == g and j < i and (v ^ w).bit_count() <= 5), default=None) for i, g, v in rows}
    assert {r.id: r.earlier for r in out.collect()} == want


def test_different_texts_of_equal_words_keep_all_their_pairs(spark):
    """Three texts of the same words, a copy of one, a similar text, and null and blank texts."""
    base = "a b c d e f g h i j"
    rows = [(0, base), (1, "b a c d e f g h i j"), (2, base + " a"), (3, "b a c d e f g h i j"), (4, base + " k"), (5, None), (6, None), (7, ""), (8, "  "), (9, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b): r.similarity for r in values.jaccard_pairs(df).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {(a, b): s for a, b, s in db.execute(values.SQL["jaccard_pairs"]).fetchall()}
    assert got == want and {(0, 1), (0, 2), (1, 2), (1, 3), (0, 4), (1, 4), (2, 4), (5, 6), (7, 8)} == set(got)


def test_only_sketches_are_written_before_pairs_are_found(spark, tmp_path):
    """Sets of five thousand values each: sketches and blocks take a small part of the values' bytes."""
    df = spark.range(40).selectExpr("id", "transform(sequence(1, 5000), x -> x * 1000 + id) AS set")
    work = Workspace(spark, "test")
    assert similar.candidates(df, 0.85, work).count() == 0
    written = spark.read.parquet(f"{work.at}/sketches").selectExpr("sum(length(data)) AS n").first().n
    assert written < 40 * 5000 * 8 / 20


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = gateway.jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_a_set_is_not_moved_for_each_of_its_pairs(spark):
    """150 near copies of a set of 2,000 hardly compressible values make 11,175 pairs."""
    words = F.concat(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.substring(F.sha2(i.cast("string"), 256), 1, 12)), F.array(F.sha2(F.col("id").cast("string"), 256)))
    df = Workspace(spark, "test").table(spark.range(150).select("id", words.alias("set")), "near")
    before = shuffled(spark)
    assert joins.jaccard_join(df, "id", "set", 0.85).count() == 150 * 149 // 2
    moved = sum(v for k, v in shuffled(spark).items() if k not in before)
    assert moved < 5 * 150 * 2000 * 12


def test_random_sets_are_told_by_their_sketches(spark):
    """Sets of 150 of 3,000 values: 64 bits leave a part in thirty of all pairs, of which none is similar."""
    dice = random.Random(8)
    df = spark.createDataFrame([(i, dice.sample(range(3000), 150)) for i in range(1000)], "id long, set array<int>")
    assert similar.candidates(df, 0.85, Workspace(spark, "test")).count() < 100


def test_pairs_within_and_between_small_homes(spark, monkeypatch):
    """Families of near copies over many homes, blocks sent in turns, values counted in parts; sets of strings with a null."""
    monkeypatch.setattr(similar, "SENT", 20_000)
    monkeypatch.setattr(similar, "VALUES", 300)
    monkeypatch.setattr(similar, "COUNTED", 100)
    monkeypatch.setattr(similar, "ENDS", 10)
    dice, rows = random.Random(9), []
    for size in (30, 64, 150):
        start = dice.sample(range(3000), size)
        rows += [(n, set(start[dice.randint(0, size // 9) :]) | set(dice.sample(range(3000), dice.randint(0, size // 9)))) for n in range(len(rows), len(rows) + 40)]
    rows = [(n, {None if v == 7 else f"w{v}" for v in x} | ({None} if n % 2 else set())) for n, x in rows]
    df = spark.createDataFrame([(n, list(x)) for n, x in rows], "id long, v array<string>").repartition(5)
    got = {(r.a, r.b): r.similarity for r in joins.jaccard_join(df, "id", "v", 0.85).collect()}
    sets = dict(rows)
    assert set(got) == brute(rows, 0.85) and len(got) > 300
    assert all(s == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for (a, b), s in got.items())
    work = Workspace(spark, "test")
    homes = similar.candidates(df.select("id", F.col("v").alias("set")), 0.85, work)
    assert homes.where("a_home = home").count() > 0 < homes.where("a_home <> home").count()
    assert joins.jaccard_join(df.where("id < 0"), "id", "v", 0.85).count() == 0


def test_sets_without_candidates_are_not_moved(spark):
    """No two of 60 sets of 2,000 digests are similar, and no ids are few enough to be sent."""
    words = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.substring(F.sha2(F.concat_ws("-", "id", i), 256), 1, 12))
    df = Workspace(spark, "test").table(spark.range(60).select("id", words.alias("set")), "far")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    try:
        assert joins.jaccard_classes(df, "id", "set", 0.85).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(v for k, v in shuffled(spark).items() if k not in before) < 60 * 2000 * 12 / 4


def test_cells_leave_few_sketches_to_compare(monkeypatch):
    """Families of near copies among random sets: by cells the same pairs are found, and few others are looked at."""
    dice = np.random.default_rng(10)
    least, ratio = 0.85, (1 / 0.85) ** (1 + 1e-9)
    rows = [dice.choice(1 << 40, 500, replace=False) for _ in range(600)]
    for i in range(0, 600, 3):
        part = dice.integers(20, 60)  # on both sides of the bound
        rows[i + 1] = np.concatenate((rows[i][part:], dice.choice(1 << 40, part // 2, replace=False)))
    rows.sort(key=len)
    cls = {math.floor(math.log(len(r)) / math.log(ratio)) for r in rows}
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([max(cls)] * 600, pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["id", "cls", "h"])
    made = next(similar._sketched(ratio, least)(iter([batch])))
    block = tuple(pa.array([b"".join(made[c].to_pylist())])[0] for c in ("data", "keys"))
    sizes = pa.array([[len(r) for r in rows]], pa.list_(pa.int32()))[0]
    looked, alike = [], similar._Both._alike
    monkeypatch.setattr(similar._Both, "_alike", lambda self, a, b: (looked.append(len(a)), alike(self, a, b))[1])
    met = [{(int(a), int(b)) for i, j in similar._Both(*[(sizes, *block)] * 2, 4, least, many).pairs() for a, b in zip(i, j, strict=True)} for many in (1, 1 << 40)]
    few = sum(looked[: -(-600 // similar.STRIP) * similar.CELLS])
    want = {(i, j) for i, a in enumerate(map(set, rows)) for j, b in enumerate(map(set, rows)) if len(a & b) >= least * len(a | b)}
    assert met[0] == met[1] and want <= met[0] and len(want) > 700 and few < 600 * 600 / 10


def test_sketches_hold_nulls_and_repeat_themselves(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5, 6, 7, None]), (1, [1, 2, 3, 4, 5, 6, 7, None]), (2, [1, 2, 3, 4, 5, 6, 7])], "id long, v array<long>")
    assert {(r.a, r.b) for r in joins.jaccard_join(df, "id", "v", 0.85).collect()} == {(0, 1), (0, 2), (1, 2)}
