"""Batches, packages, sources, scenes by anchors, growing corpora: what the catalogue's rows don't show."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.functions import text as T
from loamworks.operators import blocks, joins
from loamworks.operators import media as M
from loamworks.operators import texts as X
from loamworks.operators import valuation as V
from loamworks.plans import assets
from loamworks.sources import ingest, sinks
from loamworks.streaming import state

from .conftest import SF


def test_a_batch_survives_its_bad_assets(spark):
    rows = [Row(b="x", i=i, v=v) for i, v in enumerate([5.0, None, float("nan"), 50.0, float("inf"), -1.0, 9.0])] + [Row(b=None, i=1, v=3.0)]
    out = V.batch_valued(spark.createDataFrame(rows), "b", "i", F.col("v") * 2, V.refused(F.col("v"), 0, 10), limit=6)
    got = {(r.b, r["index"]): (r.status, r.detail, r.value) for r in out.collect()}
    assert [got["x", i][1] for i in range(6)] == [None, "missing", "not finite", "out of bounds", "not finite", "out of bounds"]
    assert got["x", 0] == ("ok", None, 10.0) and got[None, 0][2] == 6.0 and len(got) == 7
    totals = {r.b: (r.total, r.ok, r.errors, r.truncated) for r in V.batch_report(out, "b").collect()}
    assert totals == {"x": (6, 1, 5, True), None: (1, 1, 0, False)}


def test_a_bundle_holds_card_manifest_and_samples(spark, tmp_path):
    sft = spark.createDataFrame([("a", "q1", 9.0), ("a", "q2", 5.0), ("b", "q3", 7.0)], "creator string, instruction string, quality_score double")
    pre = spark.createDataFrame([("b", "some text")], "creator string, text string")
    columns = {"sft": ["instruction"], "pretrain": ["text"]}
    out = sinks.write_bundle({"sft": sft, "pretrain": pre}, str(tmp_path / "p"), columns, "creator", {"sft": F.lit(1.0), "pretrain": F.lit(1.0)}, "pkg-1", "Name", "What it is", "open").collect()
    files = {}
    for r in out:
        with zipfile.ZipFile(io.BytesIO(bytes(r.archive))) as archive:
            files |= {n: files.get(n, "") + archive.read(n).decode() for n in archive.namelist()}
    assert set(files) == {"README.md", "manifest.json", "sft.jsonl", "pretrain.jsonl"}
    told = json.loads(files["manifest.json"])
    assert told["package_id"] == "pkg-1" and told["total_samples"] == 4 and told["avg_quality"] == 7.0 and told["counts"] == {"sft": 3, "pretrain": 1}
    assert told["creator_contributions"] == {"a": 0.5, "b": 0.5} and told["export_paths"]["sft_parquet"].endswith("p/sft_parquet")
    assert files["README.md"].startswith("# Name") and sorted(json.loads(x)["instruction"] for x in files["sft.jsonl"].splitlines()) == ["q1", "q2", "q3"]
    assert "creator" not in json.loads(files["sft.jsonl"].splitlines()[0])


def test_labels_of_rows_and_paragraphs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('content,domain\n"first\nrow",x\nsecond row,y\n,z\n')
    (tmp_path / "b.csv").write_text("content\nanother one\n")
    got = {(r.source_name.rsplit("/", 1)[-1], r.label): r.content for r in ingest.read_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("a.csv", "row_2"): "first\nrow", ("a.csv", "row_3"): "second row", ("a.csv", "row_4"): None, ("b.csv", "row_2"): "another one"}
    parts = spark.range(1).select(ingest.paragraphs(F.lit("one\r\nline\r\n\r\ntwo\n\nthree\rfour")).alias("p")).first().p
    assert parts == ["one\nline", "two", "three\nfour"]


def test_newest_job_states_and_memory_first(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"j{i:02d}.json").write_text(json.dumps({"n": i}) if i != 58 else "{broken")
    (tmp_path / "j59.txt").write_text("no job")
    got = ingest.read_jobs(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r.state)["n"] for r in got) == [i for i in range(11, 60) if i != 58]
    memory = spark.createDataFrame([("j03", '{"n": -3}')], "job string, state string")
    assert json.loads(ingest.job_state(spark, str(tmp_path), "j03", memory).first().state) == {"n": -3}
    assert json.loads(ingest.job_state(spark, str(tmp_path), "j04", memory).first().state) == {"n": 4}
    assert ingest.job_state(spark, str(tmp_path), "j58").count() == ingest.job_state(spark, str(tmp_path), "j99").count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert ingest.read_jobs(spark, str(tmp_path / "none")).count() == 0


def test_a_ledger_of_nested_maps(spark, tmp_path):
    (tmp_path / "ledger.json").write_text('{\n"ann": {"pending": 2.5, "paid": 1},\n"bob": {"pending": 0.5}\n}')
    assert sorted(map(tuple, ingest.ledger_rows(spark, str(tmp_path / "ledger.json")).collect())) == [("ann", "paid", 1.0), ("ann", "pending", 2.5), ("bob", "pending", 0.5)]


def test_configuration_is_one_row(spark):
    (r,) = V.configuration(spark).collect()
    assert set(r.weights) == set(fixed.WEIGHTS) and r.curves["photo"].demand == fixed.CURVE["photo"][0] and r.tiers["gold"] == 2.0 and r.shapes["code_tech"].alpha == 3.0


@pytest.mark.parametrize(
    "text, near, want",
    [
        ("short", {"creative": 90.0}, ("noise", "noise")),
        ("patient diagnosis treatment clinical symptom dosage 20 mg qd", {"creative": 90.0, "chat_qa": 10.0}, ("medical_sft", "rule")),
        ("nothing here is like any of the scenes at all", {"creative": 90.0, "chat_qa": 10.0}, ("creative", "hybrid")),
        ("nothing here is like any of the scenes at all", {"poetry": 50.0, "chat_qa": 10.0}, ("poetry", "hybrid")),
        ("nothing here is like any of the scenes at all", {}, ("noise", "noise")),
        ("x" * 4000 + " contract", {"legal_doc": 10.0, "creative": 10.0}, ("legal_doc", "hybrid")),
    ],
)
def test_scenes_by_rule_and_anchors(spark, text, near, want):
    s = spark.createDataFrame([Row(t=text)]).select(X.fused_text_scene(F.col("t"), {k: F.lit(v) for k, v in near.items()}).alias("s")).first().s
    assert (s.scene, s.method) == want and 0 <= s.confidence <= 1


def test_payloads_are_checked_by_kind(spark):
    rows = [Row(i=0, p="a text of some length", k="text"), Row(i=1, p="short", k=None), Row(i=2, p="A" * 200, k="image"), Row(i=3, p="data:image/png;base64," + "A" * 200, k="audio"), Row(i=4, p=None, k="video"), Row(i=5, p="a text of some other kind", k="text")]
    said = F.when(F.col("i") == 5, F.struct(F.lit(0.9).alias("risk"), F.lit("toxic").alias("category"), F.lit("model").alias("reason")))
    got = {r.i: r.v for r in spark.createDataFrame(rows).select("i", X.checked(F.col("p"), F.col("k"), model=said).alias("v")).collect()}
    assert [got[i].layer for i in range(6)] == ["pass", "rule", "pass", "media", "media", "model"]
    assert [got[i].passed for i in range(6)] == [True, False, True, False, False, False] and got[5].risk == 0.9 and got[1].reason == "too short"


def test_dispatch_by_size(spark):
    rows = [(i, [float((i * 7 + j) % 11 - 5), 1.0, float(i % 3)]) for i in range(60) for j in (0,)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    mine = df.where("vec_id < 2")
    assert [r.score for r in V.dispatch_scores(mine, df.limit(0)).collect()] == [75.0, 75.0]
    few = {r.query: r.score for r in V.dispatch_scores(mine, df.where("vec_id < 4")).collect()}
    some = {r.query: r.score for r in V.dispatch_scores(mine, df.where("vec_id < 30")).collect()}
    whole = {r.query: r.score for r in V.dispatch_scores(mine, df).collect()}
    oob = {r.query: r.score for r in V.bootstrap_scores(mine, df, 8).collect()}
    beta = {r.query: r.score for r in V.shapley_scores(mine, df, alpha=4.0).collect()}
    assert set(few) == set(some) == {0, 1} and some == {r.query: r.score for r in V.bootstrap_scores(mine, df.where("vec_id < 30"), 10).collect()}
    assert all(abs(whole[q] - (0.65 * beta[q] + 0.35 * oob[q])) < 0.006 for q in whole)


def test_the_corpus_grows_with_every_batch(spark, tmp_path):
    """Each batch is scored against what came before it; a batch that is run again changes nothing (ST-06)."""
    seed = spark.createDataFrame([Row(id=0, v=[1.0, 0.0])])
    seed.write.parquet(f"{tmp_path}/corpus/batch=-1")
    for n, rows in enumerate(([Row(id=1, v=[0.0, 1.0])], [Row(id=2, v=[0.0, 1.0]), Row(id=3, v=[1.0, 1.0])])):
        spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(seed.schema).parquet(f"{tmp_path}/in")
        score = lambda batch, corpus: batch.join(F.broadcast(corpus.agg(F.count("*").alias("seen"))))
        state.score_and_grow(source, f"{tmp_path}/corpus", score, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.seen for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 1, 2: 2, 3: 2}
    assert spark.read.parquet(f"{tmp_path}/corpus").count() == 4


def test_distance_and_contribution_come_from_one_search(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float((i * 7) % 11 - 5), 1.0, float(i % 3)]) for i in range(40)] + [(40, None)], "vec_id long, embedding array<double>")
    docs = spark.range(42).withColumnRenamed("id", "doc_id")
    away = {r.query: r.x for r in joins.neighbours(df, df, 5).select("query", V.scarcity(F.col("near")).alias("x")).collect()}
    score = {r.query: r.score for r in V.shapley_scores(df, df).collect()}
    packed, made = blocks.packed, []
    monkeypatch.setattr(blocks, "packed", lambda *args, **more: made.append(args[5]) or packed(*args, **more))
    got = {r.doc_id: (r.away, r.shapley) for r in assets._scored(docs, df).collect()}
    assert sorted(made) == ["corpus", "queries"]
    assert got == {i: (away.get(i, assets.AWAY), score.get(i, assets.SHAPLEY)) for i in range(42)} and got[41] == (0.88, 75.0)


def test_said_counts_each_text_once_as_columns_do(spark):
    texts = ["", None, "  a b\tB a ", "Patient COURT 4K\n4k melody 手术 庭审", "ÉTÉ été İ x\u00a0y a\x0bb", "实验室实验室 lab", "no words of these"]
    lists = M.VIDEO_WORDS | fixed.AUDIO_WORDS
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r for r in X.said(df, "t", lists).collect()}
    t = F.coalesce("t", F.lit(""))
    columns = [F.size(T.words(t)).alias("n_words"), F.size(F.array_distinct(T.words(t))).alias("n_kinds"), F.size(F.array_distinct(T.words(F.lower(t)))).alias("n_low")]
    for r in df.select("k", *columns, F.struct(*[T.hits(F.lower(t), ws).alias(k) for k, ws in lists.items()]).alias("hits")).collect():
        assert got[r.k] == r, texts[r.k]


def test_fused_streams_scan_a_text_once(spark):
    """No scan for words stands in the plan as often as its result is used; the scene alone was looked up thirty times."""
    plan = assets.QUERIES["stream_fusion"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") == 0 and plan.count("split(") == 0 and plan.count("lower(") <= 2


def test_nearest_are_exact_whatever_single_precision_says():
    """Near ties below single precision, equal vectors, the query itself twice in a block, and blocks of fewer rows than are kept."""
    dice = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q = unit(dice.normal(size=(30, 16)))
    close = unit(np.repeat(q, 8, axis=0) + dice.normal(size=(240, 16)) * 1e-9)
    parts = [q[:3], np.concatenate((q, q[:5], close)), unit(dice.normal(size=(300, 16))), close[::3], q[4:9]]
    ids = [np.arange(1000, 1003), np.r_[np.arange(30), np.arange(5), np.arange(100, 340)], np.arange(2000, 2300), np.arange(3000, 3080), np.arange(4000, 4005)]
    near = joins._Near(np.arange(30))
    for c, i in zip(parts, ids, strict=True):
        near.see(q, c, i, 4)
    c, i = np.concatenate(parts), np.concatenate(ids)
    sims = np.einsum("ik,jk->ij", q, c)
    for row in range(30):
        use = i != row
        want = sorted(zip(np.round(1 - sims[row, use], 12), i[use], strict=True))[:4]
        got = list(zip(near.rows[1][near.rows[0] == row], near.rows[2][near.rows[0] == row], strict=True))
        assert [(round(d, 11), x) for d, x in got] == [(round(d, 11), x) for d, x in want] or np.allclose([d for d, _ in got], [d for d, _ in want], atol=2e-12, rtol=0)
        assert near.n[row] == use.sum() and abs(near.s1[row] - sims[row, use].sum()) < 1e-9 and abs(near.s2[row] - (sims[row, use] ** 2).sum()) < 1e-9
