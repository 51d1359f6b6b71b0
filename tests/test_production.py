"""Samples from models' answers, issues, the deduplication cascade and accounts on small cases."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.operators import dedup
from loamworks.operators import relational as R
from loamworks.operators import texts as X
from loamworks.plans import production
from loamworks.sources import ingest, sinks


def test_answers_that_cannot_be_read_fall_back(spark):
    raws = ['```json\n{"instruction": "a", "quality_score": 9.5}\n```', '  {"instruction": "b"}  ', "{}", "", None, "[1, 2]", '{"instruction": ', "plain words"]
    docs = spark.createDataFrame([(i, r, "text of it") for i, r in enumerate(raws)], "id long, raw string, text string")
    rows = docs.select("id", X.annotated_sft(F.col("raw"), F.col("text"), F.lit(None).cast("string")).alias("s")).orderBy("id").collect()
    assert [r.s.annotated_by for r in rows] == ["model"] * 2 + ["rule"] * 6
    assert [r.s.annot_score for r in rows] == [9.5, 6.0] + [5.5] * 6
    assert [r.s.tier for r in rows] == ["platinum"] + ["silver"] * 7
    assert rows[1].s.instruction == "b" and rows[1].s.output == "" and rows[7].s.output == "text of it"
    made = docs.select(X.annotated_dpo(F.lit('{"prompt": "p", "chosen": "c"}'), F.col("text")).alias("s")).first().s
    assert (made.prompt, made.chosen, made.rejected, made.annot_score) == ("p", "c", "", 6.0)


def test_issues_and_models(spark):
    kind = "struct<completeness:double,output_quality:double,language_fluency:double,instruction_clarity:double,relevance:double,factuality:double,overall:double,issues:array<string>>"
    model = (8.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0, ["x"])
    rows = [("", "long enough output", model), ("abc", "long enough output", model), ("explain this thing", "short", None), (None, None, None), ("explain this thing", "long enough output", (*model[:6], None, None))]
    df = spark.createDataFrame(rows, f"i string, o string, m {kind}")
    got = [r.q for r in df.select(X.qc_sft_report(F.col("i"), F.col("o"), F.lit(5.5), F.col("m")).alias("q")).collect()]
    assert got[0].qc_score == 0 and not got[0].passed and got[0].scored_by == "rule" and got[0].issues == [fixed.SFT_ISSUES["empty"]]
    assert got[1].qc_score == 7.5 and not got[1].passed and got[1].issues == ["x", fixed.SFT_ISSUES["short"]]  # 8 less 0.5; too short
    assert got[2].issues == [fixed.SFT_ISSUES["short_output"]] and not got[2].passed
    assert got[3].qc_score == 0 and len(got[3].issues) == 3
    assert got[4].qc_score == 8.0 and got[4].passed and got[4].issues == [] and got[4].scored_by == "model"


def test_preference_issues(spark):
    rows = [("p", "same words", "same words", None), ("p", "abc", "xyz", (9.0, ["weak 偏好", "weak 偏好", "other"])), ("", "abc", "xyz", None), ("p", None, "xyz", (9.0, []))]
    df = spark.createDataFrame(rows, "p string, c string, r string, m struct<overall:double,issues:array<string>>")
    got = [r.q for r in df.select(X.qc_dpo_report(F.col("p"), F.col("c"), F.col("r"), F.lit(7.0), F.col("m")).alias("q")).collect()]
    assert got[0].qc_score == 5.0 and got[0].passed and len(got[0].issues) == 2  # the same, and 100 % alike
    assert got[1].qc_score == 8.0 and got[1].issues == ["weak 偏好", "other"] and got[1].scored_by == "model"
    assert got[2].qc_score == 0 and not got[2].passed and got[3].qc_score == 0 and got[3].scored_by == "rule"


def test_cascade_counts_what_each_level_removes(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank at dawn today"
    rows = [(1, base, [1.0, 0.0]), (2, base, [0.0, 1.0]), (3, base + "!", [0.0, 1.0]), (4, "entirely other words stand here", [1.0, 0.01]), (5, "and these are different again", None), (6, None, None), (7, "", None)]
    kept, counts = dedup.cascade(spark.createDataFrame(rows, "id long, text string, v array<double>"), "id", "text", "v")
    assert sorted(r.id for r in kept.collect()) == [1, 5, 6]
    assert counts.first().asDict() == {"input_count": 7, "exact_removed": 2, "fuzzy_removed": 1, "semantic_removed": 1, "output_count": 3}
    none, counts = dedup.cascade(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert none.count() == 0 and counts.first().input_count == 0 and counts.first().output_count == 0


def test_versions_and_states(spark):
    versions = spark.createDataFrame([("1.0.0",), ("1.0.9",), ("2",), ("1.0.rc1",), ("",), (None,), ("7.",)], "v string")
    assert [r.n for r in versions.select(R.next_version(F.col("v")).alias("n")).collect()] == ["1.0.1", "1.0.10", "3", "1.0.0", "1.0.0", "1.0.0", "1.0.0"]
    log = spark.createDataFrame([("a", 1, 1, "on", False), ("a", 1, 2, "off", False), ("a", 9, 3, "on", True), ("b", 1, 4, None, None)], "k string, t int, e int, s string, p boolean")
    got = {r.k: (r.s, r.changes) for r in R.latest_state(log, "k", "t", "e", ["s"], F.col("p")).collect()}
    assert got == {"a": ("off", 2), "b": (None, 1)}
    jobs = spark.createDataFrame([("a",), ("b",), (None,)], "job string")
    alerts = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("b", True), (None, False)], "job string, done boolean")
    assert {r.job: r.has_alert for r in R.open_jobs(jobs, alerts, "job", "done").collect()} == {"a": True, "b": False, None: False}


def test_partitioned_table_reads_one_folder(spark):
    from .conftest import SF

    plan = production.QUERIES["partitioned_table"](spark, SF)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan and "PushedFilters: []" in plan


def test_refused_material(spark, tmp_path):
    (tmp_path / "a.csv").write_text("content,domain\nlong enough content,legal\n,medical\n")
    (tmp_path / "b.jsonl").write_text('{"content": "one two three"}\nnot json\n')
    (tmp_path / "c.zip").write_bytes(b"no archive")
    for name, n, reason in (("a.csv", 1, "no content"), ("b.jsonl", 1, "not a material"), ("c.zip", 0, None)):
        rows, refused = ingest.read_with_refused(spark, str(tmp_path / name))
        bad = refused.collect()
        assert rows.count() == n and len(bad) == 1 and refused.columns == ["value", "source_name", "reason"]
        assert bad[0].reason == reason or reason is None and bad[0].reason


def test_package_parts(spark, tmp_path):
    sft = spark.createDataFrame([("a", 9.0), ("a", 5.0), ("b", 5.0)], "creator string, quality_score double")
    dpo = spark.createDataFrame([("b", 7.0)], "creator string, quality_score double")
    kinds = {"sft": sft, "dpo": dpo}
    shares = sinks.contributions(kinds, "creator", {"sft": F.lit(1.0), "dpo": F.lit(2.0)})
    assert {r.creator: r.ratio for r in shares.collect()} == {"a": 0.4, "b": 0.6}
    manifest = sinks.write_package(kinds, str(tmp_path / "p"), {"sft": ["creator"], "dpo": ["creator"]})
    sinks.write_card(manifest, str(tmp_path / "p"), "Name", "What it is", "open")
    card = "\n".join(r.value for r in spark.read.text(str(tmp_path / "p/card")).collect())
    assert "# Name" in card and "- samples: 4" in card and "- dpo: 1\n- sft: 3" in card and "- mean score: 6.5" in card
    archives = sinks.zipped(sft.coalesce(1), "sft", rows=2).collect()
    assert sorted(r.rows for r in archives) == [1, 2]
    lines = [json.loads(x) for r in archives for x in zipfile.ZipFile(io.BytesIO(bytes(r.archive))).read("sft.jsonl").decode().splitlines()]
    assert sorted(x["quality_score"] for x in lines) == [5.0, 5.0, 9.0]
    assert sinks.zipped(sft.limit(0), "sft").count() == 0


def test_paragraphs_are_listed_where_their_text_is(spark):
    text = "short\n" + "long enough " * 6 + "\n\n  padded out  \n         \n0123456789"
    docs = spark.createDataFrame([(1, text, 950), (2, text, 400), (3, None, 0), (4, "", 0)], "doc_id long, text string, n_chars long")
    got = production.sql_functions(docs)
    rows = sorted(tuple(r) for r in got.collect())
    each = lambda i, tier: [(i, 1, ("long enough " * 6)[:40] + "…", tier), (i, 3, "  padded out  ", tier), (i, 5, "0123456789", tier)]
    assert rows == each(1, "platinum") + each(2, "rejected")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert [tuple(r) for r in spark.sql("SELECT * FROM lw_paragraphs('0123456789\\nno', 10)").collect()] == [(0, "0123456789")]
