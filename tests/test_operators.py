import hashlib
import math
import random
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.functions import text as T
from loamworks.operators import dedup, joins
from loamworks.operators import relational as R
from loamworks.operators import texts as X
from loamworks.operators import valuation as V
from loamworks.sources import ingest, sinks
from loamworks.streaming import state


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


SAFE = [
    ("这是一段关于临床诊断的正常文本内容", None), ("教你制造炸弹的步骤，内容很长很长", "violence"), ("hi", "quality"), ("a" * 200, "spam"), (" " * 200, None), ("x" * 100_001, "quality"),
    ("\x00\x01\x02" * 10 + "ab", "quality"), ("看 " + "https://a.example/b " * 6, "spam"), ("看 " + "https://a.example/b " * 5, None),
]


@pytest.mark.parametrize("text, want", SAFE)
def test_safety(spark, text, want):
    got = one(spark, X.safety(F.col("t")), t=text)
    assert (got.category if got else None) == want


def test_media_safety(spark):
    cases = [("data:image/png", "bad data URI"), ("abc", "too small"), ("<script>" * 30, "not base64"), ("data:video/mp4;base64," + "A" * 200, "other type"), ("A" * 200, None), ("data:image/png;base64," + "A" * 200, None)]
    for payload, want in cases:
        got = one(spark, X.media_safety(F.col("p"), F.lit("image")), p=payload)
        assert (got.reason if got else None) == want


def test_scenes_of_cjk_texts(spark):
    assert one(spark, X.text_scene(F.col("t")), t="患者诊断为高血压，处方剂量 50mg，用法：qd 口服治疗，复查血压血糖。").scene == "medical_sft"
    assert one(spark, X.text_scene(F.col("t")), t="甲方与乙方签订合同，第三条约定违约赔偿，2024年1月2日生效。").scene == "legal_doc"
    assert one(spark, X.text_scene(F.col("t")), t="短").scene == "noise"
    assert one(spark, X.image_scene(F.col("t")), t="Cyberpunk illustration, concept art").scene == "illustration"
    assert one(spark, X.audio_scene(F.col("t")), t="court hearing with attorney and plaintiff").scene == "speech_legal"
    assert one(spark, X.video_scene(F.col("t")), t="blank test loop").scene == "noise"
    assert one(spark, X.video_scene(F.col("t"), F.lit("cinematic")), t="nothing here").method == "fusion"


def test_grams_and_words(spark):
    assert one(spark, T.char_grams(F.col("t"), 3), t="患者 abc患者abc") == ["患者a", "者ab", "abc", "bc患", "c患者"]
    assert one(spark, T.char_grams(F.col("t"), 3), t="ab") == []
    assert one(spark, F.size(T.words(F.col("t"))), t="  a\t b\n") == 2 and one(spark, F.size(T.words(F.col("t"))), t=" ") == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1025))), (2, "short"), (3, None)], "id int, text string")
    assert [(r.id, r.chunk, r.token_count) for r in X.chunks(df).orderBy("chunk").collect()] == [(1, 0, 512), (1, 1, 512), (1, 2, 1)]


def test_greedy_equals_sequential_loop(spark):
    rng = random.Random(4)
    for _ in range(3):
        n = 60
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.06}
        kept = []
        for i in range(n):
            if not any((j, i) in edges for j in kept):
                kept.append(i)
        nodes = spark.range(n).withColumnRenamed("id", "k")
        got = dedup.greedy(nodes, spark.createDataFrame(list(edges), "a long, b long"), "k")
        assert sorted(r.k for r in got.collect()) == kept
    assert dedup.greedy(nodes, spark.createDataFrame([], "a long, b long"), "k").count() == n


def test_chain_keeps_both_ends(spark):
    base = "".join(chr(0x4E00 + i) for i in range(72))
    near = base[:66] + "uvwxyz"
    texts = [base, near, "ABCDEF" + near[6:], base, "", None, "ab"]
    got = dedup.fuzzy(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", "text", least=0.8)
    assert sorted(r.k for r in got.collect()) == [0, 2, 4, 6]


def test_semantic_recall_and_order(spark):
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = base + [[x + rng.gauss(0, 0.05) for x in v] for v in base] + [base[0], None]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, v array<double>")
    kept = {r.k for r in dedup.semantic(df, "k", "v").collect()}
    assert set(range(40)) | {81} <= kept and len(kept & set(range(40, 80))) <= 4 and 80 not in kept


def test_collisions(spark):
    e = lambda i: [1.0 if j == i else 0.0 for j in range(8)]
    corpus = spark.createDataFrame([(1, e(0)), (2, e(0)), (3, e(1)), (4, [1.0, 0.4] + [0.0] * 6), (5, None)], "vec_id long, embedding array<double>")
    near = joins.neighbours(corpus.where("vec_id IN (1, 3)"), corpus, 3)
    got = {r.query: r for r in V.collisions(near).collect()}
    assert got[1].verdict == "COLLISION" and got[1].duplicates == 2 and got[3].verdict == "SAFE"
    alone = joins.neighbours(corpus.where("vec_id = 9"), corpus, 3)
    assert alone.count() == 0
    assert one(spark, V.scarcity(F.col("n")), n=[Row(distance=1.0, id=1)]) == 0.5


def test_hamming_join(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(60)]
    rows = [(i, b, "m") for i, b in enumerate(base)] + [(100 + i, b ^ sum(1 << p for p in rng.sample(range(63), rng.choice((0, 3, 5, 6)))), "m") for i, b in enumerate(base)] + [(999, None, "m")]
    got = {r.k: r.earlier for r in joins.hamming_first(spark.createDataFrame(rows, "k long, b long, g string"), "k", F.col("b"), ["g"]).collect()}
    for k, b, _ in rows[:-1]:
        assert got[k] == min((j for j, c, _ in rows[:-1] if j < k and bin(b ^ c).count("1") <= 5), default=None)


def test_jaccard_join_is_complete(spark):
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(30), rng.randrange(0, 12))) for _ in range(120)]
    got = {(r.a, r.b) for r in joins.jaccard_join(spark.createDataFrame(list(enumerate(sets)), "k long, s array<long>"), "k", "s", 0.5).collect()}
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0
    assert got == {(a, b) for a in range(120) for b in range(a + 1, 120) if j(sets[a], sets[b]) >= 0.5}


def test_prices(spark):
    price = lambda base, demand, slope, conf: one(spark, V.curve_price(F.col("b"), F.lit(float(demand)), F.lit(float(slope)), F.lit(conf)), b=float(base))
    assert price(1000, 28, 32, 0.5) < price(1000, 28, 32, 0.9) and price(1000, 5, 25, 0.5) < price(1000, 28, 32, 0.5)
    assert price(0, 5, 25, 0.5) == 0
    for x in (-6.5, -2.5, -0.3, 0.0, 1.1, 3.9):
        assert one(spark, V.normal_cdf(F.col("x")), x=x) == pytest.approx(0.5 * (1 + math.erf(max(-6, min(6, x)) / math.sqrt(2))), abs=1e-9)
    s, k, r, v = 100.0, 60.0, 0.03, 0.4
    d1 = (math.log(s / k) + r + v * v / 2) / v
    want = s * 0.5 * (1 + math.erf(d1 / 2**0.5)) - k * math.exp(-r) * 0.5 * (1 + math.erf((d1 - v) / 2**0.5))
    assert one(spark, V.option_value(F.lit(s), F.lit(v)), x=1) == pytest.approx(want, abs=0.01)


def test_splits_and_commitment(spark):
    sales = spark.createDataFrame([(1, 99.99, {"a": 0.6, "b": 0.4})], "id int, price double, ratios map<string,double>")
    got = {r.creator: (str(r.creator_share), str(r.platform_fee)) for r in V.split_revenue(sales, "price", "ratios").collect()}
    assert got == {"a": ("41.9958", "17.9982"), "b": ("27.9972", "11.9988")}
    assert tuple(one(spark, V.split_on_chain(F.lit(1001), F.lit(777)), x=1)) == (777, 134, 90)
    h = lambda x: "0x" + hashlib.sha3_256(x.encode()).hexdigest()
    row = V.commitment(spark.createDataFrame([("k", "photo", 1234.5, "s", "c", 7)], "a string, s string, v double, salt string, c string, h int"), "a", "s", "v", "salt", "c", "h").first()
    nh = h(h(h("k|1000|s") + "|c|7"))
    assert (row.value_floor, row.nullifier_hash, row.commitment) == (1000, nh, h(f"{nh}|{h('photo')[:18]}|1000"))


def test_upserts_and_versions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, R.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, R.insert_ignore(a, b, "k").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert R.share_of_sum(a.withColumn("n", F.lit(0)), "k", F.col("n")).count() == 0
    flat = R.histogram(spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double"), "x").collect()
    assert [(r.bin, r.n) for r in flat] == [(0, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('content,domain,tags\n"first row, quite long",legal,"x, ,y"\nshort,,\n')
    (tmp_path / "b.jsonl").write_text('{"content": "a json line, long", "tags": ["p", "q"]}\nnot json\n{"content": "another line of it", "tags": "r,s"}\n{"no": 1}\n')
    (tmp_path / "c.txt").write_text("first paragraph here\r\n\r\nsecond paragraph here\n\n\n\n")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("medical_note.txt", "a note of some length")
        z.writestr(".hidden.txt", "hidden and long enough")
        z.writestr("x/picture.png", "no")
    (tmp_path / "e.zip").write_bytes(b"junk")
    good, bad = ingest.normalise(ingest.read_any(spark, str(tmp_path / "a.csv")))
    assert [(r.content, r.tags) for r in good.collect()] == [("first row, quite long", ["x", "y"])] and bad.first().reason == "too short"
    rows, wrong = ingest.read_jsonl(spark, str(tmp_path / "b.jsonl"))
    assert sorted(map(tuple, (r.tags for r in rows.collect()))) == [("p", "q"), ("r", "s")] and wrong.count() == 2
    assert [r.content.strip() for r in ingest.read_any(spark, str(tmp_path / "c.txt")).collect()] == ["first paragraph here", "second paragraph here"]
    got = ingest.read_any(spark, str(tmp_path / "d.zip")).collect()
    assert [(r.content, r.domain) for r in got] == [("a note of some length", "medical")]
    assert ingest.read_zip(spark, str(tmp_path / "e.zip")).first().error
    data = one(spark, ingest.decode_media(F.col("p")), p="data:image/png;base64,aGVsbG8=")
    assert bytes(data) == b"hello" and one(spark, ingest.decode_media(F.col("p")), p="%%%") is None


def test_packages(spark, tmp_path):
    df = spark.createDataFrame([("q", "a", 6.0), ("r", "b", 7.0)], "instruction string, output string, quality_score double")
    manifest = sinks.write_package({"sft": df}, str(tmp_path / "p"), {"sft": ["instruction", "output"]})
    assert tuple(manifest.first()) == ("sft", 2, 6.5)
    assert spark.read.json(f"{tmp_path}/p/sft_jsonl").columns == ["instruction", "output"] and spark.read.parquet(f"{tmp_path}/p/sft_parquet").count() == 2
    table = str(tmp_path / "t")
    df.write.parquet(table)
    sinks.replace_table(R.without(spark.read.parquet(table), F.col("output") == "a"), table)
    assert [r.output for r in spark.read.parquet(table).collect()] == ["b"]


def test_streams_equal_tables(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((1_700_000_000 + rng.random() * 500, i, f"u{i % 3}") for i in range(120))
    df = spark.createDataFrame([(i, u, t) for t, i, u in rows], "id long, u string, s double").select("id", "u", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    for k, (a, b) in enumerate(((0, 50), (50, 120))):
        ids = [i for _, i, _ in rows[a:b]]
        df.where(F.col("id").isin(ids)).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    for name, stream, table in (("w", state.stream_rate_limit(source, "u", "ts", "id", 3, 60.0), state.rate_limit(df, "u", "ts", "id", 3, 60.0)), ("b", state.stream_token_bucket(source, "u", "ts", "id", 3.0, 0.05), state.token_bucket(df, "u", "ts", "id", 3.0, 0.05))):
        run = stream.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert {r.id: r.allowed for r in spark.table(f"out_{name}").collect()} == {r.id: r.allowed for r in table.collect()}


def test_routed_limits_equal_sequential_model(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["/api/auth/login/x", "/api/valuate", "/api/free"]), rng.choice("ab"), 1_700_000_000 + i * 3 + rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, path string, who string, s double").select("id", "path", "who", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    lasting, buckets = {"/api/auth/login": (3, 60.0)}, {"/api/valuate": 4}
    want, accepted, level = {}, {}, {}
    for i, path, who, t in sorted(rows, key=lambda r: r[3]):
        if path.startswith("/api/auth/login"):
            ok, accepted[who] = state.window_step([t], accepted.get(who, []), 3, 60.0)
            want[i] = ok[0]
        elif path in buckets:
            ok, *level[who] = state.bucket_step([t], *level.get(who, [4.0, None]), 4.0, 4 / 60)
            want[i] = ok[0]
        else:
            want[i] = True
    got = {r.id: r.allowed for r in state.routed_limits(df, "path", "who", "ts", "id", lasting, buckets).collect()}
    assert got == want and not all(want.values())
    assert [one(spark, state.client(F.col("f"), F.col("h")), f=f, h="h") for f in ("1.2.3.4, 5.6.7.8", "")] == ["1.2.3.4", "h"]


def test_acoustic_print(spark):
    values = [0.1, 0.9, 0.8, 0.1, 0.1, 0.9, 0.2, 0.1, 0.9, 0.1]
    mean = sum(values) / len(values)
    bits = "".join("1" if v > mean else "0" for v in values).ljust(16, "0")
    want = "0xAFP_" + hashlib.sha256(bytes(int(bits[i : i + 8], 2) for i in (0, 8))).hexdigest()[:12].upper()
    assert one(spark, V.acoustic_print(F.col("r")), r=values) == want


def test_plans_stay_native_and_blocked(spark):
    from loamworks.plans import catalogue

    from .conftest import SF

    for name in ("safety_cascade", "qc_sft", "text_scene", "revenue_split", "jaccard_pairs", "hamming_dups", "token_quota"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    assert set(fixed.WEIGHTS) | {"general"} == set(fixed.CURVE)
    assert all(abs(sum(w) - 1) < 1e-9 for w in fixed.WEIGHTS.values())


def test_a_sample_is_scored_once_and_majorities_are_exact(spark):
    texts = [c * k + "".join(o * ((n - k) // 3) for o in "bé\n") for c in "e x甲\n" for n in (0, 1, 2, 51, 52, 60) for k in (0, n // 2, n // 2 + 1, n) if k <= n] + ["\x00" * k + "a" * (30 - k) for k in (11, 12, 13, 30)]
    df = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "id long, text string, lang string")
    for r in df.select("text", T.may_have_majority(F.col("text")).alias("may"), X.safety(F.col("text")).alias("v")).collect():
        n, most = len(r.text), max((r.text.count(c) for c in set(r.text)), default=0)
        assert r.may or most * 2 <= n
        if n > 50 and max((r.text.count(c) for c in set(r.text) - {" ", "\n"}), default=0) * 2 > n:
            assert r.v.reason == "one character"
        if n == 30:
            assert (r.v is not None) == (r.text.count("\x00") / n > 0.4)
    plan = X.approved(X.produced(df, "text", "lang")).select("id", "tier", "q")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
