"""Patterns of scenes over letters, blanks and line ends beyond ASCII, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.functions import text as T
from loamworks.operators import texts as X

ODD = ["die ö", "ß", " ", "\x0b", "\r", " ", "\u0085", " ", "甲", "_", "-", "\n", ""]
CORES = ["im", "SQL", "qd", "问：12345\r67", "答：12345 67890", "5\x0bmg", "5 μG", "5 µg", "“12\r34”", "class\x0bx:", "class x\x0b", "import\x0bos", "def f\x0b(", "第二条", "甲方"]


@pytest.mark.parametrize("kind", sorted(fixed.TEXT_PATTERNS))
def test_shares_equal_duckdb(spark, kind):
    texts = [a + c + b for c in CORES for a in ODD for b in ODD]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.round(T.pattern_share(F.col("t"), fixed.TEXT_PATTERNS[kind]), 6).alias("n")).collect()]
    db = duckdb.connect()
    ask = f"SELECT {' + '.join('regexp_matches($t, $p%d)::INT' % i for i in range(len(fixed.TEXT_PATTERNS[kind])))}"
    want = [round(100 * db.execute(ask, {"t": t} | {f"p{i}": p for i, p in enumerate(fixed.TEXT_PATTERNS[kind])}).fetchone()[0] / len(fixed.TEXT_PATTERNS[kind]), 6) for t in texts]
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert len(set(want)) > 1


def test_comment_lines_start_after_newlines_only(spark):
    count = F.regexp_count(F.lit("a\r# no # no\n # yes\n\x0b# no\n# yes"), F.lit(T.re2(r"(?m)^\s*(?:#|//|/\*)")))
    assert spark.range(1).select(count.alias("n")).first().n == 2


def test_fused_scene_knows_words_beside_letters_beyond_ascii(spark):
    none = {k: F.lit(None).cast("double") for k in fixed.TEXT_MIX}
    said = X.fused_text_scene(F.lit("tzölichö ungsch keitüim zenerverung"), none)
    row = spark.range(1).select(said.alias("s")).select("s.*").first()
    assert (row.scene, row.confidence, row.method) == ("medical_sft", 0.166667, "rule")


@pytest.mark.parametrize("scene", [X.image_scene, X.audio_scene, X.video_scene])
def test_scenes_lower_a_text_once(spark, scene):
    df = spark.range(1).selectExpr("cast(id AS string) AS text").select(scene(F.col("text")).alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1


def test_cheap_tests_before_patterns_change_no_match(spark):
    """First letters before the edge of a word, and texts of ASCII alone; both as RE2 in DuckDB has it."""
    texts = ["a HTTP b", "xHTTP", "HTTP_", "HTTPS", "(SQL)", "éSQL", "SQLé", "CREATE TABLE", "await", "await1", "po", "ipo", "po.", "第1条", "第 条", "甲方", "a方", "用法：", "用法", "注意事项:", "plain", "", "“abcde”", "“abc”", "一二三四……", "一二三，四五六", "Q: abcdef", "问：abcdef"]
    for patterns in fixed.TEXT_PATTERNS.values():
        for p in patterns:
            got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.pattern_share(F.col("t"), [p]).alias("s")).collect()]
            want = [100.0 * x for (x,) in duckdb.execute("SELECT regexp_matches(t, ?)::INT FROM (SELECT unnest(?) AS t)", [p, texts]).fetchall()]
            assert got == want, p
    assert [T.beyond_ascii(p) for p in ("第[一1]条", "[甲乙丙]方", "(?:用|量)x", r"[\x{4e00}-\x{9fa5}]{3,}a", "[问Q]x", "第?a", "[甲]{0,2}a", "第a|b", r"\d年", "(?:用|x)y")] == [True] * 4 + [False] * 6


def test_tokens_and_words_are_counted_once_as_columns_do(spark):
    texts = ["", None, "患者诊断 CT CT，剂量 50mg", "a b a\u00a0c\x0bé É!!", "bugbug debug class\n# x", "诊诊断断", "😀 😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = {r.k: r for r in X.token_entropy(df, "k", "t").collect()}
    dense = {r.k: r for r in df.select("k", *[T.density(F.col("t"), ws).alias(k) for k, ws in fixed.TEXT_WORDS.items()]).collect()}
    made = X.counted(df, "t", fixed.TEXT_WORDS)
    for r in made.select("k", "n_tokens", "n_types", "entropy", "ttr", *[T.dense(F.col(f"found.{k}"), F.length("t")).alias(k) for k in fixed.TEXT_WORDS]).collect():
        assert [r.n_tokens, r.n_types, r.entropy, r.ttr] == [want[r.k][c] for c in ("n_tokens", "n_types", "entropy", "ttr")], texts[r.k]
        assert all(r[k] == dense[r.k][k] for k in fixed.TEXT_WORDS), texts[r.k]
