"""Catalogue: ingestion, safety, annotation, quality control and scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.operators import relational as R
from loamworks.operators import texts as X
from loamworks.session import read_table
from loamworks.sources import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Words that occur in the sample texts, in place of the dictionaries.
SAMPLE_UNSAFE = {"violence": ["idiot", "moron"], "spam": ["clown", "pathetic"]}
SAMPLE_SCENES = {"medical_sft": ["the", "and"], "legal_doc": ["der", "und"], "code_tech": ["que"], "creative": ["les", "des"], "chat_qa": ["is", "was"]}
SAMPLE_PATTERNS = {"medical_sft": [r"tion ", r"\d+"], "legal_doc": [r" die "], "code_tech": [r"ción", r" el "], "creative": [r" la ", r"eau"], "chat_qa": [r"\.\n"]}
SAMPLE_WORDS = {"a_scene": ["tion", "the"], "b_scene": ["eau", "une"], "c_scene": ["ción"], "d_scene": ["und", "ein"]}


def query(sql: str | None = None):
    def register(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_table(spark, sf_dir, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _sql_hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


def _sql_best(scores: dict[str, str]) -> str:
    """Scene with the largest score, the first of equal ones."""
    names = ", ".join(f"'{k}'" for k in scores)
    return f"[{names}][list_position([{', '.join(f'({s})::DOUBLE' for s in scores.values())}], greatest({', '.join(f'({s})::DOUBLE' for s in scores.values())}))]"


WS = r"[ \t\n\x0b\x0c\r]+"
WORDS = r"(CASE WHEN trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN []::VARCHAR[] ELSE string_split_regex(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '" + WS + "') END)"


@query(r"SELECT doc_id, trim(replace(text, chr(13) || chr(10), chr(10))) AS content, lower(lang) AS domain FROM documents WHERE length(trim(replace(text, chr(13) || chr(10), chr(10)))) >= 10")
def ingest_normalize(documents: DataFrame) -> DataFrame:
    content = F.trim(F.replace("text", F.lit("\r\n"), F.lit("\n")))
    return documents.select("doc_id", content.alias("content"), F.lower("lang").alias("domain")).where(F.length("content") >= 10)


PARAGRAPHS = "string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))"


@query(f"SELECT doc_id, i - 1 AS paragraph, p AS content FROM (SELECT doc_id, unnest({PARAGRAPHS}) AS p, generate_subscripts({PARAGRAPHS}, 1) AS i FROM documents) WHERE length(trim(p)) >= 10")
def ingest_paragraphs(documents: DataFrame) -> DataFrame:
    each = documents.select("doc_id", F.posexplode(ingest.paragraphs(F.coalesce("text", F.lit("")))).alias("paragraph", "content"))
    return each.where(F.length(F.trim("content")) >= ingest.LEAST).withColumn("paragraph", F.col("paragraph").cast("long"))


def _sql_safety(unsafe: dict[str, list[str]]) -> str:
    """category:reason:risk of the first rule that text breaks; mid is its middle character in order."""
    out = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{c}:{w}:1.0'" for c, ws in unsafe.items() for w in ws)
    out += r" WHEN length(text) < 10 THEN 'quality:too short:0.3' WHEN length(text) > 100000 THEN 'quality:too long:0.2' WHEN length(text) > 50 AND (length(text) - length(replace(text, mid, ''))) / length(text) > 0.5 AND mid NOT IN (' ', chr(10)) THEN 'spam:one character:0.6'"
    return out + r" WHEN length(text) > 20 AND length(regexp_replace(text, '[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g')) / length(text) < 0.6 THEN 'quality:unprintable:0.5' WHEN len(regexp_extract_all(text, 'https?://[^ \t\n\x0b\x0c\r]+')) > 5 THEN 'spam:links:0.7' END"


MIDDLE = "(SELECT *, list_sort(string_split(text, ''))[len(string_split(text, '')) // 2 + 1] AS mid FROM documents)"


@query(f"SELECT doc_id, {_sql_safety(SAMPLE_UNSAFE)} AS verdict FROM {MIDDLE}")
def safety_cascade(documents: DataFrame) -> DataFrame:
    v = X.safety(F.col("text"), SAMPLE_UNSAFE)
    return documents.select("doc_id", F.when(v.isNotNull(), F.concat_ws(":", v["category"], v["reason"], v["risk"].cast("string"))).alias("verdict"))


@query(
    rf"""WITH d AS (SELECT *, ['text', 'image', 'audio'][doc_id % 3 + 1] AS kind FROM (SELECT doc_id, coalesce(text, '') AS text, list_sort(string_split(coalesce(text, ''), ''))[len(string_split(coalesce(text, ''), '')) // 2 + 1] AS mid FROM documents)),
p AS (SELECT *, CASE kind WHEN 'image' THEN base64(encode(text)) WHEN 'audio' THEN 'data:' || CASE WHEN doc_id % 2 = 0 THEN 'audio/wav' ELSE 'image/png' END || ';base64,' || base64(encode(text)) ELSE text END AS payload FROM d),
r AS (SELECT *, CASE kind WHEN 'audio' THEN regexp_extract(payload, '^[^,]*,(.*)$', 1, 's') ELSE payload END AS raw, CASE WHEN kind = 'audio' THEN lower(regexp_extract(payload, '^data:([^;,]*)', 1)) ELSE '' END AS mime FROM p),
v AS (SELECT doc_id, kind, CASE WHEN kind = 'text' THEN {_sql_safety(SAMPLE_UNSAFE)} WHEN length(raw) < 100 THEN 'quality:too small:0.3' WHEN length(raw) > 140000000 THEN 'quality:too large:0.2'
  WHEN NOT regexp_matches(substring(raw, 1, 200), '^[A-Za-z0-9+/\s]+=*$') THEN 'quality:not base64:0.5' WHEN mime <> '' AND NOT starts_with(mime, kind || '/') THEN 'quality:other type:0.6' END AS said FROM r)
SELECT doc_id, said IS NULL AS passed, coalesce(string_split(said, ':')[-1]::DOUBLE, 0) AS risk, coalesce(string_split(said, ':')[1], '') AS category, CASE WHEN said IS NULL THEN 'pass' WHEN kind = 'text' THEN 'rule' ELSE 'media' END AS layer FROM v"""
)
def safety_dispatch(documents: DataFrame) -> DataFrame:
    """Documents as texts, as bare payloads of images, and as data URIs of sound, half of them of another type."""
    text = F.coalesce("text", F.lit(""))
    kind = F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("audio")), (F.col("doc_id") % 3 + 1).cast("int"))
    coded = F.base64(F.encode(text, "UTF-8"))
    uri = F.concat(F.lit("data:"), F.when(F.col("doc_id") % 2 == 0, "audio/wav").otherwise("image/png"), F.lit(";base64,"), coded)
    rows = documents.select("doc_id", kind.alias("kind"), F.when(kind == "image", coded).when(kind == "audio", uri).otherwise(text).alias("payload"))
    return rows.select("doc_id", X.checked(F.col("payload"), F.col("kind"), SAMPLE_UNSAFE).alias("v")).select("doc_id", "v.passed", "v.risk", "v.category", "v.layer")


@query(r"WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data:image/png;base64,' || base64(encode(html)) WHEN 1 THEN base64(encode(html)) WHEN 2 THEN html ELSE 'data:' || substring(html, 1, 50) END AS payload FROM pages), r AS (SELECT *, payload LIKE 'data:%' AS uri, CASE WHEN payload LIKE 'data:%' THEN regexp_extract(payload, '^[^,]*,(.*)$', 1, 's') ELSE payload END AS raw, CASE WHEN payload LIKE 'data:%' THEN lower(regexp_extract(payload, '^data:([^;,]*)', 1)) ELSE '' END AS mime FROM p) SELECT page_id, CASE WHEN uri AND NOT contains(payload, ',') THEN 'bad data URI' WHEN length(raw) < 100 THEN 'too small' WHEN length(raw) > 140000000 THEN 'too large' WHEN NOT regexp_matches(substring(raw, 1, 200), '^[A-Za-z0-9+/\s]+=*$') THEN 'not base64' WHEN mime <> '' AND NOT starts_with(mime, 'audio/') THEN 'other type' END AS reason FROM r")
def media_safety(pages: DataFrame) -> DataFrame:
    coded = F.base64(F.encode("html", "UTF-8"))
    payload = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("data:image/png;base64,"), coded)).when(F.col("page_id") % 4 == 1, coded).when(F.col("page_id") % 4 == 2, F.col("html")).otherwise(F.concat(F.lit("data:"), F.substring("html", 1, 50)))
    return pages.select("page_id", X.media_safety(payload, F.lit("audio"))["reason"].alias("reason"))


@query(f"SELECT doc_id, '{fixed.ASK_SFT}' || replace(substring(text, 1, 80), chr(10), ' ') AS instruction, substring(text, 1, 600) AS output, coalesce(lang, 'general') AS domain, 5.5::DOUBLE AS annot_score FROM documents")
def annotate_sft(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.annotate_sft(F.col("text"), F.col("lang")).alias("s")).select("doc_id", "s.instruction", "s.output", "s.domain", "s.annot_score")


@query(f"SELECT doc_id, '{fixed.ASK_DPO}' || replace(substring(text, 1, 80), chr(10), ' ') AS prompt, substring(text, 1, 400) AS chosen, '{fixed.REFUSAL}' AS rejected FROM documents")
def annotate_dpo(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.annotate_dpo(F.col("text")).alias("s")).select("doc_id", "s.prompt", "s.chosen", "s.rejected")


CHUNKS = f"SELECT doc_id, (c / 512)::INT AS chunk, array_to_string(w[c + 1 : c + 512], ' ') AS chunk_text, least(512, len(w) - c)::INT AS token_count FROM (SELECT doc_id, w, unnest(range(0, len(w), 512)) AS c FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE length(text) >= 50))"


@query(f"SELECT doc_id, chunk, md5(chunk_text) AS digest, token_count FROM ({CHUNKS})")
def chunk_pretrain(documents: DataFrame) -> DataFrame:
    return X.chunks(documents.select("doc_id", "text")).select("doc_id", "chunk", F.md5("chunk_text").alias("digest"), "token_count")


@query(f"SELECT doc_id, len({WORDS.format('substring(text, 1, 3000)')})::INT AS tokens FROM documents")
def token_count(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, CASE WHEN length(text) / 100.0::DOUBLE >= 9 THEN 'platinum' WHEN length(text) / 100.0::DOUBLE >= 7 THEN 'gold' WHEN length(text) / 100.0::DOUBLE >= 5 THEN 'silver' ELSE 'rejected' END AS tier, CASE WHEN length(text) / 100.0::DOUBLE >= 8.5 THEN 'platinum' WHEN length(text) / 100.0::DOUBLE >= 7 THEN 'gold' WHEN length(text) / 100.0::DOUBLE >= 5 THEN 'silver' ELSE 'rejected' END AS market_tier FROM conversations")
def tiers(conversations: DataFrame) -> DataFrame:
    s = F.length("text") / 100.0
    return conversations.select("conv_id", "turn", R.tier(s).alias("tier"), R.tier(s, (8.5, 7.0, 5.0)).alias("market_tier"))


PAIRED = "SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS reply FROM conversations"


def _paired(conversations: DataFrame) -> DataFrame:
    reply = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), reply.alias("reply"))


SETS = "list_distinct(string_split(substring({0}, 1, 200), ''))"


@query(f"WITH p AS (SELECT *, length(text) % 10 / 1.0::DOUBLE AS a, length(reply) % 10 / 1.0::DOUBLE AS b, {SETS.format('text')} AS x, {SETS.format('reply')} AS y FROM ({PAIRED})), q AS (SELECT *, text <> '' AND reply <> '' AND len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) >= 0.5 AS agreed FROM p) SELECT conv_id, turn, CASE WHEN agreed AND b > a THEN reply ELSE text END AS text, CASE WHEN agreed THEN round((a + b) / 2, 2) ELSE a END AS score, agreed FROM q")
def vote_merge(conversations: DataFrame) -> DataFrame:
    score = lambda c: (F.length(c) % 10).cast("double")
    v = X.vote({"text": F.col("text"), "score": score("text")}, {"text": F.col("reply"), "score": score("reply")})
    return _paired(conversations).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.text", "v.score", "v.agreed")


def _sql_qc(i: str, o: str) -> str:
    asked, given = f"list_distinct({WORDS.format(f'substring({i}, 1, 50)')})", f"list_distinct({WORDS.format(o)})"
    starts = " OR ".join(f"starts_with({i}, '{v}')" for v in fixed.VERBS)
    parts = [
        f"CASE WHEN length({i}) = 0 THEN 0.0::DOUBLE WHEN length({i}) < 5 THEN 3.0 ELSE least(9.5, 5.0::DOUBLE + length({i}) / 40) END",
        f"CASE WHEN length({o}) < 10 THEN 1.0::DOUBLE WHEN length({o}) < 50 THEN 4.0 WHEN length({o}) < 200 THEN 6.5 WHEN length({o}) < 800 THEN 8.0 ELSE 8.5 END",
        f"CASE WHEN regexp_matches({i} || {o}, '[\\x{{4e00}}-\\x{{9fff}}a-zA-Z]') THEN 7.5::DOUBLE ELSE 2.0 END",
        f"CASE WHEN {starts} OR suffix({i}, '？') OR suffix({i}, '?') THEN 8.0::DOUBLE ELSE 6.0 END",
        f"least(9.0::DOUBLE, 5.0::DOUBLE + 10.0::DOUBLE * len(list_intersect({asked}, {given})) / greatest(len({asked}), 1))",
        "7.0::DOUBLE",
    ]
    return f"({' + '.join(f'({p})' for p in parts)}) / 6"


@query(f"WITH q AS (SELECT conv_id, turn, text AS i, reply AS o, round(round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, ({_sql_qc('text', 'reply')}) * 0.6::DOUBLE + 5.5::DOUBLE * 0.4::DOUBLE)), 9), 2) AS s FROM ({PAIRED})) SELECT conv_id, turn, CASE WHEN i = '' THEN 0 ELSE s END AS qc_score, i <> '' AND s >= 5 AND length(i) >= 5 AND length(o) >= 10 AS passed FROM q")
def qc_sft(conversations: DataFrame) -> DataFrame:
    return _paired(conversations).select("conv_id", "turn", X.qc_sft(F.col("text"), F.col("reply"), F.lit(5.5)).alias("q")).select("conv_id", "turn", "q.qc_score", "q.passed")


ALL = "list_distinct(string_split({0}, ''))"


@query(f"WITH p AS (SELECT *, {ALL.format('text')} AS x, {ALL.format('reply')} AS y FROM ({PAIRED})), s AS (SELECT conv_id, turn, text = '' OR reply = '' AS e, CASE WHEN text = '' OR reply = '' THEN 0.0::DOUBLE ELSE 5.0::DOUBLE - (text = reply)::INT - (len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) > 0.9)::INT END AS qc_score FROM p) SELECT conv_id, turn, qc_score, NOT e AND qc_score >= 5 AS passed FROM s")
def qc_dpo(conversations: DataFrame) -> DataFrame:
    return _paired(conversations).select("conv_id", "turn", X.qc_dpo(F.lit("?"), F.col("text"), F.col("reply"), F.lit(5.0)).alias("q")).select("conv_id", "turn", "q.qc_score", "q.passed")


GRAMS = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))"


@query(f"WITH c AS (SELECT *, {WORDS.format('chunk_text')} AS w FROM ({CHUNKS})) SELECT doc_id, chunk, round(7.0::DOUBLE - CASE WHEN length(chunk_text) < 50 THEN 2.5 WHEN length(chunk_text) < 100 THEN 1.0 ELSE 0 END - CASE WHEN token_count < 10 THEN 1.5 ELSE 0 END - CASE WHEN len(w) > 20 AND len(list_distinct({GRAMS})) / (len(w) - 4) < 0.5 THEN 2.0 ELSE 0 END, 2)::DOUBLE AS qc_score FROM c")
def qc_pretrain(documents: DataFrame) -> DataFrame:
    return X.chunks(documents.select("doc_id", "text")).select("doc_id", "chunk", X.qc_pretrain(F.col("chunk_text"), F.col("token_count"), F.lit(7.0))["qc_score"].alias("qc_score"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, round(avg(passed::INT), 4) AS pass_rate, round(avg(s), 2) AS avg_score FROM (SELECT lang, round(s, 2) AS s, round(s, 2) >= 7 AS passed FROM (SELECT lang, round(({_sql_qc(chr(39) + fixed.ASK_SFT + chr(39) + ' || replace(substring(text, 1, 80), chr(10), chr(32))', 'substring(text, 1, 600)')}) * 0.6::DOUBLE + 5.5::DOUBLE * 0.4::DOUBLE, 9) AS s FROM documents)) GROUP BY lang")
def qc_summary(documents: DataFrame) -> DataFrame:
    s = documents.withColumn("s", X.annotate_sft(F.col("text"), F.col("lang")))
    q = s.select("lang", X.qc_sft(F.col("s.instruction"), F.col("s.output"), F.col("s.annot_score"))["qc_score"].alias("s"))
    return q.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("s") >= 7, 1)).alias("passed"), F.round(F.avg((F.col("s") >= 7).cast("int")), 4).alias("pass_rate"), F.round(F.avg("s"), 2).alias("avg_score"))


def _sql_density(words: list[str]) -> str:
    n = " + ".join(f"((length(text) - length(replace(text, '{w}', ''))) // {len(w)})" for w in words)
    return f"least(100.0::DOUBLE, 20.0::DOUBLE * ({n}) / (greatest(length(text), 1) / 100.0::DOUBLE))"


def _sql_share(patterns: list[str]) -> str:
    return f"100.0::DOUBLE * ({' + '.join(f'regexp_matches(text, {chr(39)}{p}{chr(39)})::INT' for p in patterns)}) / {len(patterns)}"


SCENES = {k: f"round({a}::DOUBLE * {_sql_density(SAMPLE_SCENES[k])} + {b}::DOUBLE * {_sql_share(SAMPLE_PATTERNS[k])}, 9)" for k, (a, b) in fixed.TEXT_MIX.items()}


@query(f"WITH s AS (SELECT doc_id, text, {', '.join(f'{s} AS {k}' for k, s in SCENES.items())} FROM documents), b AS (SELECT *, {_sql_best({k: k for k in SCENES})} AS best, least(1.0::DOUBLE, greatest({', '.join(SCENES)}) / 80) AS sure FROM s) SELECT doc_id, CASE WHEN length(text) < 20 OR sure < 0.08 THEN 'noise' ELSE best END AS scene, CASE WHEN length(text) < 20 OR sure < 0.08 THEN 0 ELSE round(sure, 6) END AS confidence FROM b")
def text_scene(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.text_scene(F.col("text"), SAMPLE_SCENES, SAMPLE_PATTERNS).alias("s")).select("doc_id", "s.scene", "s.confidence")


HITS = {k: _sql_hits("lower(text)", ws) for k, ws in SAMPLE_WORDS.items()}
BEST, TOP = _sql_best(HITS), f"greatest({', '.join(HITS.values())})"


@query(f"SELECT doc_id, CASE WHEN {TOP} = 0 THEN 'photo' ELSE {BEST} END AS scene, CASE WHEN {TOP} = 0 THEN 0.4::DOUBLE ELSE least(1.0::DOUBLE, {TOP} / 4.0::DOUBLE) END AS confidence FROM documents")
def image_scene(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.image_scene(F.col("text"), SAMPLE_WORDS).alias("s")).select("doc_id", "s.scene", "s.confidence")


AUDIO = HITS | {"ambient_sfx": "0.5", "noise": "0.0"}
LOUD = f"greatest({', '.join(f'({v})::DOUBLE' for v in AUDIO.values())})"


@query(f"SELECT doc_id, {_sql_best(AUDIO)} AS scene, CASE WHEN {LOUD} >= 3 THEN least(0.9::DOUBLE, 0.6::DOUBLE + {LOUD} * 0.05::DOUBLE) WHEN {LOUD} >= 2 THEN 0.6::DOUBLE WHEN {LOUD} >= 1 THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM documents")
def audio_scene(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", X.audio_scene(F.col("text"), SAMPLE_WORDS).alias("s")).select("doc_id", "s.scene", "s.confidence")


VOID = _sql_hits("lower(text)", ["token", "licensed"])
SEEN = "CASE WHEN n_chars % 100 > 55 AND n_chars % 97 >= 70 THEN 'cinematic' WHEN n_chars % 100 > 55 THEN 'sports_action' WHEN n_chars % 97 >= 75 THEN 'cinematic' WHEN n_chars % 97 >= 55 THEN 'documentary' ELSE 'vlog' END"


@query(f"WITH v AS (SELECT doc_id, {TOP} AS top, {BEST} AS best, {VOID} AS void, CASE WHEN doc_id % 3 = 0 THEN {SEEN} END AS seen FROM documents) SELECT doc_id, CASE WHEN void >= 2 THEN 'noise' WHEN top >= 2 OR (top = 1 AND seen IS NOT NULL) THEN best WHEN seen IS NOT NULL THEN seen ELSE 'vlog' END AS scene, CASE WHEN void >= 2 THEN 0.0::DOUBLE WHEN top >= 2 THEN least(1.0::DOUBLE, top / 5.0::DOUBLE) WHEN top = 1 AND seen IS NOT NULL THEN 0.6::DOUBLE WHEN seen IS NOT NULL THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END AS confidence FROM v")
def video_scene(documents: DataFrame) -> DataFrame:
    seen = F.when(F.col("doc_id") % 3 == 0, X.visual_scene(F.col("n_chars") % 100, F.col("n_chars") % 97))
    return documents.select("doc_id", X.video_scene(F.col("text"), seen, SAMPLE_WORDS, ["token", "licensed"]).alias("s")).select("doc_id", "s.scene", "s.confidence")


TOKENS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9\x{c0}-\x{24f}]+|[^\sa-zA-Z0-9\x{c0}-\x{24f}\x{4e00}-\x{9fff}]')) AS t FROM documents"


@query(f"SELECT doc_id, sum(c)::INT AS n_tokens, count(*)::INT AS n_types, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, round(count(*) / sum(c), 6) AS ttr FROM (SELECT doc_id, t, count(*) AS c FROM ({TOKENS}) GROUP BY ALL) GROUP BY doc_id")
def token_entropy(documents: DataFrame) -> DataFrame:
    return X.token_entropy(documents, "doc_id", "text")


def _sql_count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def _sql_text_scene(words: dict[str, list[str]], patterns: dict[str, list[str]]) -> str:
    """Scene of text by rule."""
    scores = {k: f"round({a}::DOUBLE * {_sql_density(words[k])} + {b}::DOUBLE * {_sql_share(patterns[k])}, 9)" for k, (a, b) in fixed.TEXT_MIX.items()}
    return f"CASE WHEN length(text) < 20 OR greatest({', '.join(scores.values())}) / 80 < 0.08 THEN 'noise' ELSE {_sql_best(scores)} END"


@query(f"WITH w AS (SELECT doc_id, length(text) AS n, len({WORDS.format('text')}) AS a, len(list_distinct({WORDS.format('lower(text)')})) AS b FROM documents) SELECT doc_id, round(0.55::DOUBLE * least(100.0::DOUBLE, 90 * (b / greatest(a, 1)) + n / 20), 4) AS entropy, 27.5::DOUBLE AS snr, round(0.55::DOUBLE * least(100.0::DOUBLE, 1.5::DOUBLE * a), 4) AS structure FROM w")
def audio_metrics(documents: DataFrame) -> DataFrame:
    return X.acoustic_features(documents.select("doc_id", "text")).drop("text")


MADE = f"SELECT doc_id, source, '{fixed.ASK_SFT}' || replace(substring(text, 1, 80), chr(10), ' ') AS i, substring(text, 1, 600) AS o FROM {MIDDLE} WHERE ({_sql_safety(fixed.UNSAFE)}) IS NULL"
SCORED = f"SELECT *, round(round(({_sql_qc('i', 'o')}) * 0.6::DOUBLE + 5.5::DOUBLE * 0.4::DOUBLE, 9), 2) AS s FROM ({MADE})"
JUDGED = f"SELECT source, s FROM (SELECT *, row_number() OVER (PARTITION BY md5(i || o) ORDER BY doc_id) AS turn FROM ({SCORED}) WHERE s >= 5) WHERE turn = 1"
FLAGSHIP = f"""WITH g AS (SELECT source, count(*) AS samples, floor((2 * sum(round(s * 100)::BIGINT) + count(*)) / (2 * count(*))::DOUBLE) / 100 AS avg_quality, sum(CASE WHEN s >= 9 THEN 3.0::DOUBLE WHEN s >= 7 THEN 2.0::DOUBLE WHEN s >= 5 THEN 1.0::DOUBLE ELSE 0 END * 1.5::DOUBLE) AS w FROM ({JUDGED}) GROUP BY source),
r AS (SELECT *, round(w / sum(w) OVER (), 6) AS ratio FROM g) SELECT source, samples, avg_quality, ratio, round(7000.0::DOUBLE * ratio, 4) AS creator_share, round(3000.0::DOUBLE * ratio, 4) AS platform_fee FROM r"""


@query(FLAGSHIP)
def flagship_production(documents: DataFrame) -> DataFrame:
    made = X.approved(X.produced(documents, "text", "lang")).withColumn("digest", F.md5(F.concat("s.instruction", "s.output")))
    first = R.latest(made.select("doc_id", "source", "tier", "q", "digest"), "digest", F.asc("doc_id"))
    weight = F.coalesce(*[F.when(F.col("tier") == k, F.lit(v)) for k, v in fixed.TIER_WEIGHT.items()], F.lit(0.0)) * fixed.KIND_WEIGHT["sft"]
    units = F.sum(F.round(F.col("q.qc_score") * 100).cast("long"))  # whole, so that no order of rows matters
    mean = F.floor((2 * units + F.count("*")) / (2 * F.count("*"))) / 100
    each = first.groupBy("source").agg(F.count("*").alias("samples"), mean.alias("avg_quality"), F.sum(weight).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy())  # over one small row for each source
    share = each.withColumn("total", total).where("total > 0").withColumn("ratio", F.round(F.col("amount") / F.col("total"), 6))
    pool = F.round(F.lit(10_000 * 0.70), 4)
    return share.select("source", "samples", "avg_quality", "ratio", F.round(pool * F.col("ratio"), 4).alias("creator_share"), F.round(F.lit(10_000 * 0.30) * F.col("ratio"), 4).alias("platform_fee"))
