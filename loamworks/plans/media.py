"""Catalogue: measures of images, audio and video over feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.operators import media as M
from loamworks.plans.texts import WORDS, _sql_best, _sql_hits, _sql_text_scene
from loamworks.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

FEATURES = ("zcr", "rms", "hnr", "chroma", "beat")
SCALE = (0.5, 0.1, 3.0, 0.2, 1.0)


def query(table: str, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(read_table(spark, sf_dir, table))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _features(embeddings):
    """Sound features made from vectors, for want of sound."""
    return embeddings.select("vec_id", *[F.round(F.abs(F.col("embedding")[i].cast("double")) * 4 * s, 6).alias(n) for i, (n, s) in enumerate(zip(FEATURES, SCALE, strict=True))])


MADE = "SELECT vec_id, " + ", ".join(f"round(abs(embedding[{i + 1}]::DOUBLE) * 4 * {s}::DOUBLE, 6) AS {n}" for i, (n, s) in enumerate(zip(FEATURES, SCALE, strict=True))) + " FROM embeddings"
NOISE, MUSIC, CALM, SPEECH = "(rms < 0.005 OR (zcr > 0.35 AND hnr < 0.5))", "(chroma > 0.05 AND beat > 0.2 AND hnr > 1.5)", "(zcr < 0.05 AND chroma < 0.03 AND rms > 0.01)", "(zcr BETWEEN 0.02 AND 0.25 AND hnr > 0.8)"


@query("embeddings", f"SELECT vec_id, CASE WHEN {NOISE} THEN 'noise' WHEN {MUSIC} THEN 'music_original' WHEN {CALM} THEN 'ambient_sfx' WHEN {SPEECH} THEN 'speech_edu' ELSE 'ambient_sfx' END AS scene, CASE WHEN {NOISE} THEN 0.88::DOUBLE WHEN {MUSIC} THEN round(least(0.95::DOUBLE, 0.6::DOUBLE + chroma * 5), 3) WHEN {CALM} THEN 0.72::DOUBLE WHEN {SPEECH} THEN round(least(0.82::DOUBLE, 0.55::DOUBLE + hnr * 0.08::DOUBLE), 3) ELSE 0.45::DOUBLE END AS confidence FROM ({MADE})")
def acoustic_scene(embeddings):
    a = M.acoustic_scores(*[F.col(f) for f in FEATURES])
    best = F.array(*map(F.lit, M.AUDIO_SCENES))[(F.array_position(a["scores"], F.array_max(a["scores"])) - 1).cast("int")]
    return _features(embeddings).select("vec_id", best.alias("scene"), a["confidence"].alias("confidence"))


def _sql_list(values) -> str:
    return f"[{', '.join(values)}]::DOUBLE[]"


def _sql_said(words: dict) -> dict[str, str]:
    """Words of each audio scene in the lower-cased text."""
    return {s: _sql_hits("lower(text)", words[s]) if s in words else "0.5" if s == "ambient_sfx" else "0.0" for s in M.AUDIO_SCENES}


TALK = [f"(5.0::DOUBLE + hnr * 0.5::DOUBLE) * {w}::DOUBLE" if w else "0" for w in (0.40, 0.35, 0.60, 0, 0, 0)]
HEARD = f"""CASE WHEN {NOISE} THEN {_sql_list(['0'] * 5 + ['10'])} WHEN {MUSIC} THEN {_sql_list(['0'] * 3 + ['least(10::DOUBLE, 0.6::DOUBLE + chroma * 5 + beat * 0.3::DOUBLE)', '0', '0'])}
  WHEN {CALM} THEN {_sql_list(['0'] * 4 + ['7.2', '0'])} WHEN {SPEECH} THEN {_sql_list(TALK)} ELSE {_sql_list(['0'] * 4 + ['4.5', '0'])} END"""
SURE = f"CASE WHEN {NOISE} THEN 0.88::DOUBLE WHEN {MUSIC} THEN round(least(0.95::DOUBLE, 0.6::DOUBLE + chroma * 5), 3) WHEN {CALM} THEN 0.72::DOUBLE WHEN {SPEECH} THEN round(least(0.82::DOUBLE, 0.55::DOUBLE + hnr * 0.08::DOUBLE), 3) ELSE 0.45::DOUBLE END"
FUSED = f"""WITH f AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 'court hearing with attorney' ELSE 'guitar song' END AS text FROM ({MADE})),
a AS (SELECT vec_id, {HEARD} AS heard, {SURE} AS sure, {_sql_list(_sql_said(fixed.AUDIO_WORDS).values())} AS said FROM f),
b AS (SELECT *, list_max(said) AS loud, list_transform(range(1, 7), lambda i: round(heard[i] / greatest(list_max(heard), 1e-8) * 0.65::DOUBLE + said[i] / greatest(list_max(said), 1e-8) * 0.35::DOUBLE, 9)) AS mixed FROM a),
c AS (SELECT *, CASE WHEN loud >= 3 THEN least(0.9::DOUBLE, 0.6::DOUBLE + loud * 0.05::DOUBLE) WHEN loud >= 2 THEN 0.6::DOUBLE WHEN loud >= 1 THEN 0.45::DOUBLE ELSE 0.3::DOUBLE END AS told FROM b)
SELECT vec_id, [{', '.join(f"'{s}'" for s in M.AUDIO_SCENES)}][list_position(mixed, list_max(mixed))] AS scene, CASE WHEN sure > 0.85 THEN sure ELSE round(0.65::DOUBLE * sure + 0.35::DOUBLE * told, 3) END AS confidence, CASE WHEN sure > 0.85 THEN 'acoustic' ELSE 'fusion' END AS method FROM c"""


@query("embeddings", FUSED)
def audio_fusion(embeddings):
    said = F.when(F.col("vec_id") % 2 == 0, "court hearing with attorney").otherwise("guitar song")
    f = M.audio_fusion(said, M.acoustic_scores(*[F.col(x) for x in FEATURES]))
    return _features(embeddings).select("vec_id", f.alias("f")).select("vec_id", "f.scene", "f.confidence", "f.method")


@query("embeddings", f"WITH m AS (SELECT vec_id, zcr * 16 AS e, hnr / 3 AS r, beat AS d, chroma * 5 AS c FROM ({MADE})), x AS (SELECT vec_id, least(100.0::DOUBLE, e / 8 * 100) AS entropy, greatest(0, least(100::DOUBLE, 50.0::DOUBLE + d * 15 + c * 10)) AS snr, least(100.0::DOUBLE, r * 50 + d * 50) AS structure FROM m) SELECT vec_id, round(round(entropy, 9), 1) AS entropy, round(round(snr, 9), 1) AS snr, round(round(structure, 9), 1) AS structure, round(round(greatest(15::DOUBLE, least(100::DOUBLE, structure * 0.35::DOUBLE + 0.4::DOUBLE * 45.5::DOUBLE)), 9), 1) AS scarcity FROM x")
def image_metrics(embeddings):
    c, no = F.col, F.lit(False)
    m = M.image_metrics(c("zcr") * 16, c("hnr") / 3, c("beat"), c("chroma") * 5, F.lit(50.0), F.lit(0.4), F.lit(50.0), no, no, no)
    return _features(embeddings).select("vec_id", m.alias("m")).select("vec_id", "m.entropy", "m.snr", "m.structure", "m.scarcity")


@query("embeddings", "WITH f AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings) SELECT label, count(*) AS frames, round(coalesce(avg((1 - list_cosine_similarity(embedding::DOUBLE[], before::DOUBLE[]) >= 0.9)::INT), 0), 6) AS cuts FROM f GROUP BY label")
def scene_cuts(embeddings):
    return M.cut_density(embeddings, "label", "vec_id", "embedding", 0.9)


@query("embeddings", "SELECT vec_id, round(-list_sum(list_transform(list_filter(h, lambda x: x > 0), lambda x: x / list_sum(h) * log2(x / list_sum(h)))), 6) AS bits FROM (SELECT vec_id, list_transform(embedding, lambda x: round(abs(x::DOUBLE), 6)) AS h FROM embeddings)")
def histogram_entropy(embeddings):
    h = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 6))
    return embeddings.select("vec_id", F.round(M.histogram_entropy(h), 6).alias("bits"))


@query("embeddings", "SELECT vec_id, round(100 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)), 6) AS score FROM embeddings")
def aesthetic(embeddings):
    return embeddings.select("vec_id", F.round(M.aesthetic(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")), 6).alias("score"))


@query("documents", "SELECT doc_id, round(least(100.0::DOUBLE, 60 + least(15.0::DOUBLE, length(text) / 50)), 6) AS llm_value, least(100.0::DOUBLE, 27.5::DOUBLE * 1.1::DOUBLE + 5) AS snr FROM documents WHERE text <> ''")
def transcript_bonus(documents):
    b = M.transcript_bonus(F.lit(60.0), F.lit(27.5), F.col("text"))
    return documents.where("text <> ''").select("doc_id", F.round(b["llm_value"], 6).alias("llm_value"), b["snr"].alias("snr"))


def _sql_named(scene: str, table: dict) -> str:
    return f"CASE {scene} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())} ELSE 'general' END"


def _sql_hit_scene(words: dict, none: str) -> str:
    hits = {k: _sql_hits("lower(text)", ws) for k, ws in words.items()}
    return f"CASE WHEN greatest({', '.join(hits.values())}) = 0 THEN '{none}' ELSE {_sql_best(hits)} END"


FILM = {k: _sql_hits("lower(text)", ws) for k, ws in fixed.VIDEO_WORDS.items()}
ROUTED = f"""WITH r AS (SELECT doc_id, ['text', 'image', 'audio', 'video'][doc_id % 4 + 1] AS modality, coalesce(text, '') AS text FROM documents)
SELECT doc_id, modality, CASE WHEN doc_id % 7 = 0 THEN 'photo' WHEN modality = 'image' THEN {_sql_hit_scene(fixed.IMAGE_WORDS, 'photo')}
  WHEN modality = 'audio' THEN {_sql_named(_sql_best(_sql_said(fixed.AUDIO_WORDS)), M.AUDIO_TO_TEXT)}
  WHEN modality = 'video' THEN CASE WHEN {_sql_hits('lower(text)', fixed.VIDEO_NOISE)} >= 2 THEN 'noise' WHEN greatest({', '.join(FILM.values())}) >= 2 THEN {_sql_best(FILM)} ELSE 'vlog' END
  ELSE {_sql_text_scene(fixed.TEXT_WORDS, fixed.TEXT_PATTERNS)} END AS scene, CASE WHEN doc_id % 7 = 0 THEN 1.0::DOUBLE END AS confidence FROM r"""


@query("documents", ROUTED)
def modality_routing(documents):
    kind = F.element_at(F.array(*map(F.lit, ("text", "image", "audio", "video"))), (F.col("doc_id") % 4 + 1).cast("int"))
    given = F.when(F.col("doc_id") % 7 == 0, "photo")
    return documents.select("doc_id", kind.alias("modality"), M.scene_of(kind, F.coalesce("text", F.lit("")), given).alias("s")).select("doc_id", "modality", "s.scene", "s.confidence")


@query("events", "SELECT user_id % 20 AS job, event_type AS stage, round(epoch(max(ts) FILTER (WHERE event_id % 2 = 1)) - epoch(max(ts) FILTER (WHERE event_id % 2 = 0)), 2) AS seconds, round(sum((value > 90)::INT) * 100.0::DOUBLE / count(*), 1) AS failed_pct FROM events GROUP BY ALL")
def stage_runs(events):
    marks = events.select((F.col("user_id") % 20).alias("job"), F.col("event_type").alias("stage"), "ts", F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), F.lit(1).alias("rows_in"), (F.col("value") > 90).cast("int").alias("failed"))
    return M.stage_runs(marks, "job", "stage", "ts", "kind")


@query("events", "SELECT event_type, CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 50 WHEN 'purchase' THEN 100 ELSE 0 END::INT AS percent, count(*) AS n FROM events GROUP BY ALL")
def job_progress(events):
    stage = F.when(F.col("event_type") == "view", "safety").when(F.col("event_type") == "click", "annotation").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.first(M.progress(stage)).alias("percent"))
