"""Measures of images, audio and video from feature columns; decoding and models lie outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.functions import text as T
from loamworks.functions.vectors import cosine
from loamworks.operators import texts as X
from loamworks.operators.valuation import clamp

AUDIO_SCENES = ("speech_medical", "speech_legal", "speech_edu", "music_original", "ambient_sfx", "noise")

# Text scenes of audio and video scenes, bonuses of rare audio.
AUDIO_TO_TEXT = {"speech_medical": "medical_sft", "speech_legal": "legal_doc", "speech_edu": "chat_qa", "music_original": "creative", "ambient_sfx": "general", "noise": "noise"}
VIDEO_TO_TEXT = {"documentary": "legal_doc", "lecture": "medical_sft", "cinematic": "creative", "sports_action": "chat_qa", "vlog": "chat_qa"}
AUDIO_BONUS = {"speech_medical": 25.0, "speech_legal": 18.0, "speech_edu": 8.0, "music_original": 20.0, "ambient_sfx": 5.0, "noise": 0.0}
AUDIO_BASE = {"speech_medical": 88.0, "speech_legal": 78.0, "speech_edu": 65.0, "music_original": 60.0, "ambient_sfx": 42.0, "noise": 5.0}
VIDEO_HIGH = ["4k", "8k", "uhd", "高清", "专业", "纪录片", "电影级", "professional", "cinematic", "无损"]
VIDEO_LOW = ["模糊", "压缩", "低帧率", "480p", "blur", "compressed", "shaky", "竖屏", "手机拍"]
VIDEO_SCENE = ["教学", "演讲", "访谈", "手术", "庭审", "实验室", "tutorial", "lecture", "medical", "court", "lab"]


def lookup(scene: Column, table: dict, default=None) -> Column:
    """A table's value for a scene."""
    return F.coalesce(*[F.when(scene == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def acoustic_scores(zcr: Column, rms: Column, hnr: Column, chroma: Column, beat: Column) -> Column:
    """(scores by AUDIO_SCENES, confidence) of sound features (V-05)."""
    noise = (rms < 0.005) | ((zcr > 0.35) & (hnr < 0.5))
    music = (chroma > 0.05) & (beat > 0.2) & (hnr > 1.5)
    calm = (zcr < 0.05) & (chroma < 0.03) & (rms > 0.01)
    speech = zcr.between(0.02, 0.25) & (hnr > 0.8)
    only = lambda name, v: F.array(*[F.lit(v) if s == name and not isinstance(v, Column) else v if s == name else F.lit(0.0) for s in AUDIO_SCENES])
    base = 5.0 + hnr * 0.5
    talk = F.array(base * 0.40, base * 0.35, base * 0.60, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    scores = F.when(noise, only("noise", 10.0)).when(music, only("music_original", F.least(F.lit(10.0), 0.6 + chroma * 5 + beat * 0.3))).when(calm, only("ambient_sfx", 7.2)).when(speech, talk).otherwise(only("ambient_sfx", 4.5))
    sure = F.when(noise, 0.88).when(music, F.round(F.least(F.lit(0.95), 0.6 + chroma * 5), 3)).when(calm, 0.72).when(speech, F.round(F.least(F.lit(0.82), 0.55 + hnr * 0.08), 3)).otherwise(0.45)
    return F.struct(scores.alias("scores"), sure.alias("confidence"))


def audio_fusion(text: Column, acoustic: Column | None, words: dict = fixed.AUDIO_WORDS) -> Column:
    """Scene, confidence and method from a description's words and, where there are any, sound scores (V-06, J-15)."""
    t = F.lower(text)
    said = F.array(*[T.hits(t, words[s]).cast("double") if s in words else F.lit(0.5 if s == "ambient_sfx" else 0.0) for s in AUDIO_SCENES])
    alone = X.audio_scene(text, words)
    if acoustic is None:
        return F.struct(alone["scene"].alias("scene"), alone["confidence"].alias("confidence"), F.lit("text_proxy").alias("method"))
    share = lambda a: F.transform(a, lambda x: x / F.greatest(F.array_max(a), F.lit(1e-8)))
    both = F.zip_with(share(acoustic["scores"]), share(said), lambda a, b: F.round(a * 0.65 + b * 0.35, 9))
    scene = T.let(both, lambda b: F.array(*map(F.lit, AUDIO_SCENES))[(F.array_position(b, F.array_max(b)) - 1).cast("int")])
    sure = acoustic["confidence"] > 0.85
    heard = F.struct(scene.alias("scene"), F.when(sure, acoustic["confidence"]).otherwise(F.round(0.65 * acoustic["confidence"] + 0.35 * alone["confidence"], 3)).alias("confidence"), F.when(sure, "acoustic").otherwise("fusion").alias("method"))
    return F.when(acoustic["confidence"].isNotNull(), heard).otherwise(F.struct(alone["scene"].alias("scene"), alone["confidence"].alias("confidence"), F.lit("text_proxy").alias("method")))


def histogram_entropy(histogram: Column) -> Column:
    """Bits of a numeric histogram (A-32)."""
    total = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, -F.aggregate(histogram, F.lit(0.0), lambda s, x: s + F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))).otherwise(0.0)


def image_metrics(entropy: Column, resolution: Column, edges: Column, colours: Column, base: Column, away: Column, shapley: Column, rare: Column, fine: Column, poor: Column) -> Column:
    """Measures of an image without a vision model; null features stand for no image (V-09)."""
    e = F.least(F.lit(100.0), F.coalesce(entropy, F.lit(3.0)) / 8 * 100)
    snr = base + F.when(rare, 15.0).otherwise(0.0) + F.when(fine, 10.0).otherwise(0.0) - F.when(poor, 20.0).otherwise(0.0)
    snr = clamp(snr + F.coalesce(edges * 15 + colours * 10, F.lit(0.0)), 0.0, 100.0)
    structure = F.least(F.lit(100.0), F.coalesce(resolution * 50 + edges * 50, F.lit(30.0)))
    scarcity = clamp(structure * 0.35 + away * 45.5, 15.0, 100.0)
    llm = e * 0.2 + scarcity * 0.35 + shapley * 0.25 + snr * 0.1
    return F.struct(*[F.round(F.round(v, 9), 1).alias(n) for n, v in (("entropy", e), ("snr", snr), ("structure", structure), ("scarcity", scarcity), ("llm_value", llm))])


def audio_value(entropy: Column, snr: Column, structure: Column, scene: Column, away: Column, shapley: Column, duration: float = 0.5) -> Column:
    """Scarcity and value of audio without a wave (V-10)."""
    scarcity = F.least(F.lit(100.0), clamp(away * 85, 15.0, 100.0) + lookup(scene, AUDIO_BONUS, 5.0))
    b = lookup(scene, AUDIO_BASE, 42.0)
    llm = (0.40 * b + 0.25 * b * snr / 100 + 0.15 * b * structure / 100 + 0.10 * scarcity + 0.10 * shapley) * (0.6 + 0.4 * duration)
    return F.struct(F.round(scarcity, 1).alias("scarcity"), F.round(F.least(F.lit(100.0), llm), 1).alias("llm_value"))


VIDEO_WORDS = {"high": VIDEO_HIGH, "low": VIDEO_LOW, "seen": VIDEO_SCENE}


def video_metrics(text: Column, away: Column, shapley: Column) -> Column:
    """Measures of a video by its description (V-11); its words are split and counted once."""
    unique = T.let(T.words(text), lambda w: F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))
    hits = T.let(F.lower(text), lambda t: F.struct(*[T.hits(t, ws).alias(n) for n, ws in VIDEO_WORDS.items()]))
    return T.let(F.struct(unique.alias("unique"), hits.alias("hits")), lambda s: video_measured(s["unique"], F.length(text), s["hits"], away, shapley))


def video_measured(unique: Column, length: Column, hits: Column, away: Column, shapley: Column) -> Column:
    """Measures of a video by the share of different words of its description, its characters and how many of VIDEO_WORDS it has (V-11)."""
    e = 0.55 * F.least(F.lit(100.0), unique * 130 + length * 0.04)
    snr = 0.55 * clamp(55.0 + 6.0 * hits["high"] - 8.0 * hits["low"], 20.0, 100.0)
    structure = 0.55 * F.least(F.lit(100.0), 45.0 + 5.0 * hits["seen"] + 30 * unique)
    scarcity = clamp(away * 90, 15.0, 100.0)
    llm = 0.15 * (e + snr + structure + scarcity + shapley)
    return F.struct(*[F.round(F.round(v, 6), 1).alias(n) for n, v in (("entropy", e), ("snr", snr), ("structure", structure), ("scarcity", scarcity), ("llm_value", llm), ("shapley", shapley))])


def cut_density(frames: DataFrame, video: str, order: str, vector: str, least: float) -> DataFrame:
    """Share of a video's neighbouring frames that differ by a cosine distance of least (W-08)."""
    before = F.lag(vector).over(Window.partitionBy(video).orderBy(order))
    each = frames.withColumn("__lw_away", F.when(before.isNotNull(), 1 - cosine(F.col(vector), before)))
    return each.groupBy(video).agg(F.count("*").alias("frames"), F.round(F.coalesce(F.avg((F.col("__lw_away") >= least).cast("int")), F.lit(0.0)), 6).alias("cuts"))


def aesthetic(good: Column, bad: Column) -> Column:
    """Percent of the good one of two contrasted logits (V-31)."""
    return 100 / (1 + F.exp(bad - good))


def transcript_bonus(llm: Column, snr: Column, transcript: Column) -> Column:
    """What a transcript adds to audio (V-32)."""
    has = F.coalesce(F.length(transcript) > 0, F.lit(False))
    return F.struct(F.when(has, F.least(F.lit(100.0), llm + F.least(F.lit(15.0), F.length(transcript) / 50))).otherwise(llm).alias("llm_value"), F.when(has, F.least(F.lit(100.0), snr * 1.1 + 5)).otherwise(snr).alias("snr"))


def scene_of(modality: Column, text: Column, override: Column) -> Column:
    """Scene by modality, or the one that is given (V-28, V-29)."""
    found = F.when(modality == "image", X.image_scene(text)["scene"]).when(modality == "audio", lookup(X.audio_scene(text)["scene"], AUDIO_TO_TEXT, "general")).when(modality == "video", X.video_scene(text)["scene"]).otherwise(X.text_scene(text)["scene"])
    return F.struct(F.coalesce(F.nullif(override, F.lit("")), found).alias("scene"), F.when(F.coalesce(override, F.lit("")) != "", 1.0).alias("confidence"))


def stage_runs(marks: DataFrame, job: str, stage: str, time: str, kind: str) -> DataFrame:
    """Seconds and failure percent of each stage run from its start and end rows (MO-04)."""
    at = lambda k: F.max(F.when(F.col(kind) == k, F.unix_micros(F.col(time).cast("timestamp")) / 1e6))
    each = marks.groupBy(job, stage).agg(at("start").alias("__lw_a"), at("end").alias("__lw_b"), F.sum("rows_in").alias("rows_in"), F.sum("failed").alias("failed"))
    return each.select(job, stage, F.round(F.col("__lw_b") - F.col("__lw_a"), 2).alias("seconds"), F.round(F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("rows_in")), F.lit(0.0)), 1).alias("failed_pct"))


def progress(stage: Column) -> Column:
    """Percent done by stage (MO-03)."""
    return lookup(stage, fixed.PROGRESS, 0)
