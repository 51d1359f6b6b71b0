"""Catalogue: measures of documents with their vectors: distance, contribution, anchors, and fused streams.

A document's vector is the one with its number; a document without one counts as in an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions import fixed
from loamworks.functions.vectors import cosine
from loamworks.operators import media as M
from loamworks.operators import texts as X
from loamworks.operators import valuation as V
from loamworks.plans.media import _sql_said
from loamworks.plans.texts import TOKENS, WORDS, _sql_best, _sql_count, _sql_density, _sql_hits, _sql_share, _sql_text_scene
from loamworks.plans.values import NEAR, _sql_shapley
from loamworks.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Distance and contribution of a document without neighbours.
AWAY, SHAPLEY = 0.88, 75.0


def query(sql: str):
    """Registers a query over named tables: its parameters are the tables."""

    def register(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_table(spark, sf_dir, n) for n in names])
        SQL[f.__name__] = sql
        return f

    return register


def _all(sql: str) -> str:
    """SQL about the query vectors, for all vectors."""
    return sql.replace("q.vec_id % 100 = 0 AND ", "").replace(" WHERE e.vec_id % 100 = 0", "")


SCORES = f"""SELECT query, away, score FROM (SELECT query, round(greatest(0.05::DOUBLE, least(0.98::DOUBLE, avg(distance) / 2)), 4) AS away FROM ({_all(NEAR)}) WHERE rank <= 5 GROUP BY query)
  JOIN ({_all(_sql_shapley("1.0::DOUBLE / (rank + 1)"))}) USING (query)"""


def _scored(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """documents with away and shapley, from the neighbours of their vectors among all."""
    scores = V.shapley_scores(embeddings, embeddings, keep=(V.scarcity(F.col("near")).alias("away"),))
    both = scores.select(F.col("query").alias("doc_id"), "away", F.col("score").alias("shapley"))
    out = documents.join(both, "doc_id", "left")
    return out.withColumns({"away": F.coalesce("away", F.lit(AWAY)), "shapley": F.coalesce("shapley", F.lit(SHAPLEY))})


METRICS = rf"""WITH t AS (SELECT doc_id, sum(c) AS n, count(*) / sum(c) AS ttr, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM (SELECT doc_id, t, count(*) AS c FROM ({TOKENS}) GROUP BY ALL) GROUP BY doc_id),
s AS (SELECT doc_id, text, coalesce(n, 1) AS total, coalesce(ttr, 0) AS ttr, coalesce(round(bits, 6), 0) AS bits, {_sql_text_scene(fixed.TEXT_WORDS, fixed.TEXT_PATTERNS)} AS scene FROM documents LEFT JOIN t USING (doc_id)),
m AS (SELECT doc_id, scene, least(100::DOUBLE, bits / 8 * 100) AS e,
  least(100::DOUBLE, CASE scene WHEN 'medical_sft' THEN 800 * {_sql_density(fixed.TEXT_WORDS['medical_sft'])} * length(text) / 2000 / total WHEN 'legal_doc' THEN 600 * {_sql_density(fixed.TEXT_WORDS['legal_doc'])} * length(text) / 2000 / total
    WHEN 'code_tech' THEN 500 * {_sql_count(r"(?m)^\s*(?:#|//|/\*)")} / len(string_split(text, chr(10))) WHEN 'creative' THEN 120 * round(ttr, 6)
    WHEN 'chat_qa' THEN CASE WHEN regexp_matches(text, '[问Q][：:]') AND regexp_matches(text, '[答A][：:]') THEN 80 ELSE 35 END ELSE 20 END) AS r,
  least(100::DOUBLE, CASE scene WHEN 'legal_doc' THEN 10 * {_sql_count(r"第[一二三四五六七八九十百\d]+条")} + 5 * {_sql_count("[甲乙]方")}
    WHEN 'code_tech' THEN 12 * ({_sql_count(r"(?:def|function|func)\s+\w+\s*\(")} + 2 * {_sql_count(r"class\s+\w+")})
    ELSE 450 * len(list_distinct(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'))) / total END) AS u FROM s),
f AS (SELECT doc_id, scene, CASE WHEN e < 25 OR u < 8 THEN e * 0.12::DOUBLE ELSE e END AS e, CASE WHEN e < 25 OR u < 8 THEN r * 0.15::DOUBLE ELSE r END AS r, CASE WHEN e < 25 OR u < 8 THEN u * 0.12::DOUBLE ELSE u END AS u FROM m),
c AS (SELECT *, greatest(15::DOUBLE, least(100::DOUBLE, 0.45::DOUBLE * u + 38.5::DOUBLE * coalesce(away, 0.88::DOUBLE))) AS c, coalesce(score, 75::DOUBLE) AS shap FROM f LEFT JOIN ({SCORES}) ON query = doc_id)
SELECT doc_id, scene, round(round(e, 6), 1) AS entropy, round(round(r, 6), 1) AS snr, round(round(u, 6), 1) AS structure, round(round(c, 6), 1) AS scarcity,
  round(round(least(100::DOUBLE, 0.25::DOUBLE * e + 0.35::DOUBLE * c + 0.25::DOUBLE * shap + 7.5::DOUBLE), 6), 1) AS llm_value, round(round(shap, 6), 1) AS shapley FROM c"""


@query(METRICS)
def text_metrics(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    return X.text_metrics(_scored(documents, embeddings), "doc_id", "text", F.col("away"), F.col("shapley"))


FILM = f"""f0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(away, 0.88::DOUBLE) AS away, coalesce(score, 75::DOUBLE) AS shap FROM documents LEFT JOIN ({SCORES}) ON query = doc_id),
f1 AS (SELECT *, length(text) AS n, len(list_distinct({WORDS.format('text')})) / greatest(len({WORDS.format('text')}), 1) AS kinds,
  {_sql_hits('lower(text)', M.VIDEO_HIGH)} AS high, {_sql_hits('lower(text)', M.VIDEO_LOW)} AS low, {_sql_hits('lower(text)', M.VIDEO_SCENE)} AS seen FROM f0),
f2 AS (SELECT *, 0.55::DOUBLE * least(100::DOUBLE, kinds * 130 + n * 0.04::DOUBLE) AS e, 0.55::DOUBLE * greatest(20::DOUBLE, least(100::DOUBLE, 55 + 6 * high - 8 * low)) AS r,
  0.55::DOUBLE * least(100::DOUBLE, 45 + 5 * seen + 30 * kinds) AS u, greatest(15::DOUBLE, least(100::DOUBLE, away * 90)) AS c FROM f1),
film AS (SELECT doc_id, text, away, shap, round(round(e, 6), 1) AS entropy, round(round(r, 6), 1) AS snr, round(round(u, 6), 1) AS structure, round(round(c, 6), 1) AS scarcity,
  round(round(0.15::DOUBLE * (e + r + u + c + shap), 6), 1) AS llm_value, round(round(shap, 6), 1) AS shapley FROM f2)"""


@query(f"WITH {FILM} SELECT doc_id, entropy, snr, structure, scarcity, llm_value, shapley FROM film")
def video_metrics(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    rows = _scored(documents, embeddings)
    return rows.select("doc_id", M.video_metrics(F.coalesce("text", F.lit("")), F.col("away"), F.col("shapley")).alias("m")).select("doc_id", "m.*")


SHARE = {"entropy": 0.55, "snr": 0.55, "structure": 0.50, "scarcity": 0.70, "llm_value": 0.60, "shapley": 0.65}
TABLE = lambda values: f"CASE scene {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items())} END"


@query(
    f"""WITH {FILM},
a1 AS (SELECT doc_id, away, shap, {_sql_best(_sql_said(fixed.AUDIO_WORDS))} AS scene, round(0.55::DOUBLE * least(100.0::DOUBLE, 90 * (len(list_distinct({WORDS.format('lower(text)')})) / greatest(len({WORDS.format('text')}), 1)) + length(text) / 20), 4) AS entropy,
  27.5::DOUBLE AS snr, round(0.55::DOUBLE * least(100.0::DOUBLE, 1.5::DOUBLE * len({WORDS.format('text')})), 4) AS structure FROM film WHERE doc_id % 2 = 0),
a2 AS (SELECT *, least(100::DOUBLE, greatest(15::DOUBLE, least(100::DOUBLE, away * 85)) + {TABLE(M.AUDIO_BONUS)}) AS rare, {TABLE(M.AUDIO_BASE)} AS b FROM a1),
a3 AS (SELECT doc_id, entropy, snr, structure, round(rare, 1) AS scarcity,
  round(least(100::DOUBLE, (0.40::DOUBLE * b + 0.25::DOUBLE * b * snr / 100 + 0.15::DOUBLE * b * structure / 100 + 0.10::DOUBLE * rare + 0.10::DOUBLE * shap) * 0.8::DOUBLE), 1) AS llm_value, shap AS shapley FROM a2)
SELECT film.doc_id, {', '.join(f"coalesce(floor(round(least(100::DOUBLE, film.{d} * {w}::DOUBLE + a3.{d} * (1 - {w}::DOUBLE)) * 10, 5) + 0.5) / 10, film.{d}) AS {d}" for d, w in SHARE.items())} FROM film LEFT JOIN a3 USING (doc_id)"""
)
def stream_fusion(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Documents as descriptions of films, every second one with a sound track: measures of both, fused."""
    counted = X.said(documents.select("doc_id", "text").withColumn("length", F.coalesce(F.length("text"), F.lit(0))), "text", M.VIDEO_WORDS | fixed.AUDIO_WORDS)
    rows = _scored(counted, embeddings)
    film = M.video_measured(F.col("n_kinds") / F.greatest("n_words", F.lit(1)), F.col("length"), F.col("hits"), F.col("away"), F.col("shapley"))
    scene = X.audio_best({k: F.col(f"hits.{k}") for k in fixed.AUDIO_WORDS})["scene"]
    heard = rows.select("doc_id", "away", "shapley", film.alias("film"), scene.alias("scene"), *[c.alias(k) for k, c in X.acoustic(F.col("n_words"), F.col("n_low"), F.col("length")).items()])
    value = M.audio_value(F.col("entropy"), F.col("snr"), F.col("structure"), F.col("scene"), F.col("away"), F.col("shapley"))
    heard = heard.withColumn("value", value)
    sound = F.col("doc_id") % 2 == 0
    own = {"scarcity": F.col("value.scarcity"), "llm_value": F.col("value.llm_value")}
    audio = {d: F.when(sound, own.get(d, F.col(d))) for d in fixed.DIMENSIONS}
    return heard.select("doc_id", *[c.alias(d) for d, c in V.fused({d: F.col(f"film.{d}") for d in fixed.DIMENSIONS}, audio).items()])


ANCHORED = list(fixed.TEXT_MIX)
RULES = {k: f"round({a}::DOUBLE * {_sql_density(fixed.TEXT_WORDS[k])} + {b}::DOUBLE * {_sql_share(fixed.TEXT_PATTERNS[k])}, 9)" for k, (a, b) in fixed.TEXT_MIX.items()}


@query(
    f"""WITH p AS (SELECT label, list(x ORDER BY i) AS p FROM (SELECT label % 5 AS label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
n AS (SELECT vec_id, list((list_cosine_similarity(embedding::DOUBLE[], p) + 1) / 2 * 100 ORDER BY p.label) AS near FROM embeddings, p GROUP BY vec_id),
r AS (SELECT doc_id, text, near, [{', '.join(RULES.values())}] AS rules FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) LEFT JOIN n ON vec_id = doc_id),
m AS (SELECT *, least(1::DOUBLE, list_max(rules) / 80) AS sure, list_transform(range(1, 6), lambda i: round(rules[i] / 100 * 0.4::DOUBLE + near[i] / greatest(list_max(near), 1e-8) * 0.6::DOUBLE, 9)) AS mixed FROM r),
d AS (SELECT *, sure >= 0.42::DOUBLE OR near IS NULL AS alone, CASE WHEN sure >= 0.42::DOUBLE OR near IS NULL THEN sure ELSE least(1::DOUBLE, list_max(mixed)) END AS conf FROM m)
SELECT doc_id, CASE WHEN length(text) < 20 OR conf < 0.08 THEN 'noise' ELSE {ANCHORED}[CASE WHEN alone THEN list_position(rules, list_max(rules)) ELSE list_position(mixed, list_max(mixed)) END] END AS scene,
  CASE WHEN length(text) < 20 OR conf < 0.08 THEN 0 ELSE round(conf, 6) END AS confidence, CASE WHEN length(text) < 20 OR conf < 0.08 THEN 'noise' WHEN alone THEN 'rule' ELSE 'hybrid' END AS method FROM d"""
)
def fused_scene(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Scenes by rule and by how near a document's vector is to the mean of each of five groups of vectors, as anchors."""
    each = embeddings.select((F.col("label") % 5).alias("label"), F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
    table = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda s: s["p"]).alias("anchors"))  # five rows
    near = embeddings.join(F.broadcast(table)).select(F.col("vec_id").alias("doc_id"), F.transform("anchors", lambda p: (cosine(F.col("embedding"), p) + 1) / 2 * 100).alias("near"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(near, "doc_id", "left")
    anchors: dict[str, Column] = {k: F.get("near", F.lit(i)) for i, k in enumerate(ANCHORED)}
    return rows.select("doc_id", X.fused_text_scene(F.col("text"), anchors).alias("s")).select("doc_id", "s.scene", "s.confidence", "s.method")
