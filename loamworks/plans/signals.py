"""Catalogue: waves, images and films made of the documents' bytes, measured and fingerprinted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.operators import joins, signals
from loamworks.session import Workspace, read_table
from loamworks.sources import containers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(read_table(spark, sf_dir, "documents"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _bytes() -> Column:
    return F.coalesce("text", F.lit("")).cast("binary")


def _rounded(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query()
def wave_measures(documents: DataFrame) -> DataFrame:
    files = documents.select("doc_id", containers.wav_payload(_bytes(), 8000).alias("payload"))
    return _rounded(signals.payload_measures(files, "payload"), signals.WAVE)


@query()
def pixel_measures(documents: DataFrame) -> DataFrame:
    images = documents.select("doc_id", containers.image_of(_bytes()).alias("image"))
    return _rounded(signals.pixel_measures(images, "image"), signals.PIXEL)


@query()
def near_images(documents: DataFrame) -> DataFrame:
    images = documents.select("doc_id", "lang", containers.image_of(_bytes()).alias("image"))
    prints = Workspace(documents.sparkSession, "prints").table(signals.pixel_measures(images, "image").select("doc_id", "lang", "print"), "prints")
    return joins.hamming_first(prints, "doc_id", F.col("print"), ["lang"])


@query()
def film_prints(documents: DataFrame) -> DataFrame:
    films = documents.select("doc_id", containers.film_payload(_bytes()).alias("payload"))
    return signals.film_prints(signals.pixel_measures(containers.frames(films, "doc_id", "payload").drop("bytes"), "image"), "doc_id")


# Of a film of n frames, two a second, the sample has min(16, max(1, n / 2)) frames; the first bytes of a frame tell them apart.
@query(
    """WITH f AS (SELECT doc_id, encode(coalesce(text, '')) AS b, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 768))::BIGINT AS n FROM documents),
s AS (SELECT *, least(16, greatest(1, n // 2))::BIGINT AS k FROM f),
p AS (SELECT *, unnest(range(k)) AS i FROM s),
q AS (SELECT *, CASE WHEN k = 1 THEN n // 2 ELSE i * (n - 1) // (k - 1) END AS place FROM p)
SELECT doc_id, place, place * 0.5::DOUBLE AS at, least(768, greatest(0, octet_length(b) - place * 768))::BIGINT AS filled FROM q"""
)
def frame_samples(documents: DataFrame) -> DataFrame:
    films = documents.select("doc_id", F.length(_bytes()).alias("n"), containers.film_payload(_bytes()).alias("payload"))
    found = containers.frames(films, "doc_id", "payload")
    known = found.select("doc_id", "place", "at", F.length("bytes").cast("long").alias("size"))
    sizes = films.select("doc_id", "n")
    filled = F.least("size", F.greatest(F.lit(0), F.col("n") - F.col("place") * F.col("size")))
    return known.join(sizes, "doc_id").select("doc_id", "place", "at", filled.cast("long").alias("filled"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'wav' WHEN doc_id % 3 = 1 THEN 'avi' END AS kind FROM documents")
def media_kinds(documents: DataFrame) -> DataFrame:
    third = F.col("doc_id") % 3
    body = F.when(third == 0, containers.wav_payload(_bytes(), 8000)).when(third == 1, containers.film_payload(_bytes())).otherwise(F.concat(F.lit(b"\1\2\3\4"), _bytes()))
    uri = F.concat(F.when(F.col("doc_id") % 2 == 0, "data:audio/wav;base64,").otherwise(""), F.base64(body))
    return containers.payloads(documents.select("doc_id", uri.alias("uri")), "uri").select("doc_id", "kind")
