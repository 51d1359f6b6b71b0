"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most frequent n-grams in a profile, and the longest n-gram.
PROFILE = 300
LONGEST = 3
#: Different labelled texts of each language that profiles are learned from, about; chosen by digest of the text.
SAMPLE = 5_000
#: Characters counted at once; longer texts are counted in pieces.
PIECE = 1 << 18

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Per code point of the basic plane: its lower case if it is a letter, else 0."""
    if not _FOLD:
        table = np.zeros(0x10000, np.int64)
        for i in range(0x10000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                table[i] = ord(c.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every run of other characters as one 0, and a 0 at both ends.

    Characters outside the basic plane count as letters if they are such.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = _fold()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        c = chr(points[i])
        out[i] = ord(c.lower()[0]) if c.isalpha() else 0
    out = np.concatenate(([0], out, [0]))
    keep = np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))
    return out[keep]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to LONGEST characters and their counts; n-grams inside white space are left out.

    An n-gram is its code points at 21 bits each. Counts of pieces add up to those of the whole text.
    """
    points = letters(text)
    keys, counts = [], []
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + LONGEST - 1]
        for n in range(1, LONGEST + 1):
            starts = min(PIECE, len(part) - n + 1)
            if starts <= 0:
                continue
            code = np.zeros(starts, np.int64)
            for i in range(n):
                code = (code << 21) | part[i : i + starts]
            keys.append(code[code != 0])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(keys), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by code points."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language over each batch."""
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(lang, []).append(grams(text.as_py() or ""))
        for lang, found in by.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys)), "gram": pa.array(keys), "n": pa.array(sums)})


def profiles(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> dict[str, list[int]]:
    """Per language its PROFILE most frequent n-grams, most frequent first, from about sample different labelled texts of it.

    A language with fewer rows is learned from all of them, so rare ones are learned beside any number of others; the
    copies of a text count once. Texts are drawn by digest. The driver gets PROFILE numbers for each language,
    whatever the corpus. Null texts and rows without a language are left out; texts of any length are counted whole.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("share"))
    drawn = rows.withColumn("print", F.xxhash64("text")).join(F.broadcast(shares), "lang")  # a row for each language
    drawn = drawn.where(F.pmod("print", F.lit(1 << 32)) < F.col("share") * float(1 << 32))
    rows = drawn.dropDuplicates(["lang", "print"]).select("lang", "text")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(*order)
    first = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= PROFILE)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= PROFILE)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "r").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def _classifier(learned: dict[str, list[int]]):
    names = sorted(learned)
    vocabulary = np.unique(np.array([g for v in learned.values() for g in v], np.int64))
    places = np.full((len(names), len(vocabulary)), PROFILE, np.int64)
    for i, name in enumerate(names):
        places[i, np.searchsorted(vocabulary, np.array(learned[name], np.int64))] = np.arange(len(learned[name]))

    def one(text: str) -> tuple[str, float]:
        own = ranked(*grams(text))
        if not len(own) or not names:
            return "und", 0.0
        at = np.searchsorted(vocabulary, own)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == own
        rank = np.arange(len(own))
        away = np.full(len(names), (~known).sum() * PROFILE, np.float64)
        table = places[:, at[known]]
        away += np.where(table == PROFILE, PROFILE, np.abs(table - rank[known])).sum(axis=1)
        best = int(np.argmin(away))
        return names[best], float(1 - away[best] / (PROFILE * len(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["key", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learned: dict[str, list[int]], key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """Per row of docs: key, held_out, lang_pred and score, 1 less the mean out-of-place distance over the largest.

    Each text's own profile is ranked and every n-gram adds how far it is from its place in the language's profile,
    or PROFILE if it isn't there. Ties go to the first language by name. Null texts and texts without a letter are
    "und" with score 0, as is everything if nothing was learned.
    """
    lean = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (held_out if held_out is not None else F.lit(False)).alias("held_out"))
    kind = docs.schema[key].dataType.simpleString()
    return lean.mapInArrow(_classifier(learned), f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def digest(docs: DataFrame) -> DataFrame:
    """Predictions for every document, with profiles learned from those whose crc32 remainder by 4 isn't 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, profiles(docs.where(~held)), held_out=held)
