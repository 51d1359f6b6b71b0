"""Quality by a factorisation machine over hashed words, structure statistics and size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.words import raw, word_hashes
from loamworks.session import Workspace

#: Slots for hashed words, bins of each statistic, rank of the interactions.
WORDS, BINS, RANK = 1 << 14, 16, 8
STATS = ("size", "words", "word_length", "distinct", "top_word", "capital", "digit", "symbol", "line", "high", "stop", "clean_end")
SLOTS = WORDS + BINS * len(STATS)
#: Weight of a statistic beside a text's word vector of length 1.
STAT_WEIGHT = 1.0
#: Labelled texts that are learned from, about; chosen by digest of the key.
SAMPLE = 8_000
#: A score from which a text counts as good.
THRESHOLD = 0.3

_KIND = np.zeros((256, 5), np.int64)
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"], 2] = 1
_KIND[10, 3] = 1
_KIND[128:, 4] = 1


def _bin(values: np.ndarray) -> np.ndarray:
    """Bins of shares from 0 to 1, finer near both ends."""
    edges = np.array([1e-9, 0.004, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.42, 0.55, 0.68, 0.8, 0.9, 0.97])
    return np.searchsorted(edges, values, "right")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of rows: (first, last + 1, row of each entry, slot, value), rows from 0, sorted by row and slot."""
    data, offsets = raw(column)
    for first, last, hashes, at in word_hashes(data, offsets):
        n = last - first
        sizes, words = np.diff(offsets[first : last + 1]), np.diff(at)
        row = np.repeat(np.arange(n), words)
        slot = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
        keys, counts = np.unique(row * WORDS + slot, return_counts=True)
        of, value = keys // WORDS, np.log1p(counts)
        norm = np.sqrt(np.bincount(of, value**2, minlength=n))
        value = value / norm[of] if len(of) else value
        most = np.zeros(n, np.int64)
        np.maximum.at(most, of, counts)
        piece, cuts = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        sums = np.stack([np.diff(np.concatenate(([0], np.cumsum(_KIND[piece, i])))[cuts]) for i in range(_KIND.shape[1])], axis=1)
        stop = np.array([piece[b - 1] in b".!?\"" if b > a else False for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.float64)
        chars, count = np.maximum(sizes, 1), np.maximum(words, 1)
        distinct = np.bincount(of, minlength=n)
        shares = [
            _bin(np.log2(sizes + 1) / 24), _bin(np.log2(words + 1) / 20), _bin(np.minimum(sizes / count / 24, 1)), _bin(distinct / count), _bin(most / count), _bin(np.minimum(sums[:, 0] / count, 1)), _bin(sums[:, 1] / chars),
            _bin(sums[:, 2] / chars), _bin(np.minimum(sums[:, 3] / count, 1)), _bin(sums[:, 4] / chars), _bin(np.minimum((piece_count(piece, cuts, b".") + piece_count(piece, cuts, b",")) / count, 1)), np.where(sizes > 0, 1 + stop, 0).astype(np.int64),
        ]
        stat_slot = np.stack([WORDS + i * BINS + s for i, s in enumerate(shares)], axis=1)
        rows = np.concatenate((of, np.repeat(np.arange(n), len(STATS))))
        slots = np.concatenate((keys % WORDS, stat_slot.ravel()))
        values = np.concatenate((value, np.full(n * len(STATS), STAT_WEIGHT)))
        order = np.lexsort((slots, rows))
        yield first, last, rows[order], slots[order], values[order]


def piece_count(piece: np.ndarray, cuts: np.ndarray, char: bytes) -> np.ndarray:
    """Occurrences of a byte in each row of a piece."""
    return np.diff(np.concatenate(([0], np.cumsum(piece == char[0])))[cuts])


class Machine:
    """Bias, weights and factors of a factorisation machine."""

    def __init__(self, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(SLOTS)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SLOTS, RANK))

    def sums(self, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores in linear time: half of the squared sums less the summed squares; and the sums."""
        ends = np.searchsorted(rows, np.arange(n))  # every row has its statistics, so none is empty
        vx = self.v[slots] * values[:, None]
        total = np.add.reduceat(vx, ends, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, ends, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[slots] * values, ends) + pairs, total

    def fit(self, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, labels: np.ndarray, rate: float = 0.1, decay: float = 2e-5, seed: int = 11) -> Machine:
        """Adagrad on the logistic loss in a fixed shuffled order; few texts get smaller batches and more epochs."""
        batch = int(np.clip(len(labels) // 40, 16, 256))
        epochs = int(np.clip(1000 * batch // max(len(labels), 1), 12, 60))
        begin = np.searchsorted(rows, np.arange(len(labels) + 1))
        share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, rng = np.full(SLOTS, 1e-4), np.full((SLOTS, RANK), 1e-4), np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                some = np.sort(order[at : at + batch])
                pick = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
                own = np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
                s, x = slots[pick], values[pick]
                score, total = self.sums(own, s, x, len(some))
                away = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
                used, place = np.unique(s, return_inverse=True)
                gx = away[own] * x
                grad = np.bincount(place, gx, minlength=len(used)) + decay * self.w[used]
                seen_w[used] += grad**2
                self.w[used] -= rate * grad / np.sqrt(seen_w[used])
                inner = gx[:, None] * (total[own] - self.v[s] * x[:, None])
                grad_v = np.stack([np.bincount(place, inner[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + decay * self.v[used]
                seen_v[used] += grad_v**2
                self.v[used] -= rate / 4 * grad_v / np.sqrt(seen_v[used])
                self.bias -= rate * away.sum()
        return self


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, rows, slots, values in features(batch.column(0)):
            cuts = np.searchsorted(rows, np.arange(last - first + 1))
            pack = [slots[a:b].astype(np.uint16).tobytes() + values[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels[first:last], pa.int32()), "entries": pa.array(pack, pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted to about sample different labelled texts; the driver gets their hashed entries, and of no more than twice as many.

    Keys are drawn by digest, repeated ones once; texts that repeat with a label are one, so neither repeated keys
    nor copies add to what is fitted. A key with very many texts adds only its share of a second draw by text. Null labels
    are left out, null texts are empty; without any label the machine says 0.5 throughout.
    """
    share = lambda c, part: F.pmod(F.xxhash64(c, F.lit("drawn")), F.lit(1 << 32)) < int(min(1.0, part) * (1 << 32))
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    keys = rows.select("_key").distinct().count()
    rows = rows.where(share("_key", sample / max(keys, 1)))
    lean = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    some = lean.join(F.broadcast(rows), F.col("_doc") == F.col("_key")).select("_text", "_label", F.xxhash64("_text").alias("_print"))
    some = Workspace(docs.sparkSession, "quality").table(some.dropDuplicates(["_print", "_label"]), "sample")
    found = some.count()
    if found > 2 * sample:
        some = some.where(share("_print", sample / found))
    got = some.select("_text", "_label").mapInArrow(_sparse, "label int, entries binary").collect()
    got.sort(key=lambda r: (bytes(r["entries"]), r["label"]))
    slots, values, sizes = [], [], []
    for r in got:
        n = len(r["entries"]) // 6
        slots.append(np.frombuffer(r["entries"], np.uint16, n))
        values.append(np.frombuffer(r["entries"], np.float32, n, 2 * n))
        sizes.append(n)
    if not got:
        return Machine()
    row = np.repeat(np.arange(len(got)), sizes)
    return Machine().fit(row, np.concatenate(slots).astype(np.int64), np.concatenate(values).astype(np.float64), np.array([r["label"] for r in got], np.float64))


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, rows, slots, values in features(batch.column(0)):
                score, _ = machine.sums(rows, slots, values, last - first)
                rest = [c.slice(first, last - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(1 / (1 + np.exp(-np.clip(score, -30, 30))))], [*batch.schema.names, "__lw_score"])

    return run


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (the columns named in keep, or all) with __lw_score from 0 to 1; null texts count as empty, all rows stay."""
    names = list(keep if keep is not None else docs.columns)
    lean = docs.select(F.col(text).alias("__lw_text"), *names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema)
    return lean.mapInArrow(_scorer(machine), f"{kinds}, __lw_score double").drop("__lw_text")


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a machine that learned from rows that aren't held out."""
    machine = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, machine, keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lw_score").alias("score"), (F.col("__lw_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    machine = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, machine).where(F.col("__lw_score") >= THRESHOLD).select(docs.columns)
