import numpy as np
import pyarrow as pa
import pytest

from loamworks.llm import quality
from loamworks.session import read_table

from ..conftest import SF


def test_linear_time_score_equals_all_pairs():
    machine = quality.Machine(seed=3)
    machine.bias, machine.w = 0.3, np.random.default_rng(1).normal(size=quality.SLOTS)
    texts = ["one two two Three", "", None, "x" * 40, "é | %%% 12\n\n.\"", "one two two Three"]
    for first, last, rows, slots, values in quality.features(pa.array(texts)):
        assert (first, last) == (0, len(texts))
        got, _ = machine.sums(rows, slots, values, last)
        for i in range(last):
            s, x = slots[rows == i], values[rows == i]
            assert len(set(s.tolist())) == len(s)
            want = machine.bias + (machine.w[s] * x).sum() + sum(machine.v[s[a]] @ machine.v[s[b]] * x[a] * x[b] for a in range(len(s)) for b in range(a))
            assert got[i] == pytest.approx(want)


def test_features_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    texts = ["a b c. " * 50, "", "THE!! END!!", "x y " * 300]
    alone = [[(s.tolist(), v.round(9).tolist()) for *_, s, v in quality.features(pa.array([t]))][0] for t in texts]
    for _, _, rows, slots, values in quality.features(pa.array(texts)):
        for i in range(len(texts)):
            assert (slots[rows == i].tolist(), values[rows == i].round(9).tolist()) == alone[i]
    monkeypatch.setattr("loamworks.llm.words.PIECE", 64)
    again = [(slots[rows == i].tolist(), values[rows == i].round(9).tolist()) for f, t, rows, slots, values in quality.features(pa.array(texts)) for i in range(t - f)]
    assert again == alone


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.digest(docs, labels).collect()
    held = [r.predicted == want[r.doc_id] for r in got if r.held_out and r.doc_id in want]
    assert len(got) == docs.count() and sum(held) > 0.95 * len(held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "q", 1), (None, "", "q", 1), (2, "a", "q", 1), (2, "a", "q", 1)], "doc_id long, text string, _label string, quality int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.digest(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 1 for r in got)
    assert quality.digest(docs.limit(0), labels).count() == 0


def test_repeated_keys_and_copies_bound_what_is_fitted(spark, monkeypatch):
    """A key with very many texts, repeated labels and copies: no more than twice the sample comes to the driver."""
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(i, "a copy of one text") for i in range(2, 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 400, i % 2) for i in range(4000)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, row, slots, values, y: seen.append(len(y)) or self)
    for sample in (50, 5000):
        quality.learn(docs, labels, sample=sample)
    assert all(n <= 2 * s for n, s in zip(seen, (50, 5000))) and seen[-1] == 3002
