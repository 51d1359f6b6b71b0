import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from loamworks.llm import spans


def test_positions_masks_and_overlaps_equal_a_plain_model(spark, monkeypatch):
    """Blocks and pieces of a few elements, so that all borders are met; texts with characters beyond the first plane."""
    monkeypatch.setattr(spans, "BLOCK", 3)
    monkeypatch.setattr(spans, "PIECE", 5)
    dice = random.Random(6)
    texts = ["", None, "ab", "😀" * 12 + "ab"] + ["".join(dice.choice("ab😀é \n") for _ in range(dice.randrange(60))) for _ in range(120)]
    df = spark.createDataFrame([Row(i=i, text=t) for i, t in enumerate(texts)], "i int, text string")
    found, other = spans.match_spans(F.col("text"), "a+b?", 2), spans.match_spans(F.col("text"), "[b é]{2}", 0)
    labelled = F.array_sort(F.transform(F.concat("found", "other"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("<>").alias("label"))))
    df = df.withColumn("found", found).withColumn("other", other)
    rows = df.select("text", "found", "other", spans.untouched(F.col("other"), F.col("found")).alias("free"), spans.masked(F.col("text"), labelled).alias("masked")).collect()
    for r in rows:
        if r.text is None:
            assert r.found is None and r.masked is None
            continue
        want = [(m.start(), m.end()) for m in re.finditer("a+b?", r.text)]
        assert [(s.start, s.end) for s in r.found] == want
        assert all(s.before == r.text[max([0, *[e for _, e in want if e <= s.start]], default=0) : s.start][-2:] for s in r.found)
        others = [(m.start(), m.end()) for m in re.finditer("[b é]{2}", r.text)]
        assert [(s.start, s.end) for s in r.free] == [(a, b) for a, b in others if not any(x < b and y > a for x, y in want)]
        at, out = 0, ""
        for a, b in sorted(want + others):
            out += r.text[at : max(a, at)] + ("<>" if b > at else "")
            at = max(at, b)
        assert r.masked == out + r.text[at:]
