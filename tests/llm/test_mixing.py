import hashlib

from pyspark.sql import Row

from loamworks.llm import mixing

SCHEMA = "doc_id long, text string, source string, weight string, target int"


def brute(docs):
    """(doc_id, copies) by the definition, and the targets."""
    size = {d.doc_id: len((d.text or "").split()) for d in docs}
    names = sorted({d.source for d in docs if d.source is not None}) + [None] * any(d.source is None for d in docs)
    own = {s: sum(size[d.doc_id] for d in docs if d.source == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * own[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * own[s]
            left -= target[s]
            open_.discard(s)
    line = []
    for i, s in enumerate(names):
        ordered = sorted((hashlib.md5(f"0:{d.doc_id}".encode()).hexdigest(), size[d.doc_id], d.doc_id) for d in docs if d.source == s)
        for p in (0, 1):
            run = p * own[s]
            for h, n, k in ordered:
                run += n
                line.append((run / target[s] if target[s] else 0, i, p, h, n, k))
    copies, words = {d.doc_id: 0 for d in docs}, 0
    for *_, n, k in sorted(line):
        words += n
        if words <= 1.5 * sum(own.values()):
            copies[k] += 1
    return size, copies, target


def test_schedule_equals_brute_force(spark):
    docs = [Row(doc_id=i, text="w " * (i * 7 % 23) if i % 11 else None, source=None if i % 10 == 9 else f"s{0 if i % 3 == 0 else i % 5}", weight="x", target=0) for i in range(400)]
    size, copies, target = brute(docs)
    got = mixing.digest(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == 400
    for r in got:
        assert (r.size, r.taken) == (size[r.doc_id], size[r.doc_id] * copies[r.doc_id])
        assert abs(r.target - target[docs[r.doc_id].source]) < 1e-6
    for s in target:
        taken = sum(r.taken for r in got if docs[r.doc_id].source == s)
        assert abs(taken - target[s]) <= 2 * 23


def test_mix_repeats_rows_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="a b", source="a"), Row(doc_id=1, text="a b", source="a"), Row(doc_id=None, text="", source="b"), Row(doc_id=2, text="c d e f", source="b")], "doc_id long, text string, source string")
    assert mixing.digest(docs).count() == 4
    assert mixing.mix(docs.selectExpr("*", "1 AS target", "'x' AS weight", "2 AS source_size")).count() > 0
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "mix_pass"]
    assert mixing.mix(docs.limit(0)).count() == 0
