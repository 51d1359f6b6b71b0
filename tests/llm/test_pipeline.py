import corpus_pipeline
from loamworks.llm import mixing, pii, quality
from loamworks.session import read_table

from ..conftest import SF
from . import test_decontam, test_mixing, test_neardup, test_pii


def test_run_equals_brute_force(spark):
    docs, labels, items = (read_table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    accepted = quality.accepted(docs, labels).orderBy("doc_id").collect()
    _, roots = test_neardup.brute([r.text for r in accepted], 5, 80)
    left = [r for i, r in enumerate(accepted) if roots[i] == i]
    bad = {d for d, _ in test_decontam.brute([(r.doc_id, r.text) for r in left], [(r.item_id, r.text) for r in items.collect()])}
    left = [r for r in left if r.doc_id not in bad]
    texts = {}
    for r in left:
        text, spans = r.text, sorted((a, b, k) for k, a, b in test_pii.brute(r.text))
        for a, b, k in reversed(spans):
            text = text[:a] + f"[{k.upper()}]" + text[b:]
        texts[r.doc_id] = text
    from pyspark.sql import Row

    size, copies, _ = test_mixing.brute([Row(doc_id=r.doc_id, text=texts[r.doc_id], source=r.source) for r in left])
    got = corpus_pipeline.run(spark, SF).collect()
    want = sorted((d, p, texts[d]) for d, n in copies.items() if size[d] for p in range(n))
    assert [x for x in sorted((r.doc_id, r.mix_pass, r.text) for r in got) if size[x[0]]] == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "a", 0, 1), (1, "", "en", "a", 0, 1), (2, "the call +1 (212) 555-1000 a b c d e f", "en", None, 39, 1)], "doc_id long, text string, lang string, source string, n_chars long, target int")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns
        docs = out
    assert pii.redact(odd, length="n_chars").where("doc_id = 2").first().n_chars == len("the call [PHONE] a b c d e f")
    left, mixed = docs.collect(), mixing.mix(docs).collect()
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in left}
    assert words(left) <= words(mixed) <= 2 * words(left)  # half as much again, by whole documents
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
