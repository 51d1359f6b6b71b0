import random

from pyspark.sql import Row

from loamworks.llm import neardup
from loamworks.llm.words import raw, word_hashes
from loamworks.session import read_table

from ..conftest import SF


def shingle_set(text, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(texts, k, percent):
    """Component of each row by comparing all."""
    sets = [shingle_set(t, k) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def compare(spark, texts, k=4, percent=80):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n=i, id="x", v=1) for i, t in enumerate(texts)], "doc_id long, text string, n int, id string, v int").repartition(5)
    got = {r.doc_id: r for r in neardup.classes(docs, k=k, percent=percent).collect()}
    sizes, roots = brute(texts, k, percent)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    return docs, roots


def test_sample_documents(spark):
    compare(spark, [r.text for r in read_table(spark, SF, "documents").orderBy("doc_id").collect()])


def test_chains_copies_and_odd_texts(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(5000))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "a", "A", "a b", "B a", "a b c d", "A b\tc\x0bd", "é ü ß 漢", "É ü ß 漢"]
    for size in (30, 120, 400):
        base = [word() for _ in range(size)]
        for _ in range(25):
            near = [w if rng.random() > rng.choice((0.005, 0.02, 0.04)) else word() for w in base]
            texts.append(" ".join(near))
        texts += [" ".join(base)] * 3
    for _ in range(40):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]))
    rng.shuffle(texts)
    docs, roots = compare(spark, texts)
    compare(spark, texts, k=5)
    kept = neardup.deduplicate(docs, k=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_truncated_text_beside_crowded_longer_ones(spark):
    """The copies' sketches agree and end before the truncated text's does, so no rare value links it."""
    import pyarrow as pa

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**9)}" for _ in range(2600)]
    suffixed = [" ".join([*base, f"end{i}"]) for i in range(900)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(901)), "text": [" ".join(base), *suffixed], "print": list(range(901))})
    sketches = [s.as_py() for b in neardup._sets(4, neardup.WIDE)(iter([batch])) for s in b.column("sketch")]
    same = [t for t, s in zip(suffixed, sketches[1:], strict=True) if s == sketches[0]][:120]
    assert len(same) == 120
    _, roots = compare(spark, [*same, " ".join(base[:2210])])
    assert roots[120] == 0


def test_repeated_rows_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, None), (3, None), (4, "x y z"), (4, "p q r")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in neardup.classes(docs, k=4).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (4, 1, 4), (4, 1, 4)]
    assert neardup.classes(docs.limit(0)).count() == 0
    assert neardup.deduplicate(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in neardup.deduplicate(docs, k=4).collect()) == [0, 1, 3, 3, 4]


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["Ab c\n" * 400 + "x" * 90, "", None, "one two"]
    whole = [h.tolist() for *_, h, _ in word_hashes(*raw(pa.array(texts)))]
    monkeypatch.setattr("loamworks.llm.words.PIECE", 64)
    pieces = [h.tolist() for *_, h, _ in word_hashes(*raw(pa.array(texts)))]
    assert sum(whole, []) == sum(pieces, [])


def test_texts_that_share_an_id_are_linked_each_by_its_own_words(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, "more"]) for b in base] + [" ".join(["x", *b, "z"]) for b in base[:3]]
    ids = [7, 5, 5, 9, 9, 1, 5, 5, 2, 9, 3, 3, 5, 5, 6]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)) * 2, "doc_id long, text string")
    _, roots = brute(texts, 4, 80)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, 99), ids[i])
    want = sorted((ids[i], least[r]) for i, r in enumerate(roots)) * 2
    got = sorted((r.doc_id, r.component_id) for r in neardup.classes(docs, k=4).collect())
    assert got == sorted(want)


def test_hot_lists_are_looked_up_alike(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 10**9)
    monkeypatch.setattr(neardup, "SHORT", 0)
    compare(spark, [r.text for r in read_table(spark, SF, "documents").orderBy("doc_id").limit(120).collect()])
