import zlib
from collections import Counter

import numpy as np

from loamworks.llm import langid
from loamworks.session import read_table

from ..conftest import SF


def plain(text):
    """n-gram counts by the definition."""
    out, last = "", " "
    for c in " " + text + " ":
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or last != " " or not out:
            out += c
        last = c
    return Counter(out[i : i + n] for n in (1, 2, 3) for i in range(len(out) - n + 1) if out[i : i + n].strip())


def spelled(code):
    out = []
    while code:
        out.append(chr(code & (1 << 21) - 1) if code & (1 << 21) - 1 else " ")
        code >>= 21
    return "".join(reversed(out))


def test_counts_equal_definition_and_pieces(monkeypatch):
    for text in ("Ab, cé ABC", "a", "", "x" * 50 + " yz 漢字", "Hello  world!"):
        keys, counts = langid.grams(text)
        want = Counter()
        for g, n in plain(text).items():
            want[g.lstrip() if len(g) > 1 else g] += n
        got = Counter()
        for k, n in zip(keys, counts):
            got[spelled(int(k))] += int(n)
        assert got == want, text
        monkeypatch.setattr(langid, "PIECE", 5)
        again = langid.grams(text)
        monkeypatch.setattr(langid, "PIECE", 1 << 18)
        assert np.array_equal(keys, again[0]) and np.array_equal(counts, again[1])


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.digest(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(right) >= 0.93 * len(right)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "z"), (None, "12 3!", None, "z"), (2, "the and of", "en", "z"), (2, "the and of", "en", "z"), (3, "der die das", "de", "z")], "doc_id long, text string, lang string, score string")
    learned = langid.profiles(docs)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(docs, learned).collect())
    assert got == [(0, "und"), (1, "und"), (2, "en"), (2, "en"), (3, "de")]
    assert [r.lang_pred for r in langid.identify(docs.limit(1), langid.profiles(docs.limit(0))).collect()] == ["und"]
    assert langid.digest(docs.limit(0)).count() == 0


def test_rare_languages_are_learned_and_copies_count_once(spark):
    english = [(i, f"the house of number{i % 97} and the garden were there when {chr(97 + i % 26)} came", "en") for i in range(20_000)]
    german = [(30_000 + i, f"das Haus der Familie Nummer{i} und der Garten waren nicht dort {chr(97 + i % 26)}", "de") for i in range(60)]
    copies = [(40_000 + i, "zz qq zz qq zz qq", "en") for i in range(9_000)]
    docs = spark.createDataFrame(english + german + copies, "doc_id long, text string, lang string")
    learned = langid.profiles(docs, sample=100)
    assert set(learned) == {"en", "de"}
    got = langid.identify(docs.where("doc_id >= 30000 AND doc_id < 40000"), learned).collect()
    assert all(r.lang_pred == "de" for r in got)
    z = next(int(k) for k in langid.grams("zz")[0] if spelled(int(k)) == "zz")
    assert z not in learned["en"][:50]


def test_ranks_and_distances_equal_the_definition(spark):
    texts = {"en": "the cat and the dog", "xx": "qua qui quo the", "yy": "zzz"}
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    learned = langid.profiles(docs)

    def order(text):
        counts = {spelled(int(k)): (-int(n), int(k)) for k, n in zip(*langid.grams(text))}
        return sorted(counts, key=counts.get)

    for name, text in texts.items():
        assert [spelled(k) for k in learned[name]] == order(text)[: langid.PROFILE]
    for r in langid.identify(spark.createDataFrame([(9, "the quick dog", "")], "doc_id long, text string, lang string"), learned).collect():
        own = order("the quick dog")
        away = {n: sum(abs(i - order(t).index(g)) if g in order(t) else langid.PROFILE for i, g in enumerate(own)) for n, t in texts.items()}
        best = min(sorted(away), key=away.get)
        assert r.lang_pred == best and abs(r.score - (1 - away[best] / (langid.PROFILE * len(own)))) < 1e-9
