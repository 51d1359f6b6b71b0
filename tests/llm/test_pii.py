import hashlib
import re
import time

from pyspark.sql import Row

from loamworks.llm import pii
from loamworks.session import read_table

from ..conftest import SF

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


HARD = [
    None, "", "a@b.c%x@d.e.f@g.h", "x" * 3000 + "@a", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0255.01.1.1", "1" * 5000, "4111 1111 1111 1111 4111-1111-1111-1111",
    "+1 (017) 555-7713 +12 +4 4.4(1)234 567", "é😀 a.b@c-d.co.uk, ü", "mail a@b.c.\n.34@mail7.example.com", "4111111111111111 " * 40, "0.0.0.0.", "+49 30 123456 78 9",
]


def rows(spark, texts):
    return spark.createDataFrame([Row(doc_id=i, text=t, kind="x", start=1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start int")


def test_base_spans_equal_brute_force(spark):
    docs = [r for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    texts = [r.text for r in docs] + HARD
    got = {r.doc_id: r for r in pii.digest(rows(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert got[i].base_sha256 == digest, (i, t and t[:80], got[i].spans, want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]


def test_vote_adds_loose_spans_with_support_only(spark):
    plain = [f"Please call our phone 555-0{i:02d}-1{i:03d} today or +1 (212) 555-{1000 + i} soon, phone" for i in range(30)]
    spans = [r.spans for r in pii.digest(rows(spark, plain)).collect()]
    assert all(s.count("phone") == 2 for s in spans)


def test_redaction_keeps_rows_and_hides_spans(spark):
    docs = rows(spark, ["a@b.com x 4111111111111111", None, "", "é +1 (212) 555-1000 z", "plain", "plain"])
    out = pii.redact(docs).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["[EMAIL] x [CARD]", None, "", "é [PHONE] z", "plain", "plain"]
    assert out[0].asDict().keys() == {"doc_id", "text", "kind", "start"}
    assert pii.redact(docs.limit(0)).count() == 0


def test_unsupported_and_opposed_loose_spans_are_rejected(spark):
    good = [f"Please call our phone 555-0{i:02d}-1{i:03d} today" for i in range(20)] + ["write to jo [at] mail [dot] org", "server address 8[.]8[.]4[.]4 here", "my visa card 4111.1111.1111.1111 thanks"]
    bad = ["order 555-123-4567 invoice", "see 555-123-4567 version 2", "part no 4111/1111/1111/1111 serial", "release 8[.]8[.]4[.]4 of the part", "x=555-123-4567-y order"]
    got = [r.spans for r in pii.digest(rows(spark, good + bad)).orderBy("doc_id").collect()]
    assert [bool(s) for s in got] == [True] * len(good) + [False] * len(bad), got
    assert [bool(r.spans) for r in pii.digest(rows(spark, bad[:1])).collect()] == [False]


def test_expectation_maximisation_equals_brute_force():
    """Every candidate by itself, in plain loops."""
    import math
    import random

    rng = random.Random(4)
    each = []
    for _ in range(300):
        truth, base = rng.random() < 0.6, rng.random() < 0.7
        votes = [(1 if truth else -1) * rng.choice([1, 1, 1, 0, 0, -1]) for _ in pii.LABELERS]
        each.append((rng.choice(pii.KINDS), base, tuple(votes)))
    p = [1 / (1 + math.exp(-(sum(v) + 2 * b - 0.5))) for _, b, v in each]
    for _ in range(40):
        prior = {}
        for g in {(k, b) for k, b, _ in each}:
            own = [q for (k, b, _), q in zip(each, p, strict=True) if (k, b) == g]
            prior[g] = (sum(own) + pii.PRIOR[0]) / (len(own) + sum(pii.PRIOR))
        table = {}
        for i in range(len(pii.LABELERS)):
            for truth in (0, 1):
                count = {-1: pii.WRONG if truth else pii.RIGHT, 0: pii.NONE, 1: pii.RIGHT if truth else pii.WRONG}
                for (_, _, v), q in zip(each, p, strict=True):
                    count[v[i]] += q if truth else 1 - q
                for v, c in count.items():
                    table[i, truth, v] = c / sum(count.values())
        for j, (k, b, v) in enumerate(each):
            s = math.log(prior[k, b] / (1 - prior[k, b])) + sum(math.log(table[i, 1, x] / table[i, 0, x]) for i, x in enumerate(v))
            p[j] = 1 / (1 + math.exp(-max(-30, min(30, s))))
    counted = {}
    for e in each:
        counted[e] = counted.get(e, 0) + 1
    patterns = [{"kind": k, "base": b, "votes": v, "looks": (0, 0, 0, 0), "n": n} for (k, b, v), n in counted.items()]
    tables, priors, posterior = pii.reliabilities(patterns)
    want = dict(zip(each, p, strict=True))
    assert all(abs(want[k, b, v] - q) < 1e-9 for (k, b, v), q in zip(counted, posterior, strict=True))
    assert all(abs(prior[g] - x) < 1e-9 for g, x in priors.items()) and abs(tables[2, 1, 0] - table[2, 1, -1]) < 1e-9


def test_long_texts_are_searched_whole(spark):
    text = "word " * 60_000 + "a@b.com " + "4111111111111111 " * 200 + "x" * 100_000 + " +1 (212) 555-1000"
    got = pii.digest(rows(spark, [text])).first()
    assert (got.n_email, got.n_card, got.n_phone) == tuple(sum(k == w for w, *_ in brute(text)) for k in ("email", "card", "phone"))


def test_very_many_spans_in_one_text(spark):
    """50,000 addresses in one text: positions, overlaps and masks take time in proportion."""
    n = 50_000
    text = " ".join(f"user{i}@mail{i % 7}.com" for i in range(n)) + " é host 8.8.8[.]8"
    docs = spark.createDataFrame([Row(doc_id=1, text=text, n_chars=len(text))])
    began = time.time()
    r = pii.digest(docs).first()
    want, at = [], 0
    for word in text.split(" ")[:n]:
        want.append(f"email:{at}:{at + len(word)}")
        at += len(word) + 1
    assert r.n_email == n and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    masked = pii.redact(docs, length="n_chars").first()
    assert masked.text.startswith("[EMAIL] " * n + "é host ") and masked.n_chars == len(masked.text)
    assert time.time() - began < 60


def test_partly_written_out_addresses_are_candidates(spark):
    texts = ["host 8.8.8[.]8 there", "host 8[.]8.8.8 there", "host 8.8[.]8(.)8 there", "host 8.8.8.8 there", "host 1.2.3.4.5[.]6 there"]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    got = {r.doc_id: [(c.kind, c.base) for c in r["__lw_pii"]] for r in pii.candidates(docs).collect()}
    assert got == {0: [("ip", False)], 1: [("ip", False)], 2: [("ip", False)], 3: [("ip", True)], 4: [("ip", True)]}
