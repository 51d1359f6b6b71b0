import re
from collections import Counter

from loamworks.llm import decontam
from loamworks.session import read_table

from ..conftest import SF


def brute(docs, items):
    """Documents with SHARE of an item's windows, on texts without slots."""
    cut = lambda t: re.findall(r"[^\W]+", (t or "").lower())
    out = set()
    for item, text in items:
        w = cut(text)
        windows = {tuple(w[i : i + 8]): i for i in range(len(w) - 7)}
        for doc, body in docs:
            d = cut(body)
            held = {windows[x] for i in range(len(d) - 7) for x in [tuple(d[i : i + 8])] if x in windows}
            if windows and len(held) >= decontam.SHARE * len(windows):
                out.add((doc, item))
    return out


def test_sample_equals_brute_force(spark):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    got = decontam.digest(docs, items).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


ITEM = "Alice has 12 apples and gives 5 apples to Bob. After that Alice walks 3 km to the market and sells all 12 boxes. How many are left for Bob?"
CASES = {
    1: "so " + ITEM + " end",
    2: "x " + ITEM.replace("12", "40").replace("Alice", "Emma").replace("Bob", "Leo").replace(" km", " miles") + " y",
    3: ITEM.replace("12 apples", "40 apples").replace("After that Alice", "After that Nina").replace("for Bob", "for Max").replace("12 boxes", "41 boxes"),
    4: ITEM[:30],
    5: "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16",
    6: None,
    7: "",
    8: "nothing of the kind",
}


def test_slots(spark):
    docs = spark.createDataFrame([(k, v, 1, "x") for k, v in CASES.items()] + [(1, CASES[1], 1, "x"), (None, CASES[1], 1, "x")], "doc_id long, text string, hash int, pos string")
    items = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (10, "1 2 3 4 5 6 7 8 9 10 11 12"), (11, "quite short item here")], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id, r.verbatim) for r in decontam.digest(docs, items).collect())
    assert got == [(0, 7, True), (1, 7, True), (2, 7, False), (5, 10, True)]  # an item of slots only counts verbatim
    assert decontam.digest(docs, items.limit(0)).count() == 0
    assert decontam.digest(docs.limit(0), items).count() == 0
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 7, 8]
    shorter = spark.createDataFrame([(1, "a quite Short item, here now")], "doc_id long, text string")
    assert [r.item_id for r in decontam.digest(shorter, items).collect()] == [11]


def test_items_of_many_slots_and_short_items_are_found_verbatim(spark):
    texts = ["What is 17 * 24 + 8?", "Compute 12 + 34 - 56.", "Find gcd(48, 180, 252)", "Sort 5, 3, 9, 1, 7, 2 in ascending order", "Name Turing", "entropy"]
    items = spark.createDataFrame([*enumerate(texts), (90, ""), (91, "...")], "item_id long, text string")
    docs = [(i, f"Some words before. {t.upper()} And some after 8") for i, t in enumerate(texts)]
    other = [(50, "What is 18 * 24 + 8?"), (51, "Compute 12 + 34 - 57."), (52, "Find gcd(48, 180, 253)"), (53, "Sort 5, 3, 9, 4, 7, 2 in descending order"), (54, "Name a Turing"), (55, "entropies"), (56, ""), (57, None)]
    docs = spark.createDataFrame([*docs, *other], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.share, r.verbatim) for r in decontam.digest(docs, items).collect())
    assert got == [(i, i, 1.0, True) for i in range(len(texts))]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items).collect()) == [r[0] for r in other]


def test_exact_windows_do_not_hide_a_changed_copy(spark):
    item = "the old mill stands near the river and sold 12 34 56 78 91 23 45 67 89 21 43 65 87 98 76 54 32 11 22 33 44 55 66 77 88 99"
    changed = "".join(str(9 - int(c)) if c.isdigit() else c for c in item)
    docs = spark.createDataFrame([(1, item), (2, changed)], "doc_id long, text string")
    got = decontam.digest(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.share, r.verbatim) for r in got) == [(1, 1.0, True), (2, 1.0, False)]


def slotted(text):
    """Raw and templated tokens, one by one."""
    raw, out = [], []
    for word in re.findall(r"\w+", re.sub(r"(?<=[0-9])[.,](?=[0-9])", "_", text or "")):
        low = word.lower()
        number = lambda w: bool(re.fullmatch(r"[0-9][0-9_]*", w)) or w in decontam.NUMBER_WORDS
        if number(low):
            out.append("#")
        elif low in decontam.UNITS and raw and number(raw[-1]):
            out.append("%")
        elif word[0] != low[0] and word != word.upper() and low not in decontam.OPENERS:
            out.append("@")
        else:
            out.append(low)
        raw.append(low)
    return raw, out


def brute_with_slots(docs, items):
    """Share and verbatim of each leak, by comparing every window with every window."""
    out = {}
    for item, text in items:
        raw, tokens = slotted(text)
        numeric = [r if t == "@" else t for r, t in zip(raw, tokens, strict=True)]
        n = min(decontam.WINDOW, len(raw))
        count = len(raw) - n + 1 if n else 0
        slots = [sum(t in "#@%" for t in tokens[p : p + n]) for p in range(count)]
        fit = [p for p in range(count) if n >= decontam.LEAST and 2 * slots[p] < n]
        for doc, body in docs:
            own, own_tokens = slotted(body)
            held, same, lines = set(), True, {}
            for p in range(count):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == raw[p : p + n]:
                        held.add(p)
                    found = own_tokens[at : at + n]
                    if p in fit and slots[p] and (found == tokens[p : p + n] or found == numeric[p : p + n] != own[at : at + n]):
                        lines.setdefault(at - p, []).append((p, [(tokens[p + i], raw[p + i], own[at + i]) for i in range(n) if tokens[p + i] in "#@%"]))
            for found in lines.values():
                votes = Counter(x for _, each in found for x in set(each))
                first = lambda pick, side, votes=votes: min((-n, x[side]) for x, n in votes.items() if pick(x))[1]
                good = {x for x in votes if first(lambda y, x=x: y[:2] == x[:2], 2) == x[2] and (x[0] != "@" or first(lambda y, x=x: (y[0], y[2]) == (x[0], x[2]), 1) == x[1])}
                values, bad = {x[:2] for x in votes}, {x[:2] for x in votes if x not in good}
                kept = [(p, each) for p, each in found if set(each) <= good]
                if 2 * len(bad) < len(values) and kept:
                    held |= {p for p, _ in kept}
                    same &= all(a == b for _, each in kept for _, a, b in each)
            share = max(len(held) / count if count else 0, len(held & set(fit)) / len(fit) if fit else 0)
            if share >= decontam.SHARE:
                out[doc, item] = (round(share, 9), same)
    return out


def test_slots_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    words = "gives takes apples boxes to the and market sells buys walks then home left for many how with".split()
    names, units = "Priya Ravi Kwame Amina Zoë Ólafur Li Mei".split(), "km miles kg days".split()
    token = lambda: rng.choice([rng.choice(words)] * 4 + [rng.choice(names), str(rng.randrange(30)), f"{rng.randrange(9)} {rng.choice(units)}", "twelve", "1,200"])
    items = [" ".join(token() for _ in range(n)) for n in [30] * 12 + [9, 8, 7, 5, 4, 3, 2, 1]] + ["7 8 9", "What is 12 + 34 * 5?", "Sum of 5", None, "?"]
    docs = []
    for text in items[:20]:
        for _ in range(4):
            swap = dict(zip(names, rng.sample(names, len(names)), strict=True)) | {str(i): str(rng.randrange(30)) for i in range(30)} | dict(zip(units, rng.sample(units, 4), strict=True))
            changed = " ".join(swap.get(w, w) if rng.random() > 0.03 else token() for w in text.split())
            docs.append(" ".join(token() for _ in range(5)) + " " + changed + ". " + token())
            numbers = " ".join(swap.get(w, w) if w.isdigit() else w for w in text.split())
            docs.append(rng.choice([numbers.lower(), numbers.upper(), numbers]))
    docs += items + [None, "", "x" * 50_000 + " " + items[0] + " y" * 3000]
    docs = list(enumerate(docs))
    items = list(enumerate(items))
    got = decontam.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_with_slots(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.share, 9), r.verbatim) for r in got} == want
    assert len(got) == len(want) and any(not same for _, same in want.values())


def test_names_beyond_lists_and_short_items(spark):
    items = ["Priya has 12 apples and gives 5 apples to Kwame, who sells 3 of them at the market.", "What is 12 + 34 * 5?", "Sum of 5", "Anna met Ben and then Anna paid Ben for 3 small red boxes of old tea"]
    docs = ["Ravi has 7 apples and gives 2 apples to Amina, who sells 1 of them at the market.", "so: what is 12 + 34 * 5 then", "the sum of 5 is", "Carl met Carl and then Carl paid Carl for 4 small red boxes of old tea", "Carl met Dora and then Carl paid Dora for 4 small red boxes of old tea"]
    got = decontam.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in got if r.doc_id != 3) == [(0, 0, False), (1, 1, True), (2, 2, True), (4, 3, False)]
    assert not [r for r in got if r.doc_id == 3 and r.share == 1.0]  # two names don't become one


def test_joined_by_shuffle_alike(spark, monkeypatch):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    want = sorted(map(tuple, decontam.digest(docs, items).collect()))
    monkeypatch.setattr(decontam, "SENT", 0)
    assert sorted(map(tuple, decontam.digest(docs, items).collect())) == want


def test_texts_of_one_case_and_slots_that_break_the_rule(spark):
    item = "Priya has 12 apples and gives 5 apples to Kwame, who sells 3 of them at the market to Priya for 2 coins."
    again = item.replace("12", "7").replace("5", "4")
    other = again.replace("Priya", "Ravi").replace("Kwame", "Amina")
    docs = [again.upper(), again.lower(), other, other.replace("market to Ravi", "market to Amina"), other.replace("market to Ravi", "market to Lena").replace("gives 4", "gives 3"), "has 12 apples"]
    docs.append("Priya has 1 apples and gives 2 apples to Priya, who sells 2 of them at the market to Kwame for 9 coins.")
    got = decontam.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    shares = {r.doc_id: r.share for r in got}
    assert all(not r.verbatim for r in got)
    assert shares[0] == shares[1] == shares[2] == 1.0  # other numbers in capitals and in small letters; other names
    assert decontam.SHARE <= shares[3] < 1 and decontam.SHARE <= shares[4] < 1  # about the other person; one stranger
    assert 5 not in shares and (6 not in shares or shares[6] < 1)
