import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import Row

from loamworks.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, repaired lines) by trying all edits, with up to two inserts in each gap; rows are (role, text, fault)."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(("K", "user", "assistant", "D"), repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") or e == "K" and role[:1] == "" for e, (role, _, f) in zip(edits, rows)):
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 2 * len(gaps[0]), "I" * len(gaps[0]), [(r, "") for r in gaps[0]]
            for e, (role, text, fault), gap in zip(edits, rows, gaps[1:]):
                cost += (3 if e == "D" else (e != "K") * 2 + (fault == "truncated")) + 2 * len(gap)
                audit += (e if e in "KD" else "R") + "I" * len(gap)
                out += [] if e == "D" else [(role if e == "K" else e, text)]
                out += [(r, "") for r in gap]
            if GOOD.match("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in out]
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def test_programme_equals_all_edits():
    dice = random.Random(7)
    for n in [0, 1] + [2] * 150 + [3] * 12:
        rows = faults([(dice.choice(("system", "user", "assistant", "user", "assistant", "tool", "")), dice.choice(("a.", "b", " ", "c!", "d?"))) for _ in range(n)])
        found = turn_repair.Viterbi()
        edits = [e for role, text, f in rows for e in found.row(role, text, f in ("blank", "duplicate"), f == "truncated")]
        edits += list(found.ended())
        cost, audit, lines = cheapest(rows)
        assert (found.cost, "".join(e for e, _, _ in edits)) == (cost, audit), rows
        assert [f"{r}:{t}" for e, r, t in edits if e != "D"] == lines


def test_long_conversation_is_settled_as_it_goes():
    dice, found, most, edits = random.Random(1), turn_repair.Viterbi(), 0, 0
    for n in range(60_000):
        role = dice.choice(("user", "assistant", "user", "system"))
        edits += sum(1 for _ in found.row(role, f"{n}.", n % 9 == 0, n % 7 == 0))
        most = max(most, len(found.waiting))
    edits += sum(1 for _ in found.ended())
    assert most < 2_000 and edits > 60_000


def damaged(rows):
    """Rows of one conversation after damage, in order, by the definition."""
    out = []
    for r in rows:
        part = lambda v: " " if v is None else str(v)
        f = zlib.crc32(f"{part(r.conv_id)}:{part(r.turn)}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", part(r.text)) if f == 2 else part(r.text)
        out += [(r.turn, "user" if f == 4 else part(r.role), text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x))


def test_report_equals_brute_force(spark):
    dice = random.Random(3)
    rows = [
        Row(conv_id=c if c else None, turn=None if dice.random() < 0.1 else t * dice.choice((1, 1, 2)), role=dice.choice(("user", "assistant", "system", None, "")), text=dice.choice((None, "", "one.", "two", "Three! ", "é?")), cost=1, audit="x")
        for c in range(60)
        for t in range(dice.choice((1, 2, 2)))
    ]
    rows += [rows[5], rows[5], Row(conv_id=100, turn=1, role="user", text="long. " * 50_000, cost=None, audit=None)]
    got = {r.conv_id: r for r in turn_repair.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len({r.conv_id for r in rows})
    tried = 0
    for c, r in got.items():
        own = damaged([x for x in rows if x.conv_id == c])
        if len(own) > 3:
            continue
        tried += 1
        marked = faults([(role, text) for _, role, text in own])
        cost, audit, lines = cheapest(marked)
        turns = {t for t, _, _ in own if t is not None}
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert [r.blank, r.duplicate, r.truncated] == [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    assert tried > 50


def test_turns_and_empty_tables(spark):
    rows = [Row(conv_id=1, turn=2, role="assistant", text="b."), Row(conv_id=1, turn=1, role="system", text="a."), Row(conv_id=1, turn=3, role="assistant", text="b.")]
    convs = spark.createDataFrame(rows)
    edits = sorted((r.place, r.edit, r.role, r.text) for r in turn_repair.repaired_turns(convs).collect())
    assert edits == [(1, "K", "system", "a."), (2, "I", "user", ""), (3, "K", "assistant", "b."), (4, "D", "assistant", "b.")]
    assert turn_repair.digest(convs.limit(0)).count() == 0 and turn_repair.repaired_turns(convs.limit(0)).count() == 0
    gone = next(n for n in range(100) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    (r,) = turn_repair.digest(spark.createDataFrame([Row(conv_id=gone, turn=0, role="user", text="a.")])).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
