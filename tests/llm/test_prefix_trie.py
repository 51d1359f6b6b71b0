import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import Row

from loamworks.llm import prefix_trie
from loamworks.session import Workspace

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, hot boolean"


def brute(rows):
    turns = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            turns[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(t[2:] for t in sorted(turns.get(base, []))[:h] + sorted(turns[c])[h:])
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = {n[:d] for n in below for d in [len(node) + 1] if len(n) == d}
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    dice = random.Random(5)
    rows = [
        Row(conv_id=None if c == 77 else c, turn=None if dice.random() < 0.05 else t, role=dice.choice(("user", None, "a")) if t % 3 else "user", text=dice.choice(("x", "yy", None, "é" * 5)), depth=3, key="k", hot=True)
        for c in [*range(0, 40), 77, *range(195, 260), -3, -100, 1000]
        for t in range(dice.choice((1, 2, 3, 7, 9)))
    ]
    rows += rows[:5] + [Row(conv_id=500, turn=1, role="user", text="long " * 40_000, depth=1, key=None, hot=False)]
    assert len({(r.conv_id, r.turn, r.role or "") for r in rows}) < len(rows)
    rows = sorted(rows, key=lambda r: (str(r.conv_id), str(r.turn)))
    ties = defaultdict(set)
    for r in rows:  # turns of one number and role go by digest; keep one text for each
        ties[r.conv_id, r.turn, r.role or ""].add(r.text)
    rows = [r for r in rows if len(ties[r.conv_id, r.turn, r.role or ""]) == 1]
    assert found(prefix_trie.digest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_conversation_and_hot_text(spark, monkeypatch):
    """Conversations of several blocks of depths, cut by the borders of partitions; one end that very many share."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [Row(conv_id=1, turn=t, role="user", text=f"t{t % 5}") for t in range(60)]
    rows += [Row(conv_id=2, turn=t, role="user", text=f"t{t % 5}" if t < 40 else "z") for t in range(50)]
    rows += [Row(conv_id=c, turn=t, role="user", text="same") for c in range(100, 190) for t in range(3)]
    assert found(prefix_trie.digest(spark.createDataFrame(rows))) == brute(rows)


def test_rounds_are_logarithmic(spark):
    """A binary trie of 64 conversations: each has as many light nodes above its end as its number has ones."""
    steps = [Row(conv_id=c, depth=d, d1=(c >> (6 - d)) if d else 0, d2=d, size=1 if d else 0, last=d == 6) for c in range(64) for d in range(7)]
    work = Workspace(spark, "test")
    got = prefix_trie.trie(spark.createDataFrame(steps), work).collect()
    assert len(got) == 127
    for r in got:
        assert r.n_leaves == 2 ** (6 - r.depth) == r.n_convs and r.n_children == (0 if r.depth == 6 else 2)
        assert r.saved_tokens == sum(2 ** (d - r.depth) * (2 ** (6 - d) - 1) for d in range(max(r.depth, 1), 7))


def test_empty_and_turnless(spark):
    rows = spark.createDataFrame([Row(conv_id=None, turn=1, role="a", text="b")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.digest(rows).count() == 0 and prefix_trie.digest(rows.limit(0)).count() == 0
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [Row(conv_id=short, turn=1, role="a", text="b")]
    want = brute(rows)
    assert want == found(prefix_trie.digest(spark.createDataFrame(rows))) and want[0][:7] == (short, 0, None, 1, 0, 1, 0)
