"""The trie against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

from trustfold.llm import conversation_trie
from trustfold.llm.conversation_trie import placed_turns, prefix_trie, with_shared_starts


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, convs in members.items():
        inside = [v for v in members if v[: len(node)] == node]
        childless = [v for v in inside if not any(w[: len(v)] == v and len(w) == len(v) + 1 for w in members)]
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.add((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(w) == len(node) + 1 for w in inside), len(childless),
            sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in inside if v), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def found(df):
    return {tuple(r) for r in prefix_trie(*with_shared_starts(placed_turns(df))).collect()}


SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def talks(seed, convs=60):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(200), convs):
        for t in range(draw.randint(1, 7)):
            rows.append((c, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None, "😀 long"])))
    return rows + [(500 + c, t, "user", "the same") for c in range(40) for t in range(3)] + [rows[0], (None, 1, "user", "no conversation")]


def test_equals_brute_force(spark):
    rows = talks(1)
    assert found(table(spark, rows)) == brute(rows)


def test_blocks_of_long_conversations_and_of_members(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", 4)
    monkeypatch.setattr(conversation_trie, "BLOCK_MEMBERS", 3)
    rows = talks(2, 20) + [(c, t, "user", f"{t % 3}") for c in (700, 705) for t in range(12)]
    assert found(table(spark, rows)) == brute(rows)


def test_conversations_without_turns_and_empty_tables(spark):
    short = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(short, 0, "user", "taken away")]
    assert found(table(spark, rows)) == brute(rows) == {(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())}
    assert found(table(spark, [(None, None, None, None)])) == set()
