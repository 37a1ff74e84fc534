"""The trie against one built turn by turn in plain Python: nulls, ties, repeats, hot prefixes, conversations of many blocks."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from pressloom.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, at int, id string, block int, a string"


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, children, parent = defaultdict(list), defaultdict(set), {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        parent[node] = min(members[node[:-1]]) if node else None
    ends = {n: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)) for n, m in members.items()}
    return sorted([(min(m), len(n), parent[n], len(m), len(children[n]), leaves[n], saved[n], sha256(ends[n].encode()).hexdigest()) for n, m in members.items()], key=str)


def got(spark, rows):
    return sorted(map(tuple, conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def row(c, turn, role, text):
    return (c, turn, role, text, 1, "x", 2, "y")


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            said = "common" if turn < 3 and c % 3 == 0 else rng.choice(["a", "bb", "", "é𝄞", None])
            rows.append(row(c, turn, rng.choice(["user", "assistant", None]) if turn > 2 else "user", said))
    return rows


def test_empty(spark):
    assert got(spark, []) == []


def test_nulls_and_ties(spark):
    rows = [row(1, None, "user", "late"), row(1, 0, None, None), row(1, 0, None, None), row(1, 0, "user", "a"), row(None, 0, "user", "lost"), row(100, 3, "user", "x" * 300_000), row(101, 0, "user", "y"), row(150, 5, "user", "z"), row(-7, 0, "user", "a")]
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_short(spark, seed):
    rows = conversations(seed, 260, 9)
    assert got(spark, rows) == expected(rows)


def test_long_conversations_and_small_shares(spark, monkeypatch):
    """Many blocks, many shares, few ids to a string, keys over the bound of hot ones."""
    monkeypatch.setattr(conversation_trie, "SHARE", 3)
    monkeypatch.setattr(conversation_trie, "IDS", 2)
    monkeypatch.setattr(conversation_trie, "HOT", 4)
    rows = conversations(3, 30, 20)
    for c in range(200, 230):  # one long story, told to different ends, and copies of it
        length = 70 if c % 2 else 40 + c % 7
        rows += [row(c, t, "user", f"turn {t}" if t < length - c % 3 else f"end {c % 5}") for t in range(length)]
    assert got(spark, rows) == expected(rows)
