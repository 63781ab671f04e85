"""The prefix trie against every prefix counted in Python, the SQL oracle, cuts into blocks, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import same
from pyspark.sql import functions as F

from sparkloom.llm import trie
from sparkloom.llm.queries import ORACLES, QUERIES


def plain_rebuilt(rows):
    own = defaultdict(list)
    for i, turn, role, text in rows:
        if i is not None:
            own[i].append((turn is not None, turn or 0, role or "", text or ""))
    own = {i: [(r, t) for _, _, r, t in sorted(v)] for i, v in own.items()}
    cut = lambda i: i - (i % 20 if i >= 0 else -(-i % 20))
    return {i: own.get(cut(i), [])[: zlib.crc32(str(i).encode()) % 4] + v[zlib.crc32(str(i).encode()) % 4 :] for i, v in own.items()}


def plain_trie(convs):
    """Rows as tuples in the order of trie.OUT, from {conv_id: list of (role, text)}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for i, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(i)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(i)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in trie.OUT) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def family(seed, n):
    """Conversations with shared heads, copies, prefixes of one another and lone ones."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.random()
        texts = ["hello there", "same  old line", "ok"][: rng.randint(0, 3)] if kind < 0.5 else [f"w{rng.randint(0, 2)} x" for _ in range(rng.randint(1, 6))]
        rows += [(i, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts or ["x"])]
    return rows


def test_query_equals_the_oracle(spark, sf_dir, duck):
    same(QUERIES["op12_conversation_prefix_trie"](spark, sf_dir).toPandas(), duck.execute(ORACLES["op12_conversation_prefix_trie"]).df())


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_equals_brute_force_in_any_blocks(spark, monkeypatch, blocks):
    """Intervals inside a block, over two, and over all of them, among them copies that fill several blocks."""
    monkeypatch.setattr(trie, "session_parts", lambda _: blocks)
    rows = family(blocks, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.nodes(df)) == plain_trie(plain_rebuilt(rows))


def test_blocks_walked_one_by_one_equal_one_walk():
    """Every cut of a sorted list into two blocks gives parts that add up to the nodes of one block."""
    convs = sorted((b"".join(bytes([t]) * trie.WIDTH for t in turns), i, [t for t in turns]) for i, turns in enumerate([[], [1], [1], [1, 2], [1, 2, 3], [1, 3], [2], [2, 2], [2, 2], [4]]))
    rows = [(i, s, w) for s, i, w in convs]
    whole = {(r[1], r[2]): r[7:11] for r in trie.walk(0, iter(rows), -1, -1)}
    for cut in range(1, len(rows)):
        shared = trie.common(rows[cut - 1][1], rows[cut][1])
        parts = [*trie.walk(0, iter(rows[:cut]), -1, shared), *trie.walk(1, iter(rows[cut:]), shared, -1)]
        found = {(r[1] + r[0] * cut, r[2]): list(r[7:11]) for r in parts if r[4]}
        for r in parts:
            if not r[4]:
                at = max(k for k in found if k[1] == r[2] and k[0] < cut)
                found[at] = [a + b for a, b in zip(found[at], r[7:11])]
        before = {(r[1] + r[0] * cut, r[2]): r[11] for r in parts if r[4] and not r[13]}
        for k, b in before.items():
            found[k][3] -= (found[k][0] - 1) * b
        assert {k: tuple(v) for k, v in found.items()} == whole


def test_odd_rows(spark):
    """Null turns, roles, texts and ids, ties, repeated rows, negative ids, turnless conversations, clashing names."""
    rows = [
        (0, None, "user", "first"), (0, 0, None, "second  one"), (0, 1, "user", None), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, None, None, None), (-3, 1, "user", "b"), (-3, 0, "user", "c"),
        (None, 0, "user", "lost"), (41, 0, "user", "z"), (47, 0, "user", "z"), (52, 3, "user", "é " * 60_000), (9_000_000_000, 0, "user", "first"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("v").alias(n) for n in ("block", "seq", "words", "turns", "depth", "h", "source", "start", "ends", "up", "at", "salt", "d", "w")])
    assert got(trie.nodes(df)) == plain_trie(plain_rebuilt(rows))
    assert any(not turns for turns in plain_rebuilt(rows).values())
    assert got(trie.nodes(df.limit(0))) == []


def test_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 2500 + c else f"own {c} {t}") for c in (20, 21, 22) for t in range(3000)]
    assert got(trie.nodes(spark.createDataFrame(rows, SCHEMA))) == plain_trie(plain_rebuilt(rows))
