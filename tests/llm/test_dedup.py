"""SimHash: fingerprints by definition, components and links against brute force."""

from __future__ import annotations

import random
import re
from functools import reduce
from operator import xor

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.llm.components import components
from sparkloom.llm.queries import QUERIES


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "A", "A b", "a B c", "a b c d \x1c e", "Été İ x y", "w " * 1000, " ".join(map(str, range(700)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == by_definition(text)


def brute_components(pairs):
    """(id, fp) to the smallest id reachable by links of two bits."""
    fps = [int(f, 16) for _, f in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(pairs):
        low[find(n)] = min(i, low.get(find(n), i))
    return [low[find(n)] for n in range(len(pairs))]


def test_query_against_brute_force(spark, sf_dir):
    rows = QUERIES["op9_simhash_gray_index"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.fingerprint == f"{by_definition(texts[r.doc_id]):016x}" for r in rows)
    assert brute_components([(r.doc_id, r.fingerprint) for r in rows]) == [r.component_id for r in rows]


def test_index_finds_every_pair():
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(6)}
    ranked = np.array(sorted(fps, key=lambda f: reduce(xor, (f >> k for k in range(64)))), np.uint64)
    who, found = simhash.GrayIndex(ranked).within(ranked, 2)
    want = {(a, b) for a in range(len(ranked)) for b in range(len(ranked)) if int(ranked[a] ^ ranked[b]).bit_count() <= 2}
    assert set(zip(who.tolist(), found.tolist())) == want


def test_hot_buckets_are_split_without_loss(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, bucket=100)).collect()}
    want = brute_components([(simhash._signed(f), f"{f:x}") for f in fps])
    assert {simhash._signed(f): w for f, w in zip(fps, want) if sum((f ^ g).bit_count() <= 2 for g in fps) > 1} == got


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (1, 2), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (3, "", 2), (None, "a b c", 3), (9, "a b c", 4), (8, "other words here now", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (-1, 9), (3, 3), (3, 3), (5, 3), (8, 8), (9, 9)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3, 8, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.where(F.lit(False))).count() == 0


def test_repeated_ids_keep_a_row_of_each_group_they_name(spark):
    one, two, three = ("alpha beta gamma delta", "ten green bottles on a wall", "nothing like the others at all here")
    rows = [(5, one, "x"), (5, two, "x"), (5, two, "y"), (7, two, "z"), (3, three, "x"), (5, three, "x"), (6, one, "x"), (None, one, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp0 string")
    want = [(3, three), (5, one), (5, two), (None, one)]
    for given in (docs, docs.orderBy(F.desc("_fp0"))):
        kept = simhash.keep_one(given)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (r[0] or 99, r[1])) == want
    assert len({tuple(sorted(map(str, simhash.keep_one(d).collect()))) for d in (docs, docs.orderBy(F.desc("_fp0")))}) == 1


def test_buckets_that_stay_large_are_dealt_out(spark):
    """With no split allowed every fingerprint still stands in a bucket, none much above the size, and all edges are links."""
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.links(nodes, bucket=100, levels=0).collect()
    assert edges and all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in edges)
    assert len({x for r in edges for x in r}) > 250


def test_a_round_of_components_reads_its_edges_four_times(spark, tmp_path):
    """The driver keeps every plan of every round: before, a round held its input sixteen times."""
    from sparkloom.llm import components as stars

    spark.range(50).selectExpr("id + 1 AS u", "id AS v").write.parquet(str(tmp_path / "edges"))
    step = stars._small(stars._large(spark.read.parquet(str(tmp_path / "edges"))).distinct())
    assert step._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4
