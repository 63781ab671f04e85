"""The near-dedup stage of the pipeline against brute-force pairs of five-word Jaccard 0.8."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import near


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(texts):
    """Smallest ids of the components of pairs at 0.8 or more."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids[: ids.index(a)]:
            both = len(sets[a] & sets[b])
            if both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [i for i in ids if find(i) == i]


def test_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_kept({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == want


def test_pivots_join_what_the_first_one_does_not(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w if k % 80 != i else f"x{i}" for k, w in enumerate(words))) for i in range(1, 12)]
    rows += [(20, " ".join(words[:330])), (21, " ".join(words[:270])), (22, " ".join(words[:215])), (23, "a b"), (24, "A  b"), (25, None), (26, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(docs).collect()) == brute_kept(dict(rows))


def test_exactly_the_limit_is_near():
    a = np.arange(10, dtype=np.uint64)
    assert near.alike(a, a[:8]) and not near.alike(a, a[:7]) and near.alike(a[:0], a[:0]) is True


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long + " more"), (5, "something else"), (7, "something else"), (None, long), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near.keep_one(docs)
    got = sorted((r.doc_id or 99, r.text.split()[0]) for r in kept.collect())
    assert kept.columns == docs.columns and got == [(3, "one"), (5, "something"), (5, "w0"), (99, "w0")]
    assert near.keep_one(docs.where(F.lit(False))).count() == 0


def test_large_bucket_loses_no_link(spark):
    """All texts in one bucket: far more families on one template than there are pivots, each of near copies."""
    core = [f"c{i}" for i in range(60)]
    texts = {}
    for family in range(25):
        mine = core + [f"f{family}x{i}" for i in range(60)]
        for copy in range(3):
            texts[family * 3 + copy + 1] = " ".join(w if k != 70 + 10 * copy else f"y{family}{copy}" for k, w in enumerate(mine))
    texts |= {200: "a b c", 201: "a b c d e f g", 202: " ".join(core), 203: " ".join([*core, "more"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = near.signatures(docs).withColumn("bands", F.array(F.lit(0).cast("long")))
    found = near.simhash.named(marks.select("doc_id", "fp"), near.links(docs, marks))
    assert sorted(r.component_id for r in found.select("component_id").distinct().collect()) == brute_kept(texts)


def test_prefixes_find_every_near_pair(spark):
    rng = np.random.default_rng(3)
    words = [[f"w{i}" for i in range(n)] for n in (6, 9, 30, 90)]
    texts = [" ".join(w if rng.random() > share else f"v{rng.integers(40)}" for w in base) for base in words for share in (0.0, 0.01, 0.03, 0.3) for _ in range(8)]
    own = {near.set_key(s): s for s in map(near.shingle_set, texts)}
    sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in own.items()], "node long, shingles binary")
    nodes = spark.createDataFrame([(k, k, len(s)) for k, s in own.items()], "fp long, root long, n long")
    got = {(r.a, r.b) for r in near._by_prefix(nodes, sets).where("near").collect()}
    assert got == {(a, b) for a in own for b in own if a < b and near.alike(own[a], own[b])} and len(got) > 10


def test_fingerprints_come_first(spark):
    """The SimHash index alone finds the pairs of at most BITS bits, and no other; what it joins is not compared again by buckets."""
    rng = np.random.default_rng(5)
    words = [[f"w{k}x{i}" for i in range(400)] for k in range(6)]
    texts = [" ".join(w if i not in rng.integers(0, 400, edits) else "y" for i, w in enumerate(base)) for base in words for edits in (0, 1, 2, 4, 12)]
    docs = spark.createDataFrame([*enumerate([*texts, texts[0], "", None])], "doc_id long, text string")
    marks = near.materialise(near.signatures(docs), "test-signatures")
    prints = {r.fp: r.print % 2**64 for r in marks.collect()}
    got = {(r.a, r.b) for r in near._by_fingerprint(marks).collect()}
    apart = {(a, b): (prints[a] ^ prints[b]).bit_count() for a in prints for b in prints if a < b}
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    assert len(got) >= 6 and all(apart[p] <= near.BITS for p in got)
    assert all(find(a) == find(b) for (a, b), bits in apart.items() if bits <= near.BITS)
    bare = marks.withColumn("bands", F.lit(None).cast("array<long>"))
    assert {(r.a, r.b) for r in near.links(docs, bare).collect()} and near.links(docs, bare).where("a = b").isEmpty()


def test_fingerprint_of_a_set_is_the_majority_of_its_hashes():
    hashes = np.random.default_rng(6).integers(0, 1 << 63, 70_001, np.uint64) * np.uint64(2)
    for some in (hashes[:0], hashes[:1], hashes[:6], hashes):
        want = sum(1 << b for b in range(64) if 2 * int((some >> np.uint64(b) & np.uint64(1)).sum()) > len(some))
        assert near.simhash.fingerprint_of_set(some) == want
