"""Near-duplicates by the general rule: five-word shingles, Jaccard similarity 0.8 or more.

A text is the set of its shingles' hashes; equal sets are one node. SimHash comes
first: nodes whose 64-bit fingerprints differ in at most BITS bits are found by the
SimHash operator's Gray-ordered index, checked by the exact Jaccard of the two
sets, and joined into components.

Fingerprints alone can't find all: two texts of Jaccard 0.8 differ in some ten of 64
bits, and no index by agreeing segments reaches that far. What they leave in
different components goes the exact way: candidates are nodes that agree on all ROWS minima of one of BANDS groups of minhashes; a
pair at 0.8 shares a bucket but for a probability of (1 - 0.8^5)^30 = 7e-6. In a
bucket the nodes that have the most company are pivots; every node is compared with
the pivots of its buckets by the exact Jaccard of the two sets: first with one
pivot, then, where that leaves a bucket in several components, with the next ones.
Links pass on through components, so after that a bucket of up to PIVOTS + 1 nodes is
done, and so is a larger one whose nodes have met. What is left, larger buckets in
several components, goes through an exact join by prefixes: with the hashes of each
set in order of frequency, rarest first, two sets of Jaccard 0.8 share one of their
first fifth, so sets meet by those hashes only, and not where a template is all that they
share. No pair of a bucket that could join two components is left undecided.

Defined results: as for the SimHash operator's keep_one; null and empty texts are
one empty set; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.layout import skew_join

from . import simhash
from .components import components
from .shared import materialise, release, spread_join, texts

WORDS = 5
SEED = 42
#: Similarity as a fraction of whole numbers, so that the limit itself is met exactly.
SHARE = (4, 5)
#: Bits in which fingerprints of candidates differ at most, fingerprints of an index bucket, and how often larger ones are split.
BITS, BUCKET, LEVELS = 6, 5_000, 2
BANDS, ROWS = 30, 5
#: Nodes of a bucket that all others are compared with.
PIVOTS = 16
#: Pairs of one node that meet in a task.
PAIRS = 256
_CHUNK = 1024
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words are split and lowered as for fingerprints."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(tokens)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(words, len(tokens)) - 1 :] if tokens else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, last)), np.uint64))


def set_key(hashes: np.ndarray) -> int:
    """One signed long for a set."""
    return simhash._signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def _print(hashes: np.ndarray) -> int:
    return simhash._signed(simhash.fingerprint_of_set(hashes))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _CHUNK):
        np.minimum(low, ((short[at : at + _CHUNK, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return ((low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the exact Jaccard of two sets reaches SHARE."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SHARE[1] >= (len(a) + len(b) - both) * SHARE[0]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n, print, bands) of every row; fp is the key of its set, print the set's SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            longs = [batch.column(0).cast(pa.int64()), *(pa.array(map(f, sets), pa.int64()) for f in (set_key, len, _print))]
            yield pa.RecordBatch.from_arrays([*longs, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "fp", "n", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, n long, print long, bands array<long>")


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, shingles) of the needed (fp, label)."""
    ids = needed.select(F.col("label").alias("needed_id")).where("needed_id IS NOT NULL").distinct().hint("merge")
    found = docs.select(F.col("doc_id").cast("long"), "text")
    found = found.join(ids, found["doc_id"] == ids["needed_id"], "left_semi").unionByName(found.where("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    made = found.mapInArrow(run, "node long, shingles binary")
    made = made.join(needed, made["node"] == needed["fp"], "left_semi")
    return materialise(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near) of every pair. A pivot stands in the pairs of all its bucket: its pairs are dealt over tasks, and its set repeated for each."""
    pairs = materialise(pairs, "pairs")
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "s"), ("b", "t")))
    both = F.xxhash64("a", "b")
    given = skew_join(pairs, left, "a", rows=PAIRS, row_id=both).select("a", "b", "s")
    given = skew_join(given, right, "b", rows=PAIRS, row_id=both, counted=pairs).select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k)]) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(alike, s, t), pa.bool_())], ["a", "b", "near"])

    return given.mapInArrow(run, "a long, b long, near boolean")


def _compared(members: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near) of members (key, fp, n, weight, root) with the pivots of their bucket that come before them and that links haven't joined them with yet."""
    pivot = F.struct("fp", "n", "weight", "root")
    packed = pivots.groupBy("key").agg(F.collect_list(pivot).alias("pivots"))  # at most PIVOTS of a bucket
    pairs = spread_join(members, packed, "key", 4).withColumn("p", F.explode("pivots"))
    behind = (F.col("weight") < F.col("p.weight")) | ((F.col("weight") == F.col("p.weight")) & (F.col("fp") > F.col("p.fp")))
    likely = F.least("n", "p.n") * SHARE[1] >= F.greatest("n", "p.n") * SHARE[0]
    pairs = pairs.where(behind & likely & (F.col("root") != F.col("p.root")))
    pairs = pairs.select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b")).distinct()
    return materialise(_decided(pairs, sets), "decided")


def _by_prefix(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near) of the pairs of nodes (fp, root, n) of different roots that may reach SHARE: exact, no pair at SHARE is missing."""
    given = sets.join(nodes, sets["node"] == nodes["fp"]).select("fp", "root", "n", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], ["fp", "root", "n", "hashes"])

    spelt = given.mapInArrow(run, "fp long, root long, n long, hashes array<long>")
    spelt = materialise(spelt.select("fp", "root", "n", F.explode("hashes").alias("hash")), "spelt")
    # a hash of one set alone takes a place in that set's prefix, but meets nothing
    often = spelt.groupBy("hash").agg(F.count("*").alias("sets"), F.min("root").alias("low"), F.max("root").alias("high")).where("sets > 1")
    shared = spread_join(spelt, often, "hash", 4)
    by_set = Window.partitionBy("fp")
    singles = F.col("n") - F.count("*").over(by_set)
    placed = shared.withColumn("place", singles + F.row_number().over(by_set.orderBy("sets", "hash")))
    least = F.floor((F.col("n") * SHARE[0] + SHARE[1] - 1) / SHARE[1])  # hashes that a set shares with any near one
    first = materialise(placed.where((F.col("place") <= F.col("n") - least + 1) & (F.col("low") != F.col("high"))).select("hash", "fp", "root", "n", "place"), "prefixes")
    # the sets of one hash are dealt over tasks: one side by a salt, the other to each
    one = first.select("hash", *(F.col(c).alias(f"{c}_1") for c in ("fp", "root", "n", "place")), F.pmod("fp", F.lit(8)).alias("salt"))
    two = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("salt", F.col("salt").cast("long"))
    pairs = one.join(two, ["hash", "salt"]).where((F.col("fp_1") < F.col("fp")) & (F.col("root_1") != F.col("root")))
    # at the first hash that a near pair has in common the rest must stand behind it in both; at later ones the pair needn't meet again
    most = F.least(F.col("n_1") - F.col("place_1"), F.col("n") - F.col("place")) + 1
    pairs = pairs.where(most * (SHARE[0] + SHARE[1]) >= (F.col("n_1") + F.col("n")) * SHARE[0])
    found = materialise(_decided(pairs.select(F.col("fp_1").alias("a"), F.col("fp").alias("b")).distinct(), sets), "by-prefix")
    release(spelt, first)
    return found


def _by_fingerprint(marks: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes whose fingerprints the SimHash index links."""
    prints = marks.groupBy("fp").agg(F.first("print").alias("print"))
    firsts = materialise(prints.groupBy("print").agg(F.min("fp").alias("first"), F.count("*").alias("sets")), "prints")
    found = simhash.links(firsts.select(F.col("print").alias("fp")), BITS, BUCKET, LEVELS).distinct()
    for end in ("a", "b"):
        found = found.join(firsts.select(F.col("print").alias(end), F.col("first").alias(f"{end}_first")), end)
    found = found.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    equal = spread_join(prints, firsts.where("sets > 1").select("print", "first"), "print", 4).where("fp <> first")
    return materialise(found.unionByName(equal.select(F.col("first").alias("a"), F.col("fp").alias("b"))), "by-fingerprint")


def _stars(roots: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what roots has in one component."""
    return roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _near(decided: DataFrame) -> DataFrame:
    return decided.where("near").select("a", "b")


def links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges (a, b) among set keys that connect whatever links of Jaccard SHARE or more connect; marks are the signatures of docs."""
    alike_prints = _by_fingerprint(marks)
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = nodes.select("fp", "label", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = materialise(spread_join(rows, shared, "key", 4).select("key", "fp", "label", "n", "size"), "bands")
    ends = alike_prints.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    others = nodes.join(ends, nodes["fp"] == ends["end"], "left_semi").select("fp", "label", F.lit(0).cast("long").alias("size"))
    needed = rows.select("fp", "label", "size").unionByName(others)
    needed = materialise(needed.groupBy("fp", "label").agg(F.sum("size").alias("weight")), "candidates")
    sets = _sets(docs, needed)
    first = materialise(components(_near(_decided(alike_prints, sets))), "joined-by-fingerprint")

    def rooted(part: DataFrame, roots: DataFrame) -> DataFrame:
        part = part.drop("root")
        return part.join(roots, part["fp"] == roots["node"], "left").select(*part.columns, F.coalesce("root", "fp").alias("root"))

    def parted(members: DataFrame) -> DataFrame:
        ends = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("nodes"))
        return ends.where("low <> high").select("key", "nodes")

    members = rows.join(needed.select(F.col("fp").alias("w"), "weight"), F.col("fp") == F.col("w")).select("key", "fp", "n", "weight")
    members = materialise(rooted(members, first), "members")
    # row_number with a limit is cut to PIVOTS rows of a bucket in each task before anything is shuffled
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "fp"))
    pivots = materialise(members.withColumn("place", place).where(F.col("place") <= PIVOTS), "pivots")
    seen = _compared(members, pivots.where("place = 1"), sets)
    roots = materialise(components(_stars(first).unionByName(_near(seen))), "joined")
    members, before = materialise(rooted(members, roots), "members"), members
    apart = materialise(parted(members), "apart")
    more = _compared(spread_join(members, apart.select("key"), "key", 4), rooted(pivots.where("place > 1"), roots), sets)
    found = _stars(roots).unionByName(_near(more))
    large = apart.where(F.col("nodes") > PIVOTS + 1).select("key")
    if large.head(1):
        again = materialise(components(found), "joined-again")
        held = rooted(spread_join(members, large, "key", 4), again)
        left = spread_join(held, parted(held).select("key"), "key", 4).groupBy("fp").agg(F.first("root").alias("root"), F.first("n").alias("n"))
        left = materialise(left, "left")
        found = _stars(again)
        if left.head(1):
            found = found.unionByName(_near(_by_prefix(left, sets)))
        release(left)
    release(alike_prints, rows, needed, sets, first, pivots, before, members, apart)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group one with its smallest id; repeated and missing ids as in simhash.keep_one."""
    marks = materialise(signatures(docs), "signatures")
    return simhash.kept(docs, simhash.named(marks.select("doc_id", "fp"), links(docs, marks)), lambda text: set_key(shingle_set(text)))
