"""SimHash near-duplicates, found with a Gray-ordered hierarchical index.

Fingerprints that differ in at most two bits agree on at least one of three
segments (pigeonhole), so each is sent to three buckets (mask, masked value).
Inside a bucket fingerprints are sorted by Gray rank, runs of them become leaf
groups, runs of groups become upper nodes; a node keeps the bits all below it
share, factored out of the nodes under it. A probe walks from the top, adds up
the differences on each node's own bits and drops a whole group as soon as the
sum exceeds the limit. A bucket above BUCKET fingerprints is split by agreeing
on a third of the bits still free (pigeonhole again, so no link is lost), level
by level, until it fits.

Buckets emit a spanning forest of their links, never all pairs; components come
from alternating stars over those edges.

Defined results: a null or empty text has fingerprint 0 and links like any
other; a text of fewer words than a shingle is one shingle, of very long texts
every shingle counts; repeated rows and equal fingerprints (ties) share a component;
a null doc_id takes part, but names a component only if it has no other id; an empty
table gives an empty result; near_duplicates reads doc_id and text only, keep_one
returns all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import columns, fresh, materialise, own, release, spread_join, texts

WORDS = 3
SEED = 42
BITS = 2
#: Fingerprints of a bucket beyond which it is split further.
BUCKET = 20_000
#: Children of an index node.
FAN = 16
FULL = (1 << 64) - 1
_CHUNK = 255 * 256


def _ones(part: bytes) -> np.ndarray:
    """How many of the hashes (8 bytes each, the first bit first) have each bit set."""
    bits = np.unpackbits(np.frombuffer(part, np.uint8)).view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # a byte holds 255 ones
    return np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_of_set(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of distinct shingles' hashes, each counting once."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += _ones(hashes[at : at + _CHUNK].astype(">u8").tobytes())
    return _majority(counts, len(hashes))


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; bytes.lower and bytes.split know ASCII only, as wanted."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        counts += _ones(b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : min(n, at + _CHUNK)], last[at : at + _CHUNK])]))
    return _majority(counts, n)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t, words, seed)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order: the prefix XOR of its bits."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def split_mask(mask: int, parts: int) -> list[int]:
    """mask joined with each of `parts` runs of the bits that are still free."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order."""

    def __init__(self, sorted_fps: np.ndarray, fan: int = FAN):
        self.fps, self.fan = sorted_fps, fan
        ones, zeros = sorted_fps, ~sorted_fps
        levels = []
        while True:
            at = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            levels.append((ones, ones | zeros))  # pattern and mask of the shared bits
            if len(ones) == 1:
                break
        self.levels = levels[::-1]

    def within(self, probes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, position of a fingerprint) at most `limit` bits apart."""
        who, node = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        pattern, mask = self.levels[0]
        sums = np.bitwise_count((probes ^ pattern[0]) & mask[0]).astype(np.int64)
        keep = sums <= limit
        who, node, sums = who[keep], node[keep], sums[keep]
        above = mask
        for pattern, mask in [*self.levels[1:], (self.fps, np.full(len(self.fps), FULL, np.uint64))]:
            reps = np.minimum(self.fan, len(pattern) - node * self.fan)
            parent = np.repeat(node, reps)
            first = np.repeat(np.cumsum(reps) - reps, reps)
            child = parent * self.fan + np.arange(len(parent)) - first
            who, sums = np.repeat(who, reps), np.repeat(sums, reps)
            own = mask[child] & ~above[parent]
            sums = sums + np.bitwise_count((probes[who] ^ pattern[child]) & own)
            keep = sums <= limit
            who, node, sums, above = who[keep], child[keep], sums[keep], mask
        return who, node


def forest(fps: np.ndarray, limit: int, block: int = 512) -> list[tuple[int, int]]:
    """Edges that connect all fingerprints of a bucket that links connect: fewer than the bucket has members."""
    index, root, edges = GrayIndex(fps), list(range(len(fps))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(fps), block):
        who, found = index.within(fps[at : at + block], limit)
        who = who + at
        roots = np.array(root)
        later = (found > who) & (roots[found] != roots[who])
        for a, b in zip(who[later].tolist(), found[later].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[y] = x
                edges.append((a, b))
    return edges


def _bucket_edges(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by bucket and Gray rank; a bucket may run over the end of a batch."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        mask, key, fps = (np.zeros(0, np.int64) for _ in range(3))

        def linked(cut: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            for s, e in zip(cut, cut[1:]):
                if e - s > 1:
                    own = values[s:e]
                    for x, y in forest(own.view(np.uint64), limit):
                        a.append(int(own[x]))
                        b.append(int(own[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            mask, key, fps = (np.concatenate(x) for x in zip((mask, key, fps), new))
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            if len(edge):
                yield linked(np.concatenate(([0], edge)), fps)
                mask, key, fps = mask[edge[-1] :], key[edge[-1] :], fps[edge[-1] :]
        if len(fps):
            yield linked(np.array([0, len(fps)]), fps)

    return run


def links(nodes: DataFrame, limit: int = BITS, bucket: int = BUCKET, levels: int | None = None) -> DataFrame:
    """Edges (a, b) among distinct fingerprints `fp` that connect whatever links of at most `limit` bits connect.

    levels: split large buckets so many times at most; what is still larger is dealt out by a hash, and links
    between its parts are left to the caller.
    """
    masks = split_mask(0, limit + 1)
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    fit, level = None, 0
    while True:
        hot = rows.groupBy("mask", "key").agg(F.count("*").alias("held")).where(F.col("held") > bucket)
        hot = materialise(hot, "hot-buckets")
        if not hot.head(1):
            break
        if level == levels:
            part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("held") / bucket))
            rows = rows.join(hot, ["mask", "key"], "left").select("fp", "mask", F.when(F.col("held").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)).alias("key"))
            break
        hot, level = hot.drop("held"), level + 1
        if 1 << 64 - masks[0].bit_count() <= bucket:  # so few free bits leave no room for more fingerprints
            break
        cold = rows.join(hot, ["mask", "key"], "left_anti")
        fit = cold if fit is None else fit.unionByName(cold)
        deeper = {m: split_mask(m, limit + 1) for m in masks}
        masks = sorted({x for v in deeper.values() for x in v}, key=int.bit_count)
        children = F.create_map(*[x for m, v in deeper.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in v]))])
        rows = rows.join(hot, ["mask", "key"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    rows = rows if fit is None else fit.unionByName(rows)
    rows = rows.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("fp")))
    return rows.mapInArrow(_bucket_edges(limit), "a long, b long")


def grouped(docs: DataFrame, words: int = WORDS, seed: int = SEED, limit: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row of docs."""
    prints = materialise(fingerprints(docs, words, seed), "fingerprints")
    return named(prints, links(prints.select("fp").distinct(), limit))


def named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row of prints; root, the smallest fingerprint of the component, is its own even where two components share their smallest id."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("label"))
    roots = materialise(components(edges), "roots")
    member = nodes.join(roots, nodes["fp"] == roots["node"]).select("node", "root", "label")
    lowest = member.groupBy("root").agg(F.min("label").alias("low"))
    linked = spread_join(member, lowest, "root").select("node", "low", "root")
    found = nodes.join(linked, nodes["fp"] == linked["node"], "left")
    alone = F.col("root").isNull()
    labels = materialise(
        found.select(F.col("fp").alias("k"), F.when(alone, F.col("label")).otherwise(F.col("low")).alias("component_id"), F.coalesce("root", "fp").alias("root")), "labels"
    )
    release(roots)
    return prints.join(labels, prints["fp"] == labels["k"]).select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    return grouped(docs, **how).drop("root")


def _with_fingerprint(docs: DataFrame, name: str, mark: Callable[[str], int]) -> DataFrame:
    """docs with one more column, what mark says of the text."""

    @F.arrow_udf("long")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([mark(t.as_py() or "") for t in batch], pa.int64())

    return docs.withColumn(name, marked(docs["text"]))


def keep_one(docs: DataFrame, words: int = WORDS, seed: int = SEED, limit: int = BITS) -> DataFrame:
    """The rows of docs that stay: of each group one with its smallest id.

    Rows that repeat an id are told apart by what they say: each group that such
    an id names keeps its own row, the one with the smallest fingerprint, then the
    smallest hash. Rows without an id stay: no other row can be told to stand for them.
    """
    return kept(docs, grouped(docs, words, seed, limit), lambda text: _signed(fingerprint(text, words, seed)))


def kept(docs: DataFrame, rows: DataFrame, mark: Callable[[str], int]) -> DataFrame:
    """keep_one for the groups that rows name; mark is their fp, of a text."""
    rows = rows.where(F.col("doc_id").isNotNull())
    names = F.max(F.col("doc_id") == F.col("component_id"))
    kept_id, kept_fp, mine, row, marks, ident = fresh(docs.columns, "kept_id", "kept_fp", "mine", "row", "marks", "ident")
    keepers = materialise(rows.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias("n"), names.alias("names")).where("names"), "keepers")
    once, often = (keepers.where(c).select(kept_id) for c in ("n = 1", "n > 1"))
    # keepers grow with the documents: never broadcast, one plan at every size
    stay = docs.join(once.hint("merge"), docs["doc_id"] == once[kept_id], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    if not often.head(1):
        return stay
    chosen = rows.where(F.col("doc_id") == F.col("component_id")).join(often, F.col("doc_id") == F.col(kept_id), "left_semi")
    chosen = materialise(chosen.groupBy(F.col("doc_id").alias(kept_id), "root").agg(F.min("fp").alias(kept_fp)), "chosen")
    marked = _with_fingerprint(docs.join(often, docs["doc_id"] == often[kept_id], "left_semi"), mine, mark)
    marked = marked.join(chosen, (marked["doc_id"] == chosen[kept_id]) & (marked[mine] == chosen[kept_fp]), "left_semi")
    every = F.struct(*columns(docs))
    first = F.min_by(every, F.struct(F.md5("text"), F.xxhash64(F.to_json(every))))
    best = marked.groupBy(F.col("doc_id").alias(ident), own(marked, mine).alias(marks)).agg(first.alias(row))
    return stay.unionByName(best.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))
