"""Prefix trie of conversations: one row for each distinct sequence of first turns.

Conversations are sorted by the digests of their turns, equal ones by id, and dealt in
ranges to blocks. Next to each stands the length of the prefix it has in common with the one
before (LCP). A node of depth d is a longest run of conversations of at least d turns with
an LCP of d or more between neighbours, an interval of the Cartesian tree over the LCP array: it
begins where the LCP is smaller than d and ends before the next smaller value. Nodes of
equal LCP inside one interval are one, and the depths between a node's LCP and its parent's
are nodes of the same interval, which the walk opens one by one.

Blocks are walked in parallel with a stack. An interval whose both smaller neighbours stand
in its block is done there. Others leave a part in every block: those open at its end
(the block's last prefix) and those that it didn't open (as deep as the LCP with the block
before, down to the block's minimum). Parts of one depth, in order of blocks, make
intervals: each begins with the part that opened it. Members, smallest id, leaves and
shared words are sums and minima over positions, so parts add up: position i is a leaf's
last member if the next LCP is smaller than its length, and the words that a node saves
are those of its positions' shared prefixes but for the first, less its own prefix's.

Blocks have at most about BLOCK_TURNS turns, so what a walk holds (the open path, and nodes
whose parent is open) is bounded, whatever a group of copies holds; digests of one conversation
are one value (16 bytes a turn), its texts never meet. The ids that end at a node are hashed where
they stand in sorted order; those of a node that crosses blocks are passed on as text of
one block each, and read in order, one at a time, as SHA-256 asks.

Defined results: null turns come first; turns with equal numbers in order of their
digests, repeated rows are turns; null role or text is empty; a null conv_id belongs to no
conversation and is left out; an empty table gives no rows, not even a root. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.layout import session_parts

from .mixing import word_count
from .shared import materialise, release

#: Every so many ids share the head of the first of them; a conversation takes fewer than HEADS turns of it.
SPAN, HEADS = 20, 4
WIDTH = 16
BLOCK_TURNS = 400_000
#: Copies of a parent that crosses blocks, so that its children don't meet in one task.
SALTS = 16
_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
OUT = (*_LONGS, "ends_sha256")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order, each a digest of role and text and the text's words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\n", F.length(role).cast("string"), role, text), 256), 1, 2 * WIDTH))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("d"), word_count(F.col("text")).alias("w"))
    # in the order of structs, null comes first
    each = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "w"))).alias("turns"))
    return each.select("conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the span's first conversation, then what its own has after h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = turns.select("conv_id", "turns", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % SPAN).alias("source"))
    heads = turns.where(F.col("conv_id") % SPAN == 0).select(F.col("conv_id").alias("source"), F.slice("turns", 1, HEADS - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "source", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _key(turns: Column) -> Column:
    """All digests of a conversation as one value, whose order is that of the sequences."""
    return F.array_join(F.transform(turns, lambda t: F.hex(t["d"])), "")


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests share at their beginning: halving, so long ones cost a few comparisons."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _edges(dealt: DataFrame) -> list[tuple[int, int]]:
    """(block, LCP with the block before) in order, -1 for the first: one number for each block, compared on the executors."""
    ends = dealt.groupBy("block").agg(F.min(F.struct("seq", "conv_id"))["seq"].alias("first"), F.max(F.struct("seq", "conv_id"))["seq"].alias("last"))
    pairs = ends.select("block", "first", F.lag("last").over(Window.orderBy("block")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [-1 if b is None else common(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int32())], ["block", "lcp"])

    return sorted((r["block"], r["lcp"]) for r in pairs.mapInArrow(run, "block int, lcp int").collect())


class Node:
    """An open node, or the part of one in this block: `start` is its place in the block, -1 if an earlier block opened it."""

    __slots__ = ("start", "depth", "before", "least", "members", "children", "leaves", "shared", "ends", "waiting")

    def __init__(self, start: int, depth: int, before: int):
        self.start, self.depth, self.before = start, depth, before  # words of the prefix without the last turn
        self.least: int | None = None
        self.members = self.children = self.leaves = self.shared = 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # done children, whose parent's smallest id isn't known yet

    def into(self, parent: Node) -> None:
        """Add what sums over positions to the node above."""
        if self.least is not None and (parent.least is None or self.least < parent.least):
            parent.least = self.least
        parent.members += self.members
        parent.leaves += self.leaves
        parent.shared += self.shared


def _ends(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def walk(block: int, rows: Iterator[tuple[int, bytes, list[int]]], lcp: int, after: int) -> Iterator[tuple]:
    """The nodes of a block and the parts of nodes that cross its borders.

    rows are (conv_id, digests, words by turn) in order; lcp and after are the LCPs at
    the block's borders. Yields (block, start, depth, parent_start, opened, parent_conv_id, conv_id,
    members, children, leaves, saved, words before, ends or their hash, done).
    """
    path = [Node(-1, d, 0) for d in range(lcp + 1)]
    last, place = None, 0

    def close(node: Node, parent: Node | None) -> Iterator[tuple]:
        """Leave a node inside the block: done if it was opened here."""
        if parent is not None:
            node.into(parent)
        done = node.start >= 0
        up = parent.start if parent is not None else None
        saved = node.shared - (node.members - 1) * node.before if done else node.shared
        told = hashlib.sha256(_ends(node.ends).encode()).hexdigest() if done else _ends(node.ends)
        row = (block, node.start, node.depth, up, done, None, node.least, node.members, node.children, node.leaves, saved, node.before, told, done)
        for child in node.waiting:
            yield (*child[:5], node.least if done else None, *child[6:])
        if done and parent is not None:
            parent.waiting.append(row)
        else:
            yield row

    def position(ended: tuple[int, bytes, list[int]], following: int) -> None:
        """Count a conversation at the node where it ends."""
        node = path[len(ended[2])]
        node.members += 1
        node.ends.append(ended[0])
        node.leaves += following < len(ended[2])
        if node.least is None or ended[0] < node.least:
            node.least = ended[0]

    for conv in rows:
        here = lcp if last is None else common(last[1], conv[1])
        if last is not None:
            position(last, here)
        while len(path) > here + 1:
            node = path.pop()
            yield from close(node, path[-1] if path else None)
        words = sum(conv[2][: max(here, 0)])  # of the shared prefix, which is that of the next node without its last turn
        if here >= 0:
            path[here].shared += words
        for d in range(here + 1, len(conv[2]) + 1):
            if path:
                path[-1].children += 1
            path.append(Node(place, d, words))
            words += conv[2][d - 1] if d else 0
        last, place = conv, place + 1
    if last is None:
        return
    position(last, after)
    while len(path) > after + 1:
        node = path.pop()
        yield from close(node, path[-1] if path else None)
    while path:
        node = path.pop()
        parent = path[-1] if path else None
        if parent is not None:
            node.into(parent)
        yield from ((*child[:5], None, *child[6:]) for child in node.waiting)
        yield (block, node.start, node.depth, parent.start if parent else None, node.start >= 0, None, node.least, node.members, node.children, node.leaves, node.shared, node.before, _ends(node.ends), False)


_PART = "block int, start int, depth int, parent_start int, opened boolean, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, before long, ends string, done boolean"
_NAMES = [c.split()[0] for c in _PART.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batches(rows: Iterator[tuple], schema: str, size: int = 8192, text: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length, also where single rows hold much text."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    held, chars = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*held), kinds)], list(names))
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or chars >= text:
            yield made()
            held, chars = [], 0
    if held:
        yield made()


def _walked(dealt: DataFrame, edges: list[tuple[int, int]], blocks: int) -> DataFrame:
    borders = {b: (lcp, edges[n + 1][1] if n + 1 < len(edges) else -1) for n, (b, lcp) in enumerate(edges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes, list[int]]]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)))

        source = rows()
        ahead = next(source, None)

        def of(block: int) -> Iterator[tuple[int, bytes, list[int]]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == block:
                yield ahead[1:]
                ahead = next(source, None)

        def all_blocks() -> Iterator[tuple]:
            while ahead is not None:
                block = ahead[0]
                yield from walk(block, of(block), *borders[block])

        yield from _batches(all_blocks(), _PART)

    placed = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "seq", "conv_id")
    return placed.select("block", "conv_id", "seq", "words").mapInArrow(run, _PART)


_WHOLE = "block int, start int, depth int, parent_start int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, whole boolean"


def _combined(parts: DataFrame) -> DataFrame:
    """Nodes that cross blocks (whole), each followed by one row for every part, by which children find it.

    Parts of a depth come in order of blocks; a part that opens its node begins a
    new one. At most two parts of a block have the same depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            first = least = sha = None
            sums, places, told = [0, 0, 0, 0], [], False

            def leave() -> Iterator[tuple]:
                if first is not None:
                    block, start, depth, parent_start, before = first
                    members, children, leaves, shared = sums
                    yield (block, start, depth, parent_start, least, members, children, leaves, shared - (members - 1) * before, sha.hexdigest(), True)
                    yield from ((b, s, depth, None, least, None, None, None, None, None, False) for b, s in places)

            for batch in batches:
                for depth, block, start, parent_start, opened, conv_id, *add, before, ends in zip(*(batch.column(k).to_pylist() for k in range(12))):
                    if opened:
                        yield from leave()
                        first, least, sha = (block, start, depth, parent_start, before), None, hashlib.sha256()
                        sums, places, told = [0, 0, 0, 0], [], False
                    sums = [a + b for a, b in zip(sums, add)]
                    places.append((block, start))
                    if conv_id is not None and (least is None or conv_id < least):
                        least = conv_id
                    if ends:
                        sha.update(f",{ends}".encode() if told else ends.encode())
                        told = True
            yield from leave()

        yield from _batches(nodes(), _WHOLE)

    ordered = parts.repartition("depth").sortWithinPartitions("depth", "block", "opened")
    return ordered.select("depth", "block", "start", "parent_start", "opened", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "before", "ends").mapInArrow(run, _WHOLE)


def nodes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with the columns of OUT."""
    return trie(rebuilt(turns_of(conversations)))


def trie(convs: DataFrame) -> DataFrame:
    """Every node of the trie of (conv_id, turns), a conversation a row."""
    spark = convs.sparkSession
    rows = convs.select("conv_id", F.unhex(_key(F.col("turns"))).alias("seq"), F.transform("turns", lambda t: t["w"]).alias("words"))
    rows = materialise(rows, "sequences")
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    blocks = max(session_parts(spark), -(-turns // BLOCK_TURNS))
    dealt = materialise(rows.repartitionByRange(blocks, "seq", "conv_id").withColumn("block", F.spark_partition_id()), "ranges")
    release(rows)
    edges = _edges(dealt)
    walked = materialise(_walked(dealt, edges, max([blocks, *(b + 1 for b, _ in edges)])), "walked")
    release(dealt)
    whole = materialise(_combined(walked.where("NOT done")), "crossing")
    key = lambda start, depth: F.struct(F.col("block"), start.alias("start"), depth.alias("depth"))
    up = key(F.col("parent_start"), F.col("depth") - 1).alias("up")
    sums = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    known = walked.where("done AND (parent_conv_id IS NOT NULL OR depth = 0)").select("parent_conv_id", *sums)
    seeking = walked.where("done AND parent_conv_id IS NULL AND depth > 0").select(up, *sums)
    crossing = whole.where("whole").select(F.when(F.col("depth") > 0, up).alias("up"), *sums)
    parents = whole.where("NOT whole").select(key(F.col("start"), F.col("depth")).alias("at"), F.col("conv_id").alias("parent_conv_id"))
    copies = parents.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = seeking.unionByName(crossing).withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    found = found.join(copies, (found["up"] == copies["at"]) & (found["salt"] == copies["other"]), "left")
    longs = [F.col(c).cast("long") for c in _LONGS]
    return known.select(*longs, "ends_sha256").unionByName(found.select(*longs, "ends_sha256"))


#: DuckDB SQL: nodes as lists of digests, every prefix joined with those below it.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, left(sha256(concat(length(coalesce(role, '')), chr(10), coalesce(role, ''), chr(10), coalesce(text, ''))), 32) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(w ORDER BY turn NULLS FIRST, d) AS ws FROM rows GROUP BY conv_id),
crc AS (
  WITH RECURSIVE steps AS (
    SELECT conv_id, 4294967295::BIGINT AS c, 0 AS k, conv_id::VARCHAR AS s FROM turns
    UNION ALL
    SELECT conv_id, CASE WHEN k % 9 = 0 THEN xor(c, ascii(substr(s, (k // 9 + 1)::INT, 1))) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1, s
    FROM steps WHERE k < 9 * length(s))
  SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM steps WHERE k = 9 * length(s)),
convs AS (
  SELECT t.conv_id, coalesce(s.ds, [])[1:h] || t.ds[h + 1:] AS ds, coalesce(s.ws, [])[1:h] || t.ws[h + 1:] AS ws
  FROM turns t JOIN crc USING (conv_id) LEFT JOIN turns s ON s.conv_id = t.conv_id - t.conv_id % 20),
prefixes AS (SELECT conv_id, d, array_to_string(ds[1:d], '') AS p, array_to_string(ds[1:d - 1], '') AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(ds) = d AS ends, ds
  FROM convs, LATERAL (SELECT unnest(range(len(ds) + 1)) AS d)),
nodes AS (
  SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(w) AS saved, any_value(ds[1:d]) AS ds,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT up AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT array_to_string(n.ds[1:a], '') AS p, a AS d, sum(n.saved) AS saved, count(*) FILTER (c.k IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c USING (p, d), LATERAL (SELECT unnest(range(n.d + 1)) AS a) GROUP BY ALL)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(c.k, 0)::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN children c USING (p, d) JOIN below b USING (p, d) LEFT JOIN nodes up ON up.p = n.up AND up.d = n.d - 1
"""
