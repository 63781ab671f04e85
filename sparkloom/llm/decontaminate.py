"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k = floor(rate * length) edits.
Cut into k + 1 pieces, at least one piece occurs unchanged, so exact piece hits
find every occurrence; the text around a hit is verified with Myers' bit-parallel
distance. Piece hits are found for a whole batch at once: a hash of the first 16
(or 8) bytes at every position is looked up in a bitmap, then in a dictionary.

Texts and items are compared in lower case with each run of white space as one
space. Items are a query set: they go to the executors in blocks of a bounded
size (ITEM_BYTES of item text), each block against all documents. One block is
out at a time: its finds, or the rows that pass it, are written to the shared folder
before the next one goes.

Defined results: null and empty texts and items match nothing; very long texts are
searched whole; items of equal text are each reported; a repeated row is reported
each time; of several occurrences of an item in a document the closest, then first
(ties), is reported; an empty table of documents or items finds nothing. Of docs
only doc_id and text are read, and clean() returns all columns whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release, texts

RATE = 0.08
#: Item text that one scan of the documents takes along.
ITEM_BYTES = 8 << 20
#: Text that is searched at once.
SEARCH_BYTES = 4 << 20
_BITS = 22
_GAP = b"\x00" * 16
_SCHEMA = "doc_id long, item_id long, distance int, start long, stop long, text_start long, text_stop long"
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str) -> str:
    """Lower case, white space as single spaces, no NUL (it separates texts in a search)."""
    return " ".join(text.replace("\x00", " ").lower().split())


def original_places(text: str, wanted: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """The spans of text that characters of normal(text) stand for: those at the wanted places, which ascend, or all of them.

    Words keep their order and a gap is one character, so a walk over words finds
    places; inside a word characters are counted only if lower case changes its length.
    Nothing is held but the spans asked for.
    """
    out: list[tuple[int, int]] = []
    asked = iter(range(len(normal(text))) if wanted is None else wanted)
    at, place, end = next(asked, None), 0, 0  # place: of the next word's first character, or of the gap before it
    for word in re.finditer(r"\S+", text.replace("\x00", " ")):
        if at is None:
            break
        if place:  # a gap
            if at == place:
                out.append((end, word.start()))
                at = next(asked, None)
            place += 1
        end, size = word.end(), len(word[0].lower())
        if at is not None and at < place + size:
            if size == end - word.start():
                while at is not None and at < place + size:
                    out.append((word.start() + at - place, word.start() + at - place + 1))
                    at = next(asked, None)
            else:
                upto = place
                for i, c in enumerate(word[0], word.start()):
                    upto += len(c.lower())
                    while at is not None and at < upto:
                        out.append((i, i + 1))
                        at = next(asked, None)
        place += size
    return out


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the closest substring of text within limit, the first such end; None if there is none."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = score, j + 1
    return best


def occurrence(item: str, text: str, limit: int) -> tuple[int, int, int] | None:
    """(distance, start, stop) of the closest occurrence in text."""
    found = myers(item, text, limit)
    if found is None:
        return None
    back = myers(item[::-1], text[: found[1]][::-1], found[0])
    return found[0], found[1] - back[1], found[1]


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 consecutive pieces with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


class PieceIndex:
    """Exact pieces of items, found in many texts at once."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        self.by_width: dict[int, tuple[np.ndarray, dict[int, list[tuple[bytes, int, int]]]]] = {}
        #: Pieces under 8 bytes, which no hash covers; only items of a few letters have such.
        self.short: list[tuple[bytes, int, int]] = []
        for item_id, raw in items:
            item = normal(raw or "")
            if not item:
                continue
            budget = int(rate * len(item))
            n = len(self.items)
            self.items.append((item_id, item, budget))
            for offset, piece in pieces(item, budget):
                data = piece.encode("utf-8", "surrogatepass")
                width = 16 if len(data) >= 16 else 8
                if len(data) < 8:
                    self.short.append((data, n, offset))
                    continue
                if width not in self.by_width:
                    self.by_width[width] = (np.zeros(1 << _BITS, np.bool_), {})
                bitmap, known = self.by_width[width]
                h = self._hashes(np.frombuffer(data[:width], np.uint8), width)
                bitmap[int(h[0]) >> 64 - _BITS] = True
                known.setdefault(int(h[0]), []).append((data, n, offset))

    @staticmethod
    def _hashes(data: np.ndarray, width: int) -> np.ndarray:
        """A hash of the next `width` bytes at each position that has as many."""
        n = len(data) - 7
        if n < 1:
            return np.zeros(0, np.uint64)
        word = np.empty(n, np.uint64)
        for k in range(8):
            own = data[k : k + (len(data) - k) // 8 * 8].view(np.uint64)
            word[k::8] = own[: len(word[k::8])]
        if width == 8:
            h = word * _ODD
        else:
            h = word[:-8] * _ODD
            h ^= h >> np.uint64(29)
            h += word[8:]
            h *= _ODD2
        h ^= h >> np.uint64(32)
        h *= _ODD
        return h

    def hits(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(byte position, item, offset of the piece) of each piece hit."""
        view = np.frombuffer(data, np.uint8)
        for width, (bitmap, known) in self.by_width.items():
            h = self._hashes(view, width)
            at = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            for p, key in zip(at.tolist(), h[at].tolist()):
                for piece, item, offset in known.get(key, ()):
                    if data.startswith(piece, p):
                        yield p, item, offset
        for piece, item, offset in self.short:
            p = data.find(piece)
            while p >= 0:
                yield p, item, offset
                p = data.find(piece, p + 1)

    def search(self, documents: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, stop) for each document and item that occurs in it."""
        coded = [d.encode("utf-8", "surrogatepass") for d in documents]
        begins = np.cumsum([0, *(len(c) + len(_GAP) for c in coded)])
        spots: dict[tuple[int, int], set[int]] = {}
        for p, item, offset in self.hits(_GAP.join(coded)):
            d = int(np.searchsorted(begins, p, "right")) - 1
            spots.setdefault((d, item), set()).add((int(p - begins[d]), offset))
        out, place, last = [], None, -1
        for (d, n), where in sorted(spots.items()):
            if d != last:
                place, last = None, d
                if len(coded[d]) != len(documents[d]):  # code points before each byte
                    place = np.cumsum(np.frombuffer(coded[d], np.uint8) & 0xC0 != 0x80) - 1
            _, item, budget = self.items[n]
            best = None
            done = -1
            for start in sorted({(int(place[p]) if place is not None else p) - o for p, o in where}):
                low, high = max(0, start - budget), start + len(item) + budget
                if start - budget <= done and best and best[0] == 0:
                    continue
                if best is None or best[0]:
                    found = occurrence(item, documents[d][low:high], budget)
                    if found and (best is None or found[0] < best[0]):
                        best = found[0], found[1] + low, found[2] + low
                done = high
            if best:
                out.append((d, n, *best))
        return out


def blocks(items: DataFrame, size: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in order of id, in lists of at most `size` bytes of text (one item at least)."""
    out, held = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").where(F.length("text") > 0).orderBy("item_id", "text").toLocalIterator():
        if out and held + len(row.text) > size:
            yield out
            out, held = [], 0
        out.append((row.item_id, row.text))
        held += len(row.text)
    if out:
        yield out


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, stop, text_start, text_stop) of items that occur in documents.

    start and stop are places in the normal form of the text, text_start and text_stop in the text itself.
    """
    spark = docs.sparkSession
    found = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)
        part = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_searcher(shared, rate), _SCHEMA), "contaminated")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], _SCHEMA)


def _searcher(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PieceIndex(shared.value, rate)
        names = ["doc_id", "item_id", "distance", "start", "stop", "text_start", "text_stop"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def searched(ids: list, raw: list[str], held: list[str]) -> pa.RecordBatch:
            rows = []
            for d, found in groupby(index.search(held), itemgetter(0)):
                found = list(found)
                ends = sorted({p for _, _, _, s, e in found for p in (s, e - 1)})
                places = dict(zip(ends, original_places(raw[d], ends)))
                rows += [(ids[d], index.items[n][0], k, s, e, places[s][0], places[e - 1][1]) for _, n, k, s, e in found]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            ids, raw, held, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                ids.append(doc_id)
                raw.append(text)
                held.append(normal(text))
                size += len(held[-1])
                if size > SEARCH_BYTES:
                    yield searched(ids, raw, held)
                    ids, raw, held, size = [], [], [], 0
            if ids:
                yield searched(ids, raw, held)

    return run


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item occurs, each decided by its own text."""
    spark = docs.sparkSession
    shared = before = None
    for block in blocks(items):
        if shared is not None:  # what passed the block before is written, so that one block at a time is out
            docs = materialise(docs, "clean")
            shared.destroy()
            release(before)
            before = docs
        shared = spark.sparkContext.broadcast(block)
        docs = docs.where(_free(shared, rate)(docs["text"]))
    return docs


def _free(shared, rate: float):
    """A function that says of a text that no item of a block occurs in it."""

    @F.arrow_udf("boolean")
    def free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = PieceIndex(shared.value, rate)
        for batch in batches:
            keep, held, size, first = [True] * len(batch), [], 0, 0
            for n, value in enumerate(batch):
                held.append(normal(value.as_py() or ""))
                size += len(held[-1])
                if size > SEARCH_BYTES or n + 1 == len(batch):
                    for d, *_ in index.search(held):
                        keep[first + d] = False
                    held, size, first = [], 0, n + 1
            yield pa.array(keep, pa.bool_())

    return free
