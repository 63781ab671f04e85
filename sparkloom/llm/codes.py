"""Vector codes by product quantisation, fitted with delta-maintained Lloyd rounds.

Components become integers, vectors are cut into PARTS equal consecutive parts, and
each part position has a codebook of at most ENTRIES entries. A round assigns every part to
its nearest entry and then moves each entry to the floor of its parts' mean. What a
round keeps is a table of the integer vectors with their present assignment, and
the running sums: per part position and entry the integer sums and the count. A task
of the next round compares the new assignment with the kept one and adds up,
for what it has read, plus the part at its new entry and minus it at its old one, only
where the two differ. These few rows are written beside the new assignments, so a
vector is read once a round; only they are shuffled, and added to the running sums.
Integers make the sums exact, whatever the order of tasks or how often one is run
again; sums and means equal those of a full recount.

The driver holds the running sums and codebooks (PARTS * ENTRIES rows), never vectors
but the first ENTRIES of them.

Defined results: rows whose vector is null or has null or non-finite components are
left out. A vector shorter than the longest kept, or a length no multiple of PARTS, is
filled up with zeros at its end. Components beyond 2^23 / SCALE, where squares would leave
a long, count as that. Rows that repeat an id are rows of their own, in the first codebook
in order of their vectors; a null id comes last. Ties between entries go to the lower
index. Fewer vectors than ENTRIES make as many entries. No vectors give no rows. A null
label is a label of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialise, release

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
LIMIT = 1 << 23
#: Label totals are joined by merge over so many salts where they are too many to be broadcast.
SALTS = 16
#: Vectors compared with a codebook at a time.
_CHUNK = 4096


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): kept rows, components as integers, filled up to one length divisible by PARTS."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return kept.select("vec_id", "label", whole.alias("x"))


def _squared(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries); in doubles, which have a fast product, where they hold every sum exactly."""
    most = 2 * max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if rows.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    rows, book = rows.astype(kind), book.astype(kind)
    return (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(axis=1)[None, :]


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances (rows, parts) of vectors x; books is (parts, entries, width)."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(x), parts), np.int16), np.empty((len(x), parts), np.int64)
    for at in range(0, len(x), _CHUNK):
        piece = x[at : at + _CHUNK]
        for p in range(parts):
            d = _squared(piece[:, p * width : (p + 1) * width], books[p])
            best = d.argmin(axis=1)  # the first of equals
            codes[at : at + _CHUNK, p] = best
            errors[at : at + _CHUNK, p] = d[np.arange(len(piece)), best]
    return codes, errors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of integer lists as (rows, width), short ones filled up with zeros."""
    offsets = np.asarray(column.offsets)
    flat, sizes = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Changes:
    """Plus and minus contributions of parts that changed their entry, added up per part position and entry."""

    def __init__(self, parts: int, entries: int, width: int):
        self.sums = np.zeros((parts, entries, width + 1), np.int64)  # the last column counts

    def add(self, x: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        width = self.sums.shape[2] - 1
        for p in range(self.sums.shape[0]):
            moved = np.flatnonzero(old[:, p] != new[:, p])
            part = np.concatenate([x[moved, p * width : (p + 1) * width], np.ones((len(moved), 1), np.int64)], axis=1)
            np.add.at(self.sums[p], new[moved, p], part)
            had = old[moved, p] >= 0
            np.subtract.at(self.sums[p], old[moved, p][had], part[had])

    def rows(self) -> list[tuple[int, int, list[int]]]:
        """(part, entry, sums and count) where anything changed."""
        return [(int(p), int(e), self.sums[p, e].tolist()) for p, e in zip(*np.nonzero(self.sums.any(axis=2)))]


_STATE = "vec_id {0}, label {1}, x array<int>, codes array<smallint>, part int, entry int, change array<bigint>"


def _assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """state with the assignment to books in `codes`, and after a task's vectors its rows of changes (part, entry, change)."""
    parts, entries, width = books.shape
    types = dict(state.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes, schema = Changes(parts, entries, width), None
        for batch in batches:
            x = _matrix(batch.column(2), parts * width)
            before = batch.column(3)
            old = np.full((len(x), parts), -1, np.int16) if before.null_count else before.values.to_numpy()[before.offset * parts :][: len(x) * parts].reshape(-1, parts)
            new, _ = nearest(x, books)
            changes.add(x, old, new)
            codes = pa.array(list(new), pa.list_(pa.int16()))
            empty = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], codes, *empty], ["vec_id", "label", "x", "codes", "part", "entry", "change"])
            schema = out.schema
            yield out
        if schema is not None and (rows := changes.rows()):
            part, entry, change = zip(*rows)
            empty = [pa.nulls(len(rows), schema.field(n).type) for n in range(4)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(change, pa.list_(pa.int64()))], schema=schema)

    return state.select("vec_id", "label", "x", "codes").mapInArrow(run, _STATE.format(types["vec_id"], types["label"]))


def _vectors(state: DataFrame) -> DataFrame:
    """The rows of a kept table that are vectors."""
    return state.where("part IS NULL").select("vec_id", "label", "x", "codes")


def _summed(state: DataFrame, width: int) -> DataFrame:
    """(part, entry, change): the changes of all tasks, added up."""
    sums = [F.sum(F.col("change")[k]).alias(f"c{k}") for k in range(width + 1)]
    return state.where("part IS NOT NULL").groupBy("part", "entry").agg(*sums).select("part", "entry", F.array(*(f"c{k}" for k in range(width + 1))).alias("change"))


def fit(rows: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """Kept table, codebooks (parts, entries, width) and running sums after `rounds` rounds over integers(); None without rows.

    Without rounds the table is rows itself; else one of materialise(), with rows of changes among those of vectors.
    """
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["x"])] = r["x"]
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    running = np.zeros((parts, len(first), width + 1), np.int64)
    state = rows.select("vec_id", "label", "x", F.lit(None).cast("array<smallint>").alias("codes"))
    before = None
    for _ in range(rounds):
        after = materialise(_assigned(state, books), "lloyd")
        for r in _summed(after, width).collect():  # at most parts * entries rows
            running[r["part"], r["entry"]] += r["change"]
        release(before)
        before, state = after, _vectors(after)
        used = running[:, :, -1] > 0
        books[used] = running[used][:, :-1] // running[used][:, -1:]  # floor division goes down
    return before if before is not None else rows, books, running


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of integers(): two hex digits for each part, and the squared distance summed over parts."""
    types = dict(rows.dtypes)
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest(_matrix(batch.column(2), parts * width), books)
            code = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], code, pa.array(errors.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with `label_error`, the errors of its label added up; a hot label's rows are dealt over SALTS tasks."""
    salt, name, key, other = fresh(coded.columns, "salt", "of_label", "label_error", "other_salt")
    totals = materialise(coded.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias(key)), "labels")
    copies = totals.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(copies, dealt["label"].eqNullSafe(copies[name]) & (dealt[salt] == copies[other]))
    return joined.select(*coded.columns, F.col(key).alias("label_error"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept row."""
    rows = integers(vectors, id_col, vector_col, label_col)
    found = fit(rows)
    if found is None:
        kept = rows.select("vec_id", "label")
        return kept.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    state, books, _ = found
    coded = materialise(encode(_vectors(state), books), "codes")
    release(state)
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def _oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL: plain Lloyd rounds, every sum counted anew; distances in doubles, which hold them exactly."""
    steps = [
        "kept AS (SELECT vec_id, label, [floor(c::DOUBLE * 1024) for c in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0)",
        "parts AS MATERIALIZED (SELECT k.vec_id, p::INT AS p, k.x[p * (len(k.x) // 4) + 1 : (p + 1) * (len(k.x) // 4)] AS x FROM kept k, range(4) r(p))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256)",
        "c0 AS MATERIALIZED (SELECT p.p, f.e, p.x AS c FROM parts p JOIN firsts f USING (vec_id))",
    ]
    square = "list_dot_product({0}, {0})"
    for r in range(rounds + 1):
        distance = f"{square.format('p.x')} - 2 * list_dot_product(p.x, c.c) + {square.format('c.c')}"
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, p, best.d AS d, best.e AS e FROM (SELECT p.vec_id, p.p, min(struct_pack(d := {distance}, e := c.e)) AS best FROM parts p JOIN c{r} c ON p.p = c.p GROUP BY ALL))"
        )
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT p, e, list(m ORDER BY k) AS m FROM (SELECT a.p, a.e, u.k, floor(sum(u.v) / count(*)) AS m FROM a{r} a JOIN (SELECT vec_id, p, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM parts) u USING (vec_id, p) GROUP BY ALL) GROUP BY ALL)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(s.m, c.c) AS c FROM c{r} c LEFT JOIN s{r} s ON c.p = s.p AND c.e = s.e)")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"book AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, k)) AS digest FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS k FROM c{rounds}))")
    return f"WITH {', '.join(steps)} SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, b.digest AS codebooks_sha256 FROM coded c JOIN kept k USING (vec_id), book b"


ORACLE_SQL = _oracle()
