"""Vector codes against plain Lloyd rounds in Python's integers, the SQL oracle, and odd rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from compare import same
from pyspark.sql import functions as F

from sparkloom.llm import codes
from sparkloom.llm.queries import ORACLES, QUERIES
from sparkloom.llm.shared import materialise


def plain(rows, rounds=4):
    """(id, code, error, label_error, digest) of (id, vector, label), every mean from all parts."""
    kept = [(i, [math.floor(1024 * c) for c in v], k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max(len(x) for _, x, _ in kept) // 4)
    cut = [[(x + [0] * 4 * width)[p * width : (p + 1) * width] for p in range(4)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:256]
    books = [[cut[n][p] for n in order] for p in range(4)]

    def assign(p):
        away = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
        return [min((away(x[p], entry), e) for e, entry in enumerate(books[p])) for x in cut]

    for _ in range(rounds):
        for p in range(4):
            mine = {}
            for n, (_, e) in enumerate(assign(p)):
                mine.setdefault(e, []).append(cut[n][p])
            for e, parts in mine.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    found = [assign(p) for p in range(4)]
    errors = [sum(found[p][n][0] for p in range(4)) for n in range(len(kept))]
    total = {}
    for (_, _, k), e in zip(kept, errors):
        total[k] = total.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{found[p][n][1]:02x}" for p in range(4)), errors[n], total[k], digest) for n, (i, _, k) in enumerate(kept)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def coded(df, **names):
    return by_id([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, **names).collect()])


def test_query_equals_the_oracle(spark, sf_dir, duck):
    same(QUERIES["op11_delta_lloyd_codes"](spark, sf_dir).toPandas(), duck.execute(ORACLES["op11_delta_lloyd_codes"]).df())


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.05, 8).astype("f4")], int(i) % 3) for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert coded(df) == by_id(plain(rows))


def test_odd_vectors(spark):
    """Null, non-finite, empty, short, odd-length and repeated vectors, null ids and labels, ties, clashing names."""
    rows = [
        (1, [0.5, -0.5, 0.25, 0.1, 0.2], 1), (2, None, 1), (3, [0.5, None, 0.1], 1), (4, [float("nan")] * 4, 1), (5, [float("inf"), 0.0], 2), (6, [], None), (7, [-0.0004], None),
        (None, [0.5, -0.5], 2), (1, [0.5, -0.5, 0.25, 0.1, 0.2], 1), (1, [0.1, 0.1], None), (8, [0.5, -0.5, 0.25, 0.1, 0.2, 0.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit("v") for n in ("x", "codes", "part", "entry", "change", "code", "error", "salt")})
    assert coded(df) == by_id(plain(rows))
    assert coded(df.limit(0)) == [] and codes.compress(df.limit(0)).columns == codes.compress(df).columns
    huge = spark.createDataFrame([(1, [3e38, 1.0, 0.0, 0.0], 0), (2, [-3e38, 1.0, 0.0, 0.0], 0), (3, [8192.0, 1.0, 0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert {r[0]: r[1] for r in coded(huge)} == {1: "00000000", 2: "01000000", 3: "00000000"}


def test_large_integers_keep_exact_distances():
    book = np.array([[codes.LIMIT, 0], [codes.LIMIT - 1, 0]])
    rows = np.array([[-codes.LIMIT, 1], [codes.LIMIT, 3]] * 40)
    wide_rows, wide_book = np.tile(rows, 20), np.tile(book, 20)
    assert codes._squared(wide_rows, wide_book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in wide_book] for r in wide_rows]


def test_only_changed_parts_are_added(spark):
    """From the second round on, the rows of changes hold the moved parts alone, and running sums equal a recount."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 0.05, 8)], 0) for i in range(600)]
    given = codes.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    _, books, _ = codes.fit(given, rounds=1, entries=16)
    state, _, running = codes.fit(given, rounds=2, entries=16)
    again = codes._assigned(codes._vectors(state), books)
    assert again.where("part IS NOT NULL").count() == 0
    kept = codes._vectors(state).collect()
    recount = np.zeros_like(running)
    for r in kept:
        for p, e in enumerate(r["codes"]):
            recount[p, e] += [*r["x"][p * 2 : p * 2 + 2], 1]
    assert (recount == running).all()


def test_a_hot_label(spark):
    coded_rows = materialise(spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(1)).cast("int").alias("label"), F.lit("00").alias("code"), F.lit(2).cast("long").alias("error")), "hot")
    got = {(r.label, r.label_error) for r in codes.with_label_error(coded_rows).collect()}
    assert got == {(None, 2000), (1, 4000)}
