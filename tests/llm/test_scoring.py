"""Quality and toxicity: held-out accuracy on the driver's tables, exact sums on small chains."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from sparkloom.llm import quality, toxicity
from sparkloom.llm.queries import QUERIES
from sparkloom.llm.shared import held_out, labelled_sample

BIG = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (1, ""), (2, None), (3, "x" * 300_000), (4, "a\n" * 5000), (5, "é\U0001f600 \x00")]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    unary, tie = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    marginal, pairs, z = quality.forward_backward(unary, tie, sizes)
    want, want_pairs, want_z, at = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        weights = {s: np.exp(sum(unary[at + i, k] for i, k in enumerate(s)) + sum(tie[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=int(n))}
        total = sum(weights.values())
        want_z += np.log(total)
        for s, w in weights.items():
            for i, k in enumerate(s):
                want[at + i, k] += w / total
            for a, b in zip(s, s[1:]):
                want_pairs[a, b] += w / total
        at += n
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(z, want_z)


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.array([3, 5, 9]), rng.normal(size=3), rng.normal(size=(3, 4)), 0.3)
    want = 0.3 + m.w[0] + m.w[2] + m.v[0] @ m.v[2]
    assert np.isclose(m.logit({3, 9, 77}), want) and m.logit(set()) == 0.3


def bits_of(rows, places):
    return np.array([np.packbits(np.isin(np.arange(places), r)) for r in rows])


def test_machine_learns_a_pair_whose_terms_mean_nothing_alone():
    """Each term is as common in either class; only which two meet matters."""
    pairs = [((0, 1), 1), ((2, 3), 1), ((0, 3), 0), ((2, 1), 0)]
    noise = np.random.default_rng(0)
    rows = [([*p, *(4 + noise.choice(12, 3, replace=False))], y) for p, y in pairs * 60]
    bits, labels = bits_of([r for r, _ in rows], 16), np.array([y for _, y in rows])
    counts = [np.unpackbits(bits[labels == k], axis=1)[:, :4].sum(axis=0).tolist() for k in (0, 1)]
    assert counts[0] == counts[1]
    m = toxicity.machine_of(np.arange(16), bits, labels, 0.5)
    logits = {p: m.slope * m.logit(set(p)) + m.shift for p, _ in pairs}
    assert all((logits[p] > 0) == (y == 1) for p, y in pairs)
    additive = toxicity.machine_of(np.arange(16), bits, labels, 0.5, factors=0)
    wrong = [(additive.slope * additive.logit(set(p)) + additive.shift > 0) != (y == 1) for p, y in pairs]
    assert any(wrong)


def area(scores, truth):
    """Probability that a positive scores above a negative."""
    one, zero = scores[truth == 1], scores[truth == 0]
    return float(((one[:, None] > zero).sum() + 0.5 * (one[:, None] == zero).sum()) / (len(one) * len(zero)))


def test_pairs_rank_better_than_a_linear_model_trained_alone(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled_sample(docs, labels, "toxic", 3000).select("label", "text").mapInArrow(toxicity._terms, "label int, terms array<int>")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").count().withColumnRenamed("count", "n").collect()}
    places = toxicity.choose(sample, sizes)
    bits, known = toxicity.packed(sample, places)
    held = [(toxicity.terms(r.text), r.toxic) for r in docs.join(labels, "doc_id").where(held_out()).collect()]
    truth = np.array([y for _, y in held])
    both = {k: area(np.array([m.logit(t) for t, _ in held]), truth) for k in (0, 4) for m in [toxicity.machine_of(places, bits, known, 0.1, k)]}
    assert both[4] > both[0] and both[4] > 0.98


def test_sample_is_bounded_in_rows_not_in_ids(spark):
    docs = spark.createDataFrame([(1, f"text {n}") for n in range(500)] + [(4, "same")] * 500 + [(2, None), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 10).collect()
    by = {k: [r for r in rows if r.label == k] for k in (0, 1)}
    assert all(0 < len(v) <= 10 for v in by.values()) and sum(r.text == "same" for r in rows) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, labelled_sample(docs.orderBy("text"), labels, "quality", 10).collect()))


def test_blocks_of_lines_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    weights, tie = rng.normal(size=(3 * quality.N, 2)), np.array([[0.4, -0.3], [-0.2, 0.3]])
    field, texts = quality.Field(weights, tie, 3.0, -1.0), ["", "one line", "a\nB!! ##\n\nlast words words words", "x y\n" * 50, "\n"]
    found = []
    for size in (1, 3, 8192):
        monkeypatch.setattr(quality, "BLOCK_LINES", size)
        found.append(list(field.scores(iter(texts))))
    assert np.allclose(found[0], found[2]) and np.allclose(found[1], found[2])
    own, lengths = quality.features_of(quality.lines_of(texts[2]))
    whole = quality.raw_quality(quality.with_neighbours(own, np.array([4])) @ weights, tie, lengths, np.array([4]))
    assert np.isclose(1 / (1 + np.exp(-(3.0 * whole[0] - 1))), found[0][2])


def test_training_counts_every_line_and_its_own_ties(spark, monkeypatch):
    """Bad lines behind the first hundreds decide; the prior keeps transition weights off any bound."""
    good, bad = "a plain line of words that goes on.", "$$$ ### !!! $$$ ### %%%"
    rows = [(i, "\n".join([good] * 200 + [bad if i % 2 else good] * 400)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "CHAIN", 256)
    field = quality.fit(docs, labels)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in quality.score(docs, field).collect())
    assert 0 < np.abs(field.tie).max() < 3


@pytest.mark.parametrize(("name", "label"), [("op1_line_crf_quality", "quality"), ("op10_factorization_machine_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    got = {r.doc_id: r for r in QUERIES[name](spark, BIG).collect()}
    labels = [r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect() if r.doc_id in got]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [r for r in labels if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(got[r.doc_id].predicted == r[label] for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_empty_tables_and_extra_columns(spark, module):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.fit(docs, none)
    assert model == 0.5
    assert module.score(docs, model).count() == len(ODD) and module.score(docs.limit(0), model).count() == 0
    some = spark.createDataFrame([(i, f"good words number {i} here.\nand more of them" if i % 2 else "$$$ !!! ### idiot $$$ !!! idiot idiot") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    fitted = module.fit(some, labels)
    rows = module.score(docs, fitted).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert {r.score for r in module.score(some, fitted).collect()} == {r.score for r in module.score(some, module.fit(some, labels)).collect()}
