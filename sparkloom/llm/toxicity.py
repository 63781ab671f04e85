"""Toxicity from a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum over pairs of v_i . v_j y_i y_j) over the
terms present in a text: its words, the first four and five letters of each
(insults take endings in many languages), and marks of prefixes that two, or
three, different words of the text share. The pair term lets two terms count
together that mean nothing apart, such as an insult and a mention of a group.

Terms are hashed to BUCKETS places. Fitting takes a bounded sample of rows
(PER_CLASS documents of either label). Document frequencies of places are counted
on the executors, per class; the machine holds those in MIN_DOCS documents and
MIN_SHARE of either class at least, PLACES of them at most, the most frequent
in their class first. Frequency alone chooses, so a term as common in clean as in
toxic texts takes part, and the machine may find that it matters in a pair. What
a place weighs grows smoothly with the difference between the classes: x_i for
itself, y_i, never below FLOOR, in pairs. A logistic map fitted on logits of folds that
the machine wasn't trained on gives the score.

What reaches the driver is a bit for each place and document of the sample: 2 *
PER_CLASS * PLACES bits, whatever the length of texts.

Defined results: a null or empty text has no terms and gets the score of none; of
very long texts every word counts; equal texts get equal scores, so ties and
repeated rows are scored one by one alike; if the labels lack a class, every
score is the smoothed share of label 1; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, materialise, release, texts

PER_CLASS = 3000
BUCKETS = 1 << 22
#: Places of the machine, and what a place needs to be one of them.
PLACES = 4096
MIN_DOCS = 3
MIN_SHARE = 0.01
#: Standard deviations of class difference at which a place has its full weight; least weight in pairs.
FULL = 5.0
FLOOR = 0.1
FACTORS = 4
#: Steps of training, documents of a step, folds of calibration.
STEPS = 200
BATCH = 512
FOLDS = 4
RIDGE_W, RIDGE_V = 1e-3, 2e-3
THRESHOLD = 0.3
_TRIM = ".,;:!?\"'()[]{}*#&%$|"


@lru_cache(maxsize=1 << 18)
def word_terms(word: str) -> tuple[int, ...]:
    """Places of a lower-case word and of its first four and five letters; each kind hashes with a seed of its own."""
    if not word:
        return ()
    found = [crc32(word.encode("utf-8", "surrogatepass"), 1) % BUCKETS]
    found += [crc32(word[:k].encode("utf-8", "surrogatepass"), k) % BUCKETS for k in (4, 5) if len(word) > k]
    return tuple(found)


def shared_places(prefix: int) -> tuple[int, int]:
    """Places that say that two, three words of a text share the prefix of a place."""
    return (prefix * 31 + 7) % BUCKETS, (prefix * 31 + 11) % BUCKETS


def terms(text: str) -> set[int]:
    """Hashed terms that occur in a text."""
    found = [word_terms(w) for w in {w.strip(_TRIM) for w in text.lower().split()}]
    out = set(chain.from_iterable(found))
    for prefix, n in Counter(chain.from_iterable(f[1:] for f in found)).items():
        if n > 1:
            out.update(shared_places(prefix)[: n - 1])
    return out


@dataclass
class Machine:
    """Places in order, weights and factors with their scales folded in, the bias, and the logistic map to the score."""

    places: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.slot = {int(p): i for i, p in enumerate(self.places)}
        self.known = set(self.slot)

    def logit(self, found: set[int]) -> float:
        at = sorted(self.slot[t] for t in found & self.known)  # in order: the same sum for equal texts
        if not at:
            return self.bias
        v = self.v[at]
        sums = v.sum(axis=0)
        return float(self.bias + self.w[at].sum() + 0.5 * ((sums * sums).sum() - (v * v).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(terms(text)) + self.shift, -30, 30))))


def scales(one: np.ndarray, zero: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """How much places weigh alone and in pairs, from their document frequencies in both classes."""
    p = (one + zero + 1) / (n1 + n0 + 2)
    z = (one / max(1, n1) - zero / max(1, n0)) / np.sqrt(p * (1 - p) * (1 / max(1, n1) + 1 / max(1, n0)))
    alone = np.minimum(1.0, (z / FULL) ** 2)
    return alone, np.maximum(alone, FLOOR)


def train(bits: np.ndarray, labels: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray, float]:
    """(w, v, bias) by Adam on the logistic loss, BATCH documents a step; bits are the documents' places, packed. No factors make it additive."""
    n, d = len(bits), bits.shape[1] * 8
    counts = [sum((np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64) for part in np.array_split(bits[labels == k], 1 + n // BATCH)), np.zeros(d, np.int64)) for k in (1, 0)]
    alone, paired = (s.astype(np.float32) for s in scales(*counts, int((labels == 1).sum()), int((labels == 0).sum())))
    rng = np.random.default_rng(7)
    w, v = np.zeros(d, np.float32), rng.normal(0, 0.05, (d, factors)).astype(np.float32)
    bias = np.array([np.log(((labels == 1).sum() + 1) / ((labels == 0).sum() + 1))], np.float32)
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (w, v, bias)]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, n):
            order += rng.permutation(n).tolist()
        part, order = order[:BATCH], order[BATCH:]
        x = np.unpackbits(bits[part], axis=1).astype(np.float32)
        y, xw, xv = labels[part].astype(np.float32), x * alone, x * paired
        sums, square = xv @ v, xv * xv
        logit = bias + xw @ w + 0.5 * ((sums * sums).sum(axis=1) - (square @ (v * v)).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(part)
        slopes = (xw.T @ g + RIDGE_W * w, xv.T @ (g[:, None] * sums) - (square.T @ g)[:, None] * v + RIDGE_V * v, g.sum(keepdims=True))
        for (value, m, s), slope in zip(state, slopes):
            m += 0.1 * (slope - m)
            s += 0.01 * (slope * slope - s)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w * alone, v * paired[:, None], float(bias[0])


def logits(bits: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The machine's logits of packed documents."""
    w, v, bias = model
    out = [np.zeros(0)]
    for at in range(0, len(bits), BATCH):
        x = np.unpackbits(bits[at : at + BATCH], axis=1).astype(np.float32)
        out.append(bias + x @ w + 0.5 * (((x @ v) ** 2).sum(axis=1) - x @ (v * v).sum(axis=1)))
    return np.concatenate(out)


def calibrate(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 80, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic map of logits by Newton's method, the classes weighing as among all labels."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (y - p), np.maximum(weight * p * (1 - p), 1e-9)
        left = np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + ridge]])
        move = np.linalg.solve(left, [(g * x).sum() - ridge * (a - 1), g.sum() - ridge * b])
        a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -2, 2)
    return float(a), float(b)


def machine_of(places: np.ndarray, bits: np.ndarray, labels: np.ndarray, share: float, factors: int = FACTORS) -> Machine:
    """The machine of all documents, calibrated on logits from folds it was not trained on; share is the rate of label 1 among all labels."""
    fold = np.empty(len(labels), np.int64)
    for k in (0, 1):  # each class is dealt evenly
        fold[labels == k] = np.arange((labels == k).sum()) % FOLDS
    left_out = np.zeros(len(labels))
    for k in range(FOLDS):
        if len(set(labels[fold != k].tolist())) == 2:
            left_out[fold == k] = logits(bits[fold == k], train(bits[fold != k], labels[fold != k], factors))
    w, v, bias = train(bits, labels, factors)
    machine = Machine(places, w[: len(places)], v[: len(places)], bias)
    machine.slope, machine.shift = calibrate(left_out, labels, share)
    return machine


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(terms(t)) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"])


def choose(sample: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """Places of the machine from (label, terms), at most PLACES, in order; sizes are the documents of either label."""
    n = [F.count_if(F.col("label") == k) for k in (0, 1)]
    counts = sample.select("label", F.explode("terms").alias("place")).groupBy("place").agg(n[0].alias("n0"), n[1].alias("n1"))
    share = F.greatest(F.col("n0") / max(1, sizes.get(0, 0)), F.col("n1") / max(1, sizes.get(1, 0)))
    often = counts.where(F.col("n0") + F.col("n1") >= MIN_DOCS).select("place", share.alias("share")).where(F.col("share") >= MIN_SHARE)
    return np.array(sorted(r["place"] for r in often.orderBy(F.desc("share"), "place").limit(PLACES).collect()), np.int64)


def packed(sample: DataFrame, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, labels) of (label, terms), the rows in an order of their own."""
    width = max(1, -(-len(places) // 8)) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(1):
                row = np.zeros(width, np.bool_)
                row[: len(places)] = np.isin(places, found.values.to_numpy(), assume_unique=True)
                rows.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "bits"])

    rows = sorted((r["label"], bytes(r["bits"])) for r in sample.mapInArrow(run, "label int, bits binary").collect())
    return np.array([np.frombuffer(b, np.uint8) for _, b in rows]), np.array([y for y, _ in rows])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | float:
    """The machine, from a sample of at most 2 * per_class documents; the share of label 1 if there is only one class."""
    counts = {r["k"]: r["n"] for r in labels.where(~held_out()).groupBy(F.col("toxic").cast("int").alias("k")).agg(F.count("*").alias("n")).where("k IN (0, 1)").collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    sample = materialise(labelled_sample(docs, labels, "toxic", per_class).select("label", "text").mapInArrow(_terms, "label int, terms array<int>"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        release(sample)
        return share
    places = choose(sample, sizes)
    bits, known = packed(sample, places)
    release(sample)
    return machine_of(places, bits, known, share)


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) if isinstance(model, Machine) else model for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
