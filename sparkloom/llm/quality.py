"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features, those of the line before and those of
the line after score either state; two-by-two transition weights tie neighbours.
Forward-backward gives each line's probability of being good; their mean,
weighted by line length, is the document's raw quality, and a logistic map fitted
on the training documents turns it into the score.

Only documents carry labels, so in training each line takes the label of its
document. The field is fitted on a bounded sample of rows, at most PER_CLASS
documents of either label, of which every line counts. Documents are dealt over
shards of about SHARD_LINES lines, each shard fits a field in a task of its own,
and the fields' weights are averaged by their lines (parameter mixture); in
training a document of more than CHAIN lines is several chains. Lines of one
document always share a label, which alone would drive the transition weights to
infinity: a Gaussian prior of their own (TIE_RIDGE) is part of what is fitted.

Scoring reads all lines of all texts, each document as one chain. Features are
made for BLOCK_LINES lines at a time and only the two state scores of a line are
kept, so memory grows with the number of lines by some hundred bytes each.

Defined results: a null or empty text is one empty line and gets a score; of very
long texts every line counts; equal texts get equal scores, so ties and repeated
rows are scored one by one alike; if the labels lack a class, every score is the
smoothed share of label 1, and keep_good keeps all; an empty table gives an empty
result; columns other than doc_id and text are not read, and keep_good returns
all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, materialise, release, texts

PER_CLASS = 1500
THRESHOLD = 0.7
#: Lines of a training shard, and of a chain in training.
SHARD_LINES = 25_000
CHAIN = 4096
#: Strength of the prior on transition weights, for each line.
TIE_RIDGE = 0.1
#: Lines whose features are held at once, and that forward-backward takes at once (a document isn't split).
BLOCK_LINES = 8192

_LETTERS_UP = bytes(range(65, 91))
_LETTERS_LOW = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"#$%&*+<=>@[\\]^_`{|}~"
_STOPS = b"!?"
_POINTS = b".,;:'\"()-"
_WIDE = bytes(range(128, 256))
#: Own features of a line; last is 1 for every line.
N = 14


def line_features(line: bytes) -> list[float]:
    """What one line shows: shares of kinds of characters, repetition, form."""
    n = len(line)
    if not n:
        return [0.0] * (N - 2) + [1.0, 1.0]
    words = line.split()
    k = len(words) or 1
    share = [(n - len(line.translate(None, kind))) / n for kind in (_LETTERS_UP, _LETTERS_LOW, _DIGITS, _MARKS, _STOPS, _POINTS, _WIDE)]
    again = sum(map(eq, words, words[1:])) / k
    return [
        *share,
        again,
        1.0 - len(set(words)) / k if k > 1 else 0.0,
        float(again > 0.3),
        float(share[3] > 0.05 or share[4] > 0.05),
        min(n / k, 40.0) / 40.0,
        0.0,
        1.0,
    ]


def lines_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def features_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of lines."""
    return np.array([line_features(x) for x in lines]), np.array([max(1, len(x)) for x in lines], float)


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after; none beyond a document's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    begins = np.cumsum(sizes) - sizes
    before[begins] = 0
    after[begins + sizes - 1] = 0
    return np.concatenate([own, before, after], axis=1)


def state_scores(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores of both states, lengths) of a text's lines; features are held for a block of lines only."""
    lines = lines_of(text)
    scores, lengths = [], []
    for at in range(0, len(lines), BLOCK_LINES):
        low, high = max(0, at - 1), min(len(lines), at + BLOCK_LINES + 1)
        own, sizes = features_of(lines[low:high])
        x = with_neighbours(own, np.array([len(own)]))
        inside = slice(at - low, at - low + min(BLOCK_LINES, len(lines) - at))
        scores.append(x[inside] @ weights)
        lengths.append(sizes[inside])
    return np.concatenate(scores), np.concatenate(lengths)


def forward_backward(unary: np.ndarray, tie: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line (n, 2), expected transitions (2, 2) and the sum of log Z, for documents of `sizes` lines.

    Documents step through their lines together, longest first, so that the
    Python loop is as long as the longest document, not as all of them.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    longest = int(left[0])
    alive = np.searchsorted(-left, -np.arange(longest), "left")
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)

    def step(values: np.ndarray) -> np.ndarray:
        return np.logaddexp(values[:, :1] + tie[0], values[:, 1:] + tie[1])

    for t in range(longest):
        at = begins[: alive[t]] + t
        alpha[at] = unary[at] + (step(alpha[at - 1]) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = begins[: alive[t + 1]] + t
        ahead = unary[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(tie[:, 0] + ahead[:, :1], tie[:, 1] + ahead[:, 1:])
    ends = begins + left - 1
    z_doc = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.repeat(z_doc[np.argsort(order)], sizes)
    marginal = np.exp(alpha + beta - z[:, None])
    inner = np.ones(len(unary), bool)
    inner[ends] = False
    pairs, inside = np.zeros((2, 2)), np.flatnonzero(inner)
    for at in range(0, len(inside), 1 << 16):
        i = inside[at : at + (1 << 16)]
        pairs += np.exp(alpha[i, :, None] + tie + (unary[i + 1] + beta[i + 1])[:, None, :] - z[i, None, None]).sum(axis=0)
    return marginal, pairs, float(z_doc.sum())


def raw_quality(unary: np.ndarray, tie: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean probability of a good line in each document, by length."""
    marginal, _, _ = forward_backward(unary, tie, sizes)
    begins = np.cumsum(sizes) - sizes
    return np.add.reduceat(marginal[:, 1] * lengths, begins) / np.add.reduceat(lengths, begins)


@dataclass
class Field:
    """Weights of states and transitions, and the logistic map from the raw quality to the score."""

    weights: np.ndarray
    tie: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, found: Iterator[str]) -> Iterator[float]:
        """Raw quality of texts, forward-backward running over blocks of whole documents."""
        held, lines = [], 0
        for text in found:
            held.append(state_scores(text, self.weights))
            lines += len(held[-1][1])
            if lines >= BLOCK_LINES:
                yield from self._block(held)
                held, lines = [], 0
        if held:
            yield from self._block(held)

    def _block(self, held: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        sizes = np.array([len(n) for _, n in held])
        return raw_quality(np.concatenate([u for u, _ in held]), self.tie, np.concatenate([n for _, n in held]), sizes).tolist()

    def scores(self, found: Iterator[str]) -> Iterator[float]:
        for r in self.raw(found):
            yield float(1 / (1 + np.exp(-np.clip(self.slope * r + self.shift, -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic regression, by Newton's method, both classes weighing the same."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    slope = shift = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-9)
        a = np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + ridge]])
        move = np.linalg.solve(a, np.array([(g * x).sum() - ridge * slope, g.sum() - ridge * shift]))
        slope, shift = slope + np.clip(move[0], -5, 5), shift + np.clip(move[1], -5, 5)
    return float(slope), float(shift)


def train(own: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Weights of states, then transitions, by gradient ascent (Adam) on the log-likelihood of chains of `sizes` lines with its priors."""
    truth = np.eye(2)[np.repeat(labels, sizes)]
    total = len(own)
    tied = np.zeros((2, 2))
    np.add.at(tied, (labels, labels), sizes - 1)
    values = np.zeros(N * 3 * 2 + 4)
    prior = np.concatenate([np.full(N * 3 * 2, ridge), np.full(4, TIE_RIDGE)])
    m, v = np.zeros_like(values), np.zeros_like(values)
    x = with_neighbours(own, sizes)
    for k in range(1, rounds + 1):
        weights, tie = values[:-4].reshape(-1, 2), values[-4:].reshape(2, 2)
        marginal, pairs, _ = forward_backward(x @ weights, tie, sizes)
        slope = np.concatenate([(x.T @ (truth - marginal)).ravel(), (tied - pairs).ravel()]) / total - prior * values
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        values = values + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return values


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chain, label, lines, own): the features of every line of a text, in chains of at most CHAIN lines; chain is a hash, the same at each run."""
    names, kinds = ["chain", "label", "lines", "own"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for text, label in zip(texts(batch), batch.column(1).to_pylist()):
            lines = lines_of(text)
            for at in range(0, len(lines), CHAIN):
                own = features_of(lines[at : at + CHAIN])[0].astype(np.float32).tobytes()
                row = xxhash.xxh64_intdigest(own) >> 1, label, min(CHAIN, len(lines) - at), own
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def _fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The weights of one shard, as (lines, values)."""
    rows = rows.sort_values(["chain", "label"], kind="stable")
    own = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, N) for b in rows["own"]]).astype(float)
    values = train(own, rows["lines"].to_numpy(), rows["label"].to_numpy())
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "lines": [len(own)], "weights": [values.tolist()]})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field | float:
    """The field, from a sample of at most 2 * per_class documents; the share of label 1 if there is only one class.

    One row of weights for each shard and one raw quality for each document of
    the sample reach the driver.
    """
    sample = materialise(labelled_sample(docs, labels, "quality", per_class).select("text", "label"), "quality-sample")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        release(sample)
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chains = materialise(sample.mapInArrow(_chains, "chain long, label int, lines long, own binary"), "quality-chains")
    shards = -(-chains.agg(F.sum("lines")).first()[0] // SHARD_LINES)
    dealt = chains.withColumn("shard", F.col("chain") % shards)
    fitted = dealt.groupBy("shard").applyInPandas(_fit_shard, "shard long, lines long, weights array<double>").collect()
    fitted.sort(key=lambda r: r["shard"])
    values = np.average([r["weights"] for r in fitted], axis=0, weights=[r["lines"] for r in fitted])
    field = Field(values[:-4].reshape(-1, 2), values[-4:].reshape(2, 2))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(field.raw(texts(batch)), pa.float64()), batch.column(1)], ["raw", "label"])

    seen = sorted((r["raw"], r["label"]) for r in sample.mapInArrow(raw, "raw double, label int").collect())
    field.slope, field.shift = fit_logistic(np.array([r for r, _ in seen]), np.array([y for _, y in seen]))
    release(sample, chains)
    return field


def _scored(model: Field | float, found: Iterator[str]) -> Iterator[float]:
    return model.scores(found) if isinstance(model, Field) else (model for _ in found)


def score(docs: DataFrame, model: Field | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(_scored(model, texts(batch)), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Field | float) -> DataFrame:
    """The rows of docs that the classifier accepts; a model without both classes rejects nothing."""
    if not isinstance(model, Field):
        return docs

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s >= THRESHOLD for s in model.scores(v.as_py() or "" for v in batch)], pa.bool_())

    return docs.where(good(docs["text"]))
