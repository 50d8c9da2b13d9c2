"""Quality scores by positive-unlabelled learning: the non-negative unbiased risk.

Trusted positives are documents labelled 1; everything else is unlabelled web text. A small network
on features of the text alone is trained to minimise

    prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

where the class prior is estimated from how many positives and unlabelled texts of a held-back part
reach the same score. Outputs are calibrated against the same two samples. The model is fitted on bounded hash samples (``POSITIVES`` and ``UNLABELLED``
are their expected sizes); scoring reads every whole text once.

A null text counts as empty, and an empty text has a score like any other. A null doc_id is in the
held-out fold. A document with several labels is a positive only if all of them are 1; null labels
say nothing. Rows that repeat are scored one by one. Without any positive the score is 1 for all:
nothing is known against them. An empty table gives no row. Other columns are ignored: labels,
language, source and doc_id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import slices, texts
from nudgetrail.llm.words import words_of

POSITIVES, UNLABELLED = 12_000, 16_000
FOLDS, KEEP = 5, 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 512, 3e-3, 1e-4
SEED = 11

#: Classes of bytes: what a byte is for the shape of a text, not which letter.
_CLASS = np.zeros(256, dtype=np.int64)  # 0: control
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[32], _CLASS[10] = 4, 5
_CLASS[128:] = 6
for _group, _marks in enumerate((".", ",", "!?", "'\"-", "()[]{}", "|", "#%&*$@^~=+", "<>/\\_`:;")):
    for _c in _marks:
        _CLASS[ord(_c)] = 7 + _group
CLASSES = 15
WIDTH = CLASSES * CLASSES + 8


def features(coded: list[bytes]) -> np.ndarray:
    """Shape of each text: which classes of bytes follow each other, words and repeats."""
    n = len(coded)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    size = np.fromiter(map(len, coded), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    if len(data):
        owner = np.repeat(np.arange(n), size)
        kind = _CLASS[data]
        code = owner[1:] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:]
        pairs = np.bincount(code[owner[1:] == owner[:-1]], minlength=n * CLASSES**2)
        part = pairs.reshape(n, -1) / np.maximum(1, size - 1)[:, None]
        out[:, : CLASSES**2] = np.sqrt(part)
    words = words_of(coded)
    count = np.diff(words.first)
    of = np.repeat(np.arange(n), count)
    order = np.lexsort((words.hash, of))
    first = np.ones(len(of), dtype=bool)
    same = words.hash[order][1:] == words.hash[order][:-1]
    first[1:] = ~(same & (of[order][1:] == of[order][:-1]))
    again = np.zeros(len(of))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    length = (words.end - words.start).astype(np.float64)
    lines = [x.split(b"\n") for x in coded]
    some = np.maximum(1, count)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / some - mean**2))
    shape = (
        np.log1p(count),
        np.log1p(size),
        mean / 8,
        spread / 8,
        np.bincount(of[order], first, n) / some,
        np.bincount(of, again, n) / some,
        [1 - len(set(x)) / len(x) for x in lines],
        np.log1p([len(x) for x in lines]),
    )
    out[:, CLASSES**2 :] = np.column_stack(shape)
    return out


@dataclass
class Model:
    """Standardised features through one hidden layer to the probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float
    knots: np.ndarray | None = None  # logits, in order, and the calibrated score at each
    heights: np.ndarray | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.logit(x)
        raw = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if self.knots is None:
            return raw
        # A little of the raw score keeps apart what calibration makes equal.
        return 0.98 * np.interp(z, self.knots, self.heights) + 0.02 * raw


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk with logistic loss by Adam."""
    rng = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-2
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    params = [
        rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    step, turns = 0, max(40, len(u) // BATCH)
    for _ in range(EPOCHS):
        for _ in range(turns):
            xp = p[rng.integers(0, len(p), BATCH)]
            xu = u[rng.integers(0, len(u), BATCH)]
            x = np.concatenate([xp, xu])
            w1, b1, w2, b2 = params
            hidden = np.tanh(x @ w1 + b1)
            z = hidden @ w2 + b2
            prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            as_zero = np.logaddexp(0, z)
            negative = as_zero[BATCH:].mean() - prior * as_zero[:BATCH].mean()
            g = np.zeros_like(z)
            if negative >= 0:
                g[:BATCH] = prior * (prob[:BATCH] - 1) / BATCH - prior * prob[:BATCH] / BATCH
                g[BATCH:] = prob[BATCH:] / BATCH
            else:  # the estimate of the negatives' risk must not be pushed below 0: step back
                g[:BATCH] = prior * prob[:BATCH] / BATCH
                g[BATCH:] = -prob[BATCH:] / BATCH
            back = np.outer(g, w2) * (1 - hidden**2)
            grads = [x.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ g + DECAY * w2]
            grads.append(np.array([g.sum()]))
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                change = first[i] / (1 - 0.9**step)
                params[i] = params[i] - RATE * change / (
                    np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
                )
    w1, b1, w2, b2 = params
    return Model(mean, scale, w1, b1, w2, float(b2[0]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest part of positives that the unlabelled scores leave room for.

    For every score, the unlabelled texts that reach it hold at least ``prior`` times the part of
    the positives that do; the bound is taken where it is least, with its sampling error added.
    """
    bounds = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    part_p = np.array([(positive >= b).mean() for b in bounds])
    part_u = np.array([(unlabelled >= b).mean() for b in bounds])
    error = np.sqrt(part_u * (1 - part_u) / len(unlabelled)) + np.sqrt(
        part_p * (1 - part_p) / len(positive)
    )
    return float(np.clip(np.min((part_u + error) / part_p), 0.02, 0.98))


def calibrated(model: Model, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Scores as prior times the positives' density over that of the unlabelled, made monotone.

    Logits are binned by their own quantiles; neighbours out of order are pooled.
    """
    p, u = np.sort(model.logit(positive)), np.sort(model.logit(unlabelled))
    both = np.sort(np.concatenate([p, u]))
    bins = int(np.clip(len(both) // 40, 2, 200))
    edge = np.unique(np.quantile(both, np.linspace(0, 1, bins + 1)))
    if len(edge) < 3:
        return model
    in_p = np.diff(np.searchsorted(p, edge[1:-1]), prepend=0, append=len(p))
    in_u = np.diff(np.searchsorted(u, edge[1:-1]), prepend=0, append=len(u))
    pools: list[list[float]] = []  # positives, unlabelled, bins
    for a, b in zip(in_p / len(p), in_u / len(u), strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, n = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + n]
    heights = [x for a, b, n in pools for x in [min(1.0, model.prior * a / max(b, 1e-9))] * n]
    model.knots, model.heights = (edge[:-1] + edge[1:]) / 2, np.array(heights)
    return model


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """Estimates the class prior on every fourth text, then trains on all of them."""
    if not len(positive) or not len(unlabelled):
        return None
    back_p, back_u = np.arange(len(positive)) % 4 == 0, np.arange(len(unlabelled)) % 4 == 0
    prior = 0.5
    if not back_p.all() and not back_u.all():
        rough = _train(positive[~back_p], unlabelled[~back_u], prior)
        prior = class_prior(rough.logit(positive[back_p]), rough.logit(unlabelled[back_u]))
    return calibrated(_train(positive, unlabelled, prior), positive, unlabelled)


def fold(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % FOLDS).cast("int")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from bounded samples; the fold of remainder 0 never takes part as a label."""
    known = (
        labels.where("quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .where((F.col("quality") == 1) & (fold(F.col("doc_id")) != 0))
        .select("doc_id", F.lit(True).alias("positive"))
    )
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11) / F.lit(float(1 << 53))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n_known, n_docs = known.count(), ids.count()
    chosen = known.where(draw < POSITIVES / max(1, n_known))
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Bounded by POSITIVES, whatever the tables hold.
    rows = rows.join(F.broadcast(chosen), "doc_id", "left")
    unlabelled = F.xxhash64(F.lit(SEED + 1), "doc_id")
    unlabelled = F.shiftrightunsigned(unlabelled, 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("open", F.coalesce(unlabelled < UNLABELLED / max(1, n_docs), F.lit(False)))
    rows = rows.where("positive OR open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("positive"),
                    batch.column("open"),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                ],
                names=["doc_id", "positive", "open", "x"],
            )

    schema = "doc_id long, positive boolean, open boolean, x binary"
    sample = rows.select("doc_id", "positive", "open", "text").mapInArrow(run, schema).toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), dtype=np.float32)
    x = x.reshape(-1, WIDTH)
    positive = np.array(sample.column("positive").to_pylist(), dtype=object) == True  # noqa: E712
    return fit(x[positive], x[np.array(sample.column("open").to_pylist(), dtype=bool)])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coded = [t.encode() for t in batch.column("text").to_pylist()]
            p = model.score(features(coded)) if model else np.ones(len(coded))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(p.astype(np.float64))],
                names=["doc_id", "score"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``keep``, with the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coded = [(t or "").encode() for t in batch.column("text").to_pylist()]
            if model is None:
                yield batch
            else:
                yield batch.filter(pa.array(model.score(features(coded)) >= keep))

    return docs.mapInArrow(run, docs.schema)
