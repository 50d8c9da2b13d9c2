"""Hard negatives of anchor vectors by angular triangle filtering.

Components are quantised to ``floor(scale * x)``; a score is the integer inner product of two
quantised vectors. Every vector keeps its angles to a few reference directions. Angles on a sphere
obey the triangle inequality, so the angles of an anchor and of a vector to one direction bound the
angle between the two from below and above, and with the norms their score. Bounds are widened by
more than rounding can move them; only vectors whose bounds overlap the window that is asked for are
scored, in exact integers. Vectors are first bounded a tile at a time, in order of their nearest
direction, then one by one.

Positives of an anchor are its best ``positives`` other rows of its label. For each of them, the
negatives are the best ``negatives`` rows of another label with
``low * positive <= 100 * score <= high * positive``. Higher scores come first, ties by smaller
vec_id, then by the row's place in the stage.

Directions are centres of a sample of about ``SAMPLE`` vectors; they change the speed, never a
result. Anchors and vectors are dealt to groups of bounded size by a hash of the row; each group of
anchors meets each group of vectors in one task, which returns the best few an anchor only.

Rows with a null vec_id, label or vector, or with a component that is null or not finite (also once
scaled) take no part. An anchor's other rows are those of another vec_id, so rows that repeat are
ranked one after the other and each repeated anchor has rows of its own. Vectors of another length
than the anchor's are never scored against it; zero and empty vectors score 0. Scores that a long
cannot hold count as the nearest long. Other columns are ignored, an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
DIRECTIONS, SAMPLE, TURNS = 24, 2048, 6
PROBES = 4  # directions compared for an anchor: those nearest to it or to its opposite
TILE = 256
VECTORS, ANCHORS = 1 << 15, 1 << 12  # most in a group
SPREAD = 32  # groups of vectors at least, where there are enough of them
MARGIN = 1e-5  # radians; arc cosines of rounded cosines are off by less
EXACT = float(1 << 52)  # sums below are exact in double precision
LONG = (1 << 63) - 1


def _finite(vector: Column) -> Column:
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf")),
    )
    return vector.isNotNull() & ~bad


def _norms(q: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow of the squares."""
    most = np.maximum(np.abs(q).max(axis=1, initial=0), 1)
    return most * np.sqrt(((q / most[:, None]) ** 2).sum(axis=1))


def directions(sample: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit centres of the sample's unit vectors, by a few turns of spherical k-means."""
    norm = _norms(sample)
    unit = sample[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    centre = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)]
    for _ in range(TURNS):
        near = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], centre)
    return centre


def angles_to(refs: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle of every row to every direction, norms); directions are cut or padded to fit."""
    width = q.shape[1]
    fit = np.zeros((max(1, len(refs)), width))
    kept = min(width, refs.shape[1])
    fit[: len(refs), :kept] = refs[:, :kept]
    size = np.linalg.norm(fit, axis=1)
    if width:
        fit[size == 0, 0] = 1
    fit /= np.where(size > 0, size, 1)[:, None]
    norm = _norms(q)
    unit = q / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(unit @ fit.T, -1, 1)), norm


def _fold(angle: np.ndarray) -> np.ndarray:
    return np.minimum(angle, 2 * np.pi - angle)


def score_bounds(
    angle: np.ndarray,
    norm: float,
    least: np.ndarray,
    most: np.ndarray,
    least_norm: np.ndarray,
    most_norm: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of an anchor's scores with sets of vectors, given the ranges of their angles and norms.

    ``least`` and ``most`` are (directions, sets); a single vector is a set with equal ends.
    """
    near, far = np.zeros(least.shape[1]), np.full(least.shape[1], np.pi)
    for c in np.argsort(np.minimum(angle, np.pi - angle), kind="stable")[:PROBES]:
        a, lo, hi = angle[c], least[c], most[c]
        np.maximum(near, np.maximum(lo - a, a - hi), out=near)
        opposite = (lo <= np.pi - a) & (np.pi - a <= hi)
        reach = np.where(opposite, np.pi, np.maximum(_fold(a + lo), _fold(a + hi)))
        np.minimum(far, reach, out=far)
    top, bottom = np.cos(np.maximum(near - MARGIN, 0)), np.cos(np.minimum(far + MARGIN, np.pi))
    with np.errstate(over="ignore", invalid="ignore"):
        upper = top * norm * np.where(top > 0, most_norm, least_norm)
        lower = bottom * norm * np.where(bottom > 0, least_norm, most_norm)
        slack = 1 + 1e-9 * norm * most_norm
        upper, lower = upper + slack, lower - slack
    wide = ~np.isfinite(upper) | ~np.isfinite(lower)
    return np.where(wide, -np.inf, lower), np.where(wide, np.inf, upper)


def exact_scores(anchor: np.ndarray, norm: float, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Integer inner products as longs; beyond double precision with Python's integers."""
    if not len(q):
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        plain = norm * float(norms.max()) < EXACT
    if plain:
        return (q @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    sums = (sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in q)
    return np.array([max(-LONG, min(LONG, s)) for s in sums], dtype=np.int64)


class Vectors:
    """Vectors of one length in a task, ordered by label and nearest direction, in tiles."""

    def __init__(self, rows: pa.Table, width: int):
        q = np.frombuffer(b"".join(rows.column("q").to_pylist())).reshape(rows.num_rows, width)
        angle = np.frombuffer(b"".join(rows.column("angles").to_pylist()))
        angle = angle.reshape(rows.num_rows, -1)
        cols = {c: rows.column(c).to_numpy() for c in ("row", "vec_id", "label", "norm")}
        near = angle.argmin(axis=1)
        order = np.lexsort((angle[np.arange(len(near)), near], near, cols["label"]))
        self.q, self.angle = q[order], np.ascontiguousarray(angle[order].T)
        self.row, self.vec_id, self.label, self.norm = (x[order] for x in cols.values())
        self.tile = np.arange(0, len(order), TILE)
        self.least = np.minimum.reduceat(self.angle, self.tile, axis=1)
        self.most = np.maximum.reduceat(self.angle, self.tile, axis=1)
        self.least_norm = np.minimum.reduceat(self.norm, self.tile)
        self.most_norm = np.maximum.reduceat(self.norm, self.tile)

    def bounded(self, angle: np.ndarray, norm: float, floor: float, ceiling: float):
        """(places, lower, upper) of the vectors whose bounds reach from floor to ceiling."""
        low, high = score_bounds(
            angle, norm, self.least, self.most, self.least_norm, self.most_norm
        )
        tiles = np.flatnonzero((high >= floor) & (low <= ceiling))
        if len(tiles) == len(self.tile):
            at, rows, norms = np.arange(len(self.row)), self.angle, self.norm
        else:
            at = (self.tile[tiles][:, None] + np.arange(TILE)).ravel()
            at = at[at < len(self.row)]
            rows, norms = self.angle[:, at], self.norm[at]
        low, high = score_bounds(angle, norm, rows, rows, norms, norms)
        kept = (high >= floor) & (low <= ceiling)
        return at[kept], low[kept], high[kept]

    def best(self, at: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
        """Places among ``at`` of the best rows, best first."""
        if len(at) > count:
            floor = np.partition(scores, len(scores) - count)[len(scores) - count]
            some = np.flatnonzero(scores >= floor)
        else:
            some = np.arange(len(at))
        rank = np.lexsort((self.row[at[some]], self.vec_id[at[some]], -scores[some]))
        return some[rank[:count]]


def _segment(labels: np.ndarray, label: int) -> slice:
    return slice(*np.searchsorted(labels, [label, label + 1]).tolist())


def _anchor_rows(anchors: pa.Table) -> Iterator[tuple]:
    for a in anchors.to_pylist():
        yield a, np.frombuffer(a["q"]), np.frombuffer(a["angles"])


def best_positives(vectors: Vectors, anchor: dict, q: np.ndarray, angle: np.ndarray, count: int):
    """(places, scores) of the best rows of the anchor's label, best first."""
    own = _segment(vectors.label, anchor["label"])
    at = np.arange(own.start, own.stop)
    at = at[vectors.vec_id[at] != anchor["vec_id"]]
    rows, norms = vectors.angle[:, at], vectors.norm[at]
    low, high = score_bounds(angle, anchor["norm"], rows, rows, norms, norms)
    if len(at) > count:  # the worst that the count-th best can be
        at = at[high >= np.partition(low, len(low) - count)[len(low) - count]]
    scores = exact_scores(q, anchor["norm"], vectors.q[at], vectors.norm[at])
    best = vectors.best(at, scores, count)
    return at[best], scores[best]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer score between low and high per cent of a positive's."""
    return -(-low * score // 100), high * score // 100


def best_negatives(
    vectors: Vectors,
    anchor: dict,
    q: np.ndarray,
    angle: np.ndarray,
    windows: list[tuple[int, int]],
    count: int,
):
    """For each window, (places, scores) of the best rows of other labels in it, best first."""
    some = [w for w in windows if w[0] <= w[1]]
    if not some:
        return [(np.zeros(0, dtype=np.int64),) * 2 for _ in windows]
    floor, ceiling = min(w[0] for w in some), max(w[1] for w in some)
    at, low, high = vectors.bounded(angle, anchor["norm"], float(floor), float(ceiling))
    asked = np.zeros(len(at), dtype=bool)
    for a, b in set(some):
        asked |= (high >= a) & (low <= b)
    at = at[asked & (vectors.label[at] != anchor["label"])]
    scores = exact_scores(q, anchor["norm"], vectors.q[at], vectors.norm[at])
    out = []
    for a, b in windows:
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        best = inside[vectors.best(at[inside], scores[inside], count)]
        out.append((at[best], scores[best]))
    return out


def _stage(vectors: DataFrame, anchor: Column, refs: np.ndarray) -> DataFrame:
    """Quantised rows with norms and angles, and a number of their own."""
    names = ["vec_id", "label", "anchor", "width", "q", "norm", "angles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            width = np.diff(lists.offsets.to_numpy())
            flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            first = np.concatenate([[0], np.cumsum(width)])
            q: list = [None] * len(width)
            angles: list = [None] * len(width)
            norm = np.zeros(len(width))
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                part = flat[(first[rows][:, None] + np.arange(w))]
                angle, norm[rows] = angles_to(refs, part)
                for i, row in enumerate(rows.tolist()):
                    q[row], angles[row] = part[i].tobytes(), angle[i].tobytes()
            cols = [batch.column(x) for x in names[:3]]
            cols += [pa.array(width, pa.int32()), pa.array(q, pa.binary()), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(angles, pa.binary())], names=names)

    schema = "vec_id long, label long, anchor boolean, width int, q binary, norm double, angles binary"
    rows = vectors.select("vec_id", "label", anchor.alias("anchor"), "vector")
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _top(rows: DataFrame, keys: list[str], score: str, ties: list[str], count: int) -> DataFrame:
    """Of every key the first rows by score, with their rank; cut within tasks before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    stages: Stages,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    most_vectors: int = VECTORS,
    most_anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and vector; ``anchor`` says of a row whether it is one.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<double>").alias("vector"),
    ).where(_finite(F.col("vector")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    total = rows.count()
    drawn = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / F.lit(float(1 << 53))
    sample = rows.where(drawn < SAMPLE / max(1, total)).limit(2 * SAMPLE).toPandas()
    width = max(map(len, sample["vector"]), default=1)
    fit = [x for x in sample["vector"] if len(x) == width]
    refs = directions(np.array(fit, dtype=np.float64).reshape(len(fit), width))

    stage = stages.cut(_stage(rows, F.coalesce(anchor, F.lit(False)), refs), "vectors")
    asked = stage.where("anchor")
    n_asked = asked.count()
    groups = max(math.ceil(total / most_vectors), min(SPREAD, math.ceil(total / TILE)), 1)
    sides = max(math.ceil(n_asked / most_anchors), 1)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Each row in its own group, once for every group of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>"))
        )

    everything = dealt(stage.drop("anchor"), "group", groups, "side", sides)

    def met(anchors: DataFrame, run, schema: str) -> DataFrame:
        left = dealt(anchors, "side", sides, "group", groups)
        keys = ("side", "group")
        return left.groupBy(*keys).cogroup(everything.groupBy(*keys)).applyInArrow(run, schema)

    def by_width(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, Vectors]]:
        for w in pc.unique(anchors.column("width")).to_pylist():
            fit = rows.filter(pc.equal(rows.column("width"), w))
            if fit.num_rows:
                yield anchors.filter(pc.equal(anchors.column("width"), w)), Vectors(fit, w)

    def positive_run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        for some, there in by_width(anchors, rows):
            for a, q, angle in _anchor_rows(some):
                at, scores = best_positives(there, a, q, angle, positives)
                out.append([np.full(len(at), a["row"]), there.row[at], there.vec_id[at], scores])
        return _arrow(out, ["row", "positive", "positive_id", "positive_score"])

    long4 = "row long, positive long, positive_id long, positive_score long"
    found = met(asked.drop("anchor"), positive_run, long4)
    ties = ["positive_id", "positive"]
    found = _top(found, ["row"], "positive_score", ties, positives)
    first = found.groupBy("row").agg(
        F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("pairs")
    )
    mined = stages.cut(asked.drop("anchor").join(first, "row"), "anchors")

    def negative_run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        for some, there in by_width(anchors, rows):
            for a, q, angle in _anchor_rows(some):
                asked = [window(p["positive_score"], low, high) for p in a["pairs"]]
                got = best_negatives(there, a, q, angle, asked, negatives)
                for p, (at, scores) in zip(a["pairs"], got, strict=True):
                    same = (a["row"], a["vec_id"], *(p[k] for k in _PAIR))
                    out.append(
                        [*(np.full(len(at), x) for x in same), there.row[at], there.vec_id[at], scores]
                    )
        return _arrow(out, _MINED)

    rows = met(mined, negative_run, ", ".join(f"{x} long" for x in _MINED))
    best = _top(rows, ["row", "positive"], "negative_score", ["negative_id", "negative"], negatives)
    return best.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


_PAIR = ("positive", "positive_id", "positive_score")
_MINED = ["row", "anchor_id", *_PAIR, "negative", "negative_id", "negative_score"]


def _arrow(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    cols = [
        np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        for i in range(len(names))
    ]
    return pa.table([pa.array(c) for c in cols], names=names)
