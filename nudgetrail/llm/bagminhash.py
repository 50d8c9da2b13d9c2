"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A document is the multiset of its runs of ``SHINGLE`` words; a repeated run weighs as often as it
comes. Weights are discretised into dyadic intervals [0,1), [1,2), [2,4) ... Every interval of
every shingle has a Poisson process of its own; points that lie above the document's weight are
left out, and the earliest point that falls on a component of the signature gives its value. Two
signatures agree in a component with exactly the weighted Jaccard similarity as probability.
Processes stop as soon as they are later than all components, so heavy shingles cost little.

Bands of the signatures give buckets. A document is first compared with that smallest one of a
bucket with which it shares most buckets; buckets that are not one component then are compared within, in
blocks, wherever two members are not yet connected. What the signatures let pass is verified by the
exact overlap of the multisets, and components of verified links are the classes.

Texts are equal or not as a whole first: copies are one member from there on. Null and empty texts
and texts of white space are near their equals only. Rows that repeat doc_id and text are one
document, also where doc_id is null: their id is then a hash of the text (see ``identity``), which
names a class only where no member has an id below it. Texts of any length are taken whole. A
doc_id that comes with several texts is one document that is near whatever any of them is near.
Other columns are kept by ``without_copies`` and ignored otherwise; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages, slices, texts
from nudgetrail.llm.components import components
from nudgetrail.llm.identity import identified
from nudgetrail.llm.words import U64, mix, shingles_of, words_of

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Signatures let pass what lies at most five and a half standard errors below the threshold.
PASS = SIMILAR - 5.5 * (SIMILAR * (1 - SIMILAR) / SIZE) ** 0.5
#: Members of a bucket compared at a time, and the shingles that such a block has about at most.
BLOCK, ROOM = 256, 1 << 18


def weighted_shingles(
    coded: list[bytes], k: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, weight), in order, of every distinct shingle of every text."""
    name, owner = shingles_of(words_of(coded), k)
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    fresh = np.ones(len(name), dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], name[at], np.diff(np.append(at, len(name)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(
    owner: np.ndarray, name: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE
) -> np.ndarray:
    """A row of ``size`` 32-bit values for each of ``n`` bags; zeros for an empty bag."""
    earliest = np.full((n, size), np.inf)
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    item = np.repeat(np.arange(len(name)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    length = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    start = np.where(level > 0, length, 0.0)
    seed = mix(name[item] + level.astype(U64) * U64(0x9E3779B97F4A7C15), 5)
    bag, limit = owner[item], weight[item].astype(np.float64)
    time = np.zeros(len(item))
    turn = 0
    while len(seed):
        turn += 1
        time = time - np.log(_uniform(mix(seed, 2 * turn))) / length
        latest = earliest.max(axis=1)
        alive = time < latest[bag]
        seed, bag, limit, time = seed[alive], bag[alive], limit[alive], time[alive]
        length, start = length[alive], start[alive]
        draw = mix(seed, 2 * turn + 1)
        place = start + _uniform(mix(draw, 1)) * length
        component = (draw >> U64(32)) * U64(size) >> U64(32)
        within = place < limit
        np.minimum.at(earliest, (bag[within], component[within].astype(np.int64)), time[within])
    value = (mix(earliest.view(U64), 9) >> U64(32)).astype(np.uint32)
    value[np.isinf(earliest[:, 0])] = 0
    return value


Bag = tuple[np.ndarray, np.ndarray, int]


def bags(coded: list[bytes], k: int = SHINGLE) -> list[Bag]:
    """(shingles in order, weights, sum of weights) of each text."""
    owner, name, weight = weighted_shingles(coded, k)
    at = np.searchsorted(owner, np.arange(len(coded) + 1))
    return [
        (name[a:b], weight[a:b], int(weight[a:b].sum()))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist())
    ]


def overlap(a: Bag, b: Bag) -> float:
    """Exact weighted Jaccard similarity."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (a[2] + b[2] - shared)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, signature): h names the exact text, n counts its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coded = [x.encode() for x in batch.column("text").to_pylist()]
            owner, name, weight = weighted_shingles(coded)
            value = bag_signatures(owner, name, weight, len(coded))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([hashlib.md5(x).digest() for x in coded], pa.binary()),
                    pa.array(np.bincount(owner, weights=weight, minlength=len(coded)).astype(int)),
                    pa.array([x.astype("<u4").tobytes() for x in value], pa.binary()),
                ],
                names=["doc_id", "h", "n", "signature"],
            )

    return docs.mapInArrow(run, "doc_id long, h binary, n long, signature binary")


def _banded(reps: DataFrame) -> DataFrame:
    """(key, rep) for each band of each distinct text that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "signature"):
            value = _matrix(batch.column("signature")).reshape(-1, BANDS, ROWS).astype(U64)
            key = np.broadcast_to(np.arange(BANDS, dtype=U64), value.shape[:2])
            for row in range(ROWS):
                key = mix(key * U64(0x9E3779B97F4A7C15) + value[:, :, row], row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(batch.column("rep").to_numpy(False), BANDS)),
                ],
                names=["key", "rep"],
            )

    rows = reps.where("n > 0").select("rep", "signature")
    return rows.mapInArrow(run, "key long, rep long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, SIZE)


def _verified(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta"):
            one, two = (
                bags([x.encode() for x in batch.column(c).to_pylist()]) for c in ("ta", "tb")
            )
            keep = pa.array([overlap(x, y) >= SIMILAR for x, y in zip(one, two, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"]
            )

    joined = pairs.join(shared.toDF("a", "ta"), "a").join(shared.toDF("b", "tb"), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _within(members: DataFrame, reps: DataFrame, shared: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket that are not connected yet.

    Members (key, rep, component, least) are dealt to blocks of bounded size, those of the least
    component of the bucket apart. Every two blocks of a bucket meet in one group but for two of that
    component, so that no group has more than about two blocks and a text that is connected already
    goes to as many groups as there are blocks of others. A group tests what the signatures let pass,
    the most alike first, unless its links have connected the two by then, and returns its links: a
    forest at most, never all pairs.
    """

    def compare(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        part = table.column("component").to_numpy()
        value = np.frombuffer(
            b"".join(table.column("signature").to_pylist()), dtype="<u4"
        ).reshape(-1, SIZE)
        block = table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        near: list[np.ndarray] = [np.zeros((0, 3))]
        for i in np.flatnonzero(block == low):
            j = np.flatnonzero((part != part[i]) & (block == high))
            j = j[rep[j] > rep[i]] if low == high else j
            alike = (value[j] == value[i]).mean(axis=1)
            close = alike >= PASS
            near.append(
                np.column_stack([alike[close], np.full(close.sum(), i), j[close]])
            )
        tests = np.concatenate(near)
        tested = np.unique(tests[:, 1:].astype(int))
        coded = [x.encode() for x in table.column("text").take(pa.array(tested)).to_pylist()]
        bag = dict(zip(tested.tolist(), bags(coded), strict=True))
        root = {x: x for x in part.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for i, j in tests[np.argsort(-tests[:, 0], kind="stable"), 1:].astype(int).tolist():
            x, y = find(int(part[i])), find(int(part[j]))
            if x != y and overlap(bag[i], bag[j]) >= SIMILAR:
                root[max(x, y)] = min(x, y)
                a.append(max(rep[i], rep[j]))
                b.append(min(rep[i], rep[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    main = F.col("component") == F.col("least")
    sized = members.join(reps.select("rep", F.col("n").alias("shingles")), "rep")

    def blocks(which: Column) -> Column:
        n = F.ceil(F.count(F.when(which, 1)) / BLOCK)
        return F.greatest(n, F.ceil(F.sum(F.when(which, F.col("shingles")).otherwise(0)) / ROOM))

    small = (F.count("*") <= BLOCK) & (F.sum("shingles") <= ROOM)
    counted = sized.groupBy("key").agg(
        F.when(small, 0).otherwise(blocks(main)).cast("int").alias("mains"),
        F.when(small, 1).otherwise(blocks(~main)).cast("int").alias("others"),
    )
    spread, apart = F.xxhash64("rep"), main & (F.col("mains") > 0)
    block = F.when(apart, F.col("others") + F.pmod(spread, F.greatest("mains", F.lit(1))))
    block = block.otherwise(F.pmod(spread, "others")).cast("int")
    last = F.when(apart, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = members.join(counted, "key").withColumn("block", block)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "key", "rep", "component", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    met = met.join(reps.select("rep", "signature").join(shared, "rep"), "rep")
    return met.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def _classes(rows: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, class_id) of rows (doc_id, text) that have ids and no repeats."""
    signed = stages.cut(signatures(rows), "signed")
    first = signed.groupBy("h").agg(F.min(F.struct("doc_id", "n", "signature")).alias("x"))
    reps = stages.cut(
        first.select("h", F.col("x.doc_id").alias("rep"), "x.n", "x.signature"), "reps"
    )

    banded = _banded(reps)
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n"))
    hubs = stages.cut(hubs.where("n > 1"), "hubs")
    members = stages.cut(_banded(reps).join(hubs, "key"), "members")
    shared_ids = stages.cut(members.select(F.col("rep").alias("doc_id")).distinct(), "shared-ids")
    shared = stages.cut(rows.join(shared_ids, "doc_id", "left_semi").toDF("rep", "text"), "shared")

    # The hub that shares most buckets with a member is the likeliest to be near it.
    star = members.where("rep > hub").groupBy("rep", "hub").agg(F.count("*").alias("bands"))
    best = star.groupBy("rep").agg(F.max(F.struct("bands", "hub")).alias("x"))
    best = stages.cut(best.select(F.col("rep").alias("a"), F.col("x.hub").alias("b")), "best")
    links = stages.cut(_verified(best, shared), "links")

    # A hub is smaller than what links to it: two jumps bring most members to one root. Whoever is
    # not there yet is only tested once more than it had to be.
    up = links.toDF("rep", "up")
    over = links.toDF("up", "over")
    far = stages.cut(
        up.join(over, "up", "left").select("rep", F.coalesce("over", "up").alias("up")), "far"
    )
    far = far.join(far.toDF("up", "over"), "up", "left")
    known = stages.cut(far.select("rep", F.coalesce("over", "up").alias("component")), "known")
    placed = members.join(known, "rep", "left")
    placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    )
    mixed = stages.cut(mixed.where("least < most").select("key", "least"), "mixed")
    more = stages.cut(_within(placed.join(mixed, "key"), reps, shared), "more-links")

    joined = components(links.unionByName(more), stages, "all").withColumnRenamed("node", "rep")
    classes = stages.cut(
        reps.select("h", "rep")
        .join(joined, "rep", "left")
        .select("h", F.coalesce("component", "rep").alias("class_id")),
        "classes",
    )
    stages.drop("hubs", "members", "reps", "shared", "mixed", "known")
    return signed.select("doc_id", "h").join(classes, "h").select("doc_id", "class_id").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept): the smallest id of a class names it and is kept."""
    stages = Stages(docs.sparkSession, "bagminhash")
    rows, key = identified(texts(docs), stages)
    found = _classes(rows.select(F.col(key).alias("doc_id"), "text"), stages)
    nameless = rows.where("doc_id IS NULL").select(F.col(key).alias("doc_id"), F.lit(True).alias("made"))
    return found.join(nameless.distinct(), "doc_id", "left").select(
        F.when(F.col("made").isNull(), F.col("doc_id")).alias("doc_id"), "class_id",
        (F.col("doc_id") == F.col("class_id")).alias("kept"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for one of each class of near-duplicates, and one of repeated rows."""
    stages = Stages(docs.sparkSession, "bagminhash")
    rows, key = identified(docs, stages)
    found = _classes(texts(rows.select(F.col(key).alias("doc_id"), "text")), stages)
    gone = found.where("doc_id != class_id").select(F.col("doc_id").alias(f"{key}gone"))
    gone = stages.cut(gone.distinct(), "gone")
    left = rows.join(gone, F.col(key) == F.col(f"{key}gone"), "left_anti")
    return left.select(*docs.columns)
