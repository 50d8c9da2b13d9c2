"""Order MinHash fingerprints: signatures that are sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so that repeats differ. Each of
``TUPLES`` permutations selects the ``2`` smallest numbered k-mers, keeps them in text order and
hashes them to 32 bits. Two texts are as alike as the part of equal hashes.

A text shorter than ``K`` is one k-mer; an empty or null text has none, and its fingerprint equals
only that of another empty one. Long texts are taken whole, in memory linear in their length. The
next document is that with the next smaller doc_id, null last; rows with the same doc_id are in
the order of their text. After the last comes the first; a single row comes after itself. Other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import slices, texts
from nudgetrail.llm.words import U64, hash_spans, mix

K = 12
TUPLES = 48
AT_ONCE = 1 << 21  # numbered k-mers times permutations held at a time
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
_ODD = mix(np.arange(TUPLES, dtype=U64), 17) | U64(1)
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit name of every k-mer with its occurrence number, in text order."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(code):
        return np.zeros(0, dtype=U64)
    start = np.arange(max(1, len(code) - k + 1))
    name = hash_spans(code, start, np.minimum(start + k, len(code)))
    order = np.argsort(name, kind="stable")
    sorted_name = name[order]
    fresh = np.ones(len(name), dtype=bool)
    np.not_equal(sorted_name[1:], sorted_name[:-1], out=fresh[1:])
    number = np.zeros(len(name), dtype=U64)
    if not fresh.all():
        place = np.arange(len(name))
        number[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    with np.errstate(over="ignore"):
        return mix(name + number * U64(0xD6E8FEB86659FD93))


def signature(text: str) -> np.ndarray:
    """The 32-bit hash of each permutation's selected k-mers; zeros for an empty text."""
    name = numbered_kmers(text)
    if not len(name):
        return np.zeros(TUPLES, dtype=np.uint32)
    first = np.zeros(TUPLES, dtype=np.int64)
    second = np.zeros(TUPLES, dtype=np.int64)
    step = max(1, AT_ONCE // len(name))
    with np.errstate(over="ignore"):
        for a in range(0, TUPLES, step):
            rows = np.arange(len(_ODD[a : a + step]))
            value = name * _ODD[a : a + step, None]
            first[a : a + step] = least = value.argmin(axis=1)
            value[rows, least] = _TOP
            second[a : a + step] = value.argmin(axis=1)
        left, right = np.minimum(first, second), np.maximum(first, second)
        both = name[left] * U64(0x9E3779B97F4A7C15) + mix(name[right], 3) + _ODD
        return (mix(both) >> U64(33)).astype(np.uint32) + np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _in_order(docs: DataFrame) -> DataFrame:
    """(role, doc_id, text): partitions of descending doc_id, each followed by its successor.

    Ranges come from quantiles of the ids alone. What passes through the driver is two numbers
    a partition. The first row of each partition is copied to the end of the one before it.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(1 << 63)).cast("long")
    keyed = docs.withColumn("place", -F.coalesce(F.col("doc_id"), low).cast("double"))
    cuts = keyed.approxQuantile("place", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    split = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform
    heads = (
        split(keyed.select("doc_id", "place"))
        .groupBy("bucket")
        .agg(F.min("place").alias("place"))
        .orderBy("bucket")
        .collect()
    )
    # Each bucket's first place goes to the bucket before it as well, the very first to the last.
    to = [(r["place"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)]
    copies = spark.createDataFrame(to, "place double, bucket double")
    columns = ("bucket", "role", "doc_id", "text", "place")
    own = split(keyed).withColumn("role", F.lit(0))
    after = keyed.join(F.broadcast(copies), "place").withColumn("role", F.lit(1))
    dealt = own.select(*columns).unionByName(after.select(*columns))
    return dealt.repartitionById(len(splits) - 1, F.col("bucket").cast("int")).sortWithinPartitions(
        "bucket", "role", "place", F.desc("doc_id"), "text"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # role, doc_id, text, signature of the row before
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            cols = [batch.column(x).to_pylist() for x in ("role", "doc_id", "text")]
            for role, doc, text in zip(*cols, strict=True):
                if role and before is not None and before[0]:
                    continue  # rows that tie with the successor
                mine = signature(text)
                if before is not None:
                    changed = edited(before[2], text)
                    other = signature(changed)
                    rows.append(
                        (
                            before[1],
                            len(before[2]),
                            hashlib.sha256(changed.encode()).hexdigest(),
                            before[3].astype(">u4").tobytes().hex(),
                            other.astype(">u4").tobytes().hex(),
                            likeness(before[3], other),
                            likeness(before[3], mine),
                        )
                    )
                before = (role, doc, text, mine)
            if rows:
                kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    ordered = _in_order(texts(docs))
    return ordered.select("role", "doc_id", "text").mapInArrow(run, SCHEMA)
