"""Documents to a stage of token ids, with two-pass prefix sums over what each task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import SLICE_BYTES, Stages, slices
from nudgetrail.llm.tokens import encoder

SCHEMA = "part int, doc_id long, n_tokens long, local long, ids binary"


def tokenize(
    docs: DataFrame, path: str, end_id: int, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(part, doc_id, n_tokens, local, ids) for (doc_id, text) rows, in the order they come.

    ``ids`` are little-endian, of the width of ``encoder(path).dtype``, and end with ``end_id``.
    ``part`` is the task, ``local`` counts the ids before the document within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part, local = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", slice_bytes):
            ids, at = enc.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, at[1:], np.array(end_id, dtype=enc.dtype))
            at = at + np.arange(len(at))
            size = np.diff(at)
            data = memoryview(ids.astype(enc.dtype, copy=False)).cast("B")
            w = enc.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(size), part, dtype=np.int32)),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(size),
                    pa.array(local + at[:-1]),
                    pa.array(
                        [bytes(data[w * a : w * b]) for a, b in zip(at, at[1:])], pa.binary()
                    ),
                ],
                names=["part", "doc_id", "n_tokens", "local", "ids"],
            )
            local += int(at[-1])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def with_global_start(stage: DataFrame) -> DataFrame:
    """Adds ``start``: ids before the document in all parts, in order of ``part``.

    The totals that pass through the driver and the broadcast are one row for each task that
    wrote the stage, whatever the documents are.
    """
    totals = stage.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    base = stage.sparkSession.createDataFrame(rows, "part int, base long")
    return (
        stage.join(F.broadcast(base), "part")
        .withColumn("start", F.col("base") + F.col("local"))
        .drop("base")
    )


def token_stage(
    stages: Stages,
    docs: DataFrame,
    path: str,
    end_id: int,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``tokenize``, written once, with ``start``."""
    return with_global_start(stages.cut(tokenize(docs, path, end_id, slice_bytes), "ids"))
