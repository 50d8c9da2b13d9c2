"""Look-ahead (LEAD) that does not gather a whole key into one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from nudgetrail.sources.tables import cut


def _same(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.ChunkedArray:
    """Row by row, whether two values are equal; NULL equals NULL and NaN equals NaN."""
    same = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(a.type):
        both = pc.and_(pc.is_nan(a), pc.is_nan(b))
        same = pc.or_(same, pc.fill_null(both, False))
    return pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))


def with_next(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds ``lead(value)`` over ``keys``, ordered by ``order`` and then every other column.

    Rows must be distinct, which makes that order total, and ``value`` must be one of the order
    columns. NULLs sort first. The result equals a plain window. The rows are sorted by ranges of
    the whole order, in one shuffle, so a key may hold any share of them: each task looks one row
    ahead among its own, and only its last row waits for the first row of the next task. Those first
    rows, one a task, are all that passes through the driver.

    The rows are written before the shuffle, which reads them twice, and after it, so that the
    tasks and their first rows stay what they were if an executor is lost.
    """
    keys, order = list(keys), list(order)
    if value not in order:
        raise ValueError("value must be one of the order columns")
    rows = cut(rows, "rows")
    columns = rows.columns
    total = [*keys, *order, *(c for c in columns if c not in {*keys, *order})]
    schema = StructType(
        [
            *rows.schema,
            StructField(name, rows.schema[value].dataType),
            StructField("__task", IntegerType()),
            StructField("__first", BooleanType()),
            StructField("__last", BooleanType()),
        ]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, held = TaskContext.get().partitionId(), True, None

        def seen(some: pa.Table, ahead: pa.Array, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first
            n = some.num_rows
            flags = [pa.array([first] + [False] * (n - 1)), pa.array([last] * n)]
            first = False
            tasks = pa.array([task] * n, pa.int32())
            out = pa.table([*some.columns, ahead, tasks, *flags], names=schema.names)
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            held = batch.slice(batch.num_rows - 1)
            now, after = both.slice(0, both.num_rows - 1), both.slice(1)
            if now.num_rows:
                follows = pa.array([True] * now.num_rows)
                for key in keys:
                    same = _same(now.column(key), after.column(key))
                    follows = pc.and_(follows, same.combine_chunks())
                apart = ~follows.to_numpy(zero_copy_only=False)
                next_row = pa.array(np.arange(1, both.num_rows), mask=apart)
                yield from seen(now, both.column(value).take(next_row), False)
        if held is not None:
            end = pa.Table.from_batches([held])
            yield from seen(end, pa.nulls(1, end.column(value).type), True)

    ranged = rows.repartitionByRange(*total).sortWithinPartitions(*total).select(*columns)
    looked = cut(ranged.mapInArrow(look, schema), "looked")
    # Written, each task's rows keep its number: the first row of a task goes to the one before.
    firsts = looked.where("__first").select("__task", *{*keys, value}).collect()
    firsts.sort(key=lambda r: r["__task"])
    after = {f"__{c}": c for c in dict.fromkeys([*keys, value])}
    carried = rows.sparkSession.createDataFrame(
        [
            (before["__task"], *(row[c] for c in after.values()))
            for before, row in zip(firsts, firsts[1:], strict=False)
        ],
        StructType(
            [
                StructField("__waits", IntegerType()),
                *(StructField(k, rows.schema[c].dataType) for k, c in after.items()),
            ]
        ),
    )
    follows = F.lit(True)
    for key in keys:
        follows = follows & F.col(key).eqNullSafe(F.col(f"__{key}"))
    waits = F.col("__last") & (F.col("__task") == F.col("__waits"))
    return looked.join(F.broadcast(carried), waits, "left").select(
        *columns,
        F.when(F.col("__last"), F.when(follows, F.col(f"__{value}")))
        .otherwise(F.col(name))
        .alias(name),
    )
