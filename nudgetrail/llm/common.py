"""Stages in the shared folder, and bounded slices of Arrow batches inside tasks."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # numpy takes some fifty times as much meanwhile


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


class Stages:
    """Stages of one run: parquet in a sub-folder of its own that every executor can reach.

    A lost executor costs the tasks of the stage being written, never the stages before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes ``df`` once and returns it read back."""
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes stages that nothing reads any more; without names, all of them.

        Shuffle files of finished jobs go with the driver's next collection, which this asks for.
        """
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for path in [f"{self.path}/{x}" for x in names] or [self.path]:
            p = jvm.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        self.spark._jvm.System.gc()


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row; a null text is empty. Other columns are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column``, or of one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
