"""Reading source tables, writing result tables, and cutting long plans between stages."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Inside a result's folder: its versions, and the file that names the one to read. Spark's own
#: listing passes over names that begin so.
VERSIONS, POINTER = "_versions", "_current"


def read_source(spark: SparkSession, name: str) -> DataFrame:
    """A path (anything with a slash), or a catalog table or view of one to three parts.

    A path that ``write_result`` has written is read at its current version, any other as parquet.
    """
    if "/" not in name:
        return spark.table(name)
    version = _current(spark, name)
    return spark.read.parquet(name if version is None else f"{name}/{VERSIONS}/{version}")


def write_result(df: DataFrame, target: str, suffix: str = "") -> DataFrame:
    """Creates or replaces ``target + suffix`` (a path or a catalog name) and reads it back.

    Every call writes a version of its own, whole, and then swaps one pointer: for a path the file
    that names the current version, by a rename that overwrites, and for a name of the session's
    catalog a view on the version. So a reader sees the old result or the new one whenever it looks,
    a driver lost at any step leaves the old one, and ``df`` may read from it. Versions but the
    current one and the one before it, which running readers may still use, are deleted by the next
    call that succeeds, with what lost drivers left. One writer at a time is assumed. Tables of
    another catalog are replaced by that catalog.
    """
    name = target + suffix
    spark = df.sparkSession
    if "/" not in name and name.count(".") == 2 and not name.startswith("spark_catalog."):
        df.writeTo(name).createOrReplace()
        return read_source(spark, name)
    home = name if "/" in name else _view_folder(spark, name)
    before = _current(spark, home)
    version = f"{_number(before) + 1:09d}-{uuid.uuid4().hex}"
    path = f"{home}/{VERSIONS}/{version}"
    df.write.parquet(path)
    if "/" not in name:
        _drop_table(spark, name)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    _point(spark, home, version)
    _sweep(spark, home, {version, before})
    return read_source(spark, name)


def drop_result(spark: SparkSession, target: str, suffix: str = "") -> None:
    """Deletes a result of ``write_result`` with all its versions."""
    name = target + suffix
    if "/" not in name:
        if name.count(".") == 2 and not name.startswith("spark_catalog."):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            return
        _drop_table(spark, name)
        spark.sql(f"DROP VIEW IF EXISTS {name}")
    home = name if "/" in name else _view_folder(spark, name)
    fs, path = _file(spark, home)
    fs.delete(path, True)


def _file(spark: SparkSession, path: str):
    """(file system, path), of Hadoop's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _current(spark: SparkSession, home: str) -> str | None:
    """The version that the pointer of a folder names, if it has one."""
    return read_note(spark, f"{home}/{POINTER}")


def read_note(spark: SparkSession, path: str) -> str | None:
    """What a small file of ``write_note`` holds, if there is one."""
    fs, note = _file(spark, path)
    if not fs.exists(note):
        return None
    stream = fs.open(note)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file: a new one, renamed over the old one in one step."""
    fs, fresh = _file(spark, f"{path}-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(hadoop.Path(path)), overwrite)


def _number(version: str | None) -> int:
    return int(version.split("-")[0]) if version else 0


def _point(spark: SparkSession, home: str, version: str) -> None:
    """Makes the pointer name ``version``, in one step."""
    write_note(spark, f"{home}/{POINTER}", version)


def _sweep(spark: SparkSession, home: str, kept: set[str | None]) -> None:
    """Deletes all in a result's folder but the kept versions and the pointer."""
    fs, folder = _file(spark, home)
    versions = spark._jvm.org.apache.hadoop.fs.Path(folder, VERSIONS)
    for there, names in ((versions, kept), (folder, {VERSIONS, POINTER, f".{POINTER}.crc"})):
        for found in fs.listStatus(there):
            if found.getPath().getName() not in names:
                fs.delete(found.getPath(), True)


def _view_folder(spark: SparkSession, name: str) -> str:
    """Where the versions behind a view are: beside the tables of its database."""
    database, _, view = name.removeprefix("spark_catalog.").rpartition(".")
    place = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{place.rstrip('/')}/{view}{VERSIONS}"


def _drop_table(spark: SparkSession, name: str) -> None:
    """Makes way for a view where a plain table of that name was written by other means."""
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def _stage_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/nudgetrail-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, stage: str) -> str:
    """A new path for a stage of this application."""
    return f"{_stage_folder(spark)}/{stage}-{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Deletes the stages of this application, once nothing is read from its results any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, stage: str) -> DataFrame:
    """Writes a stage to the shared checkpoint folder and returns it read back.

    For a stage that several later ones read: it is computed once, a lost executor cannot undo
    it, and each reader scans only its own columns. Every call writes a folder of its own;
    ``drop_stages`` deletes those of the application.
    """
    path = stage_path(df.sparkSession, stage)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class DayTable:
    """A folder of parquet files partitioned by a date column, replaced from some day on.

    Earlier days are neither read nor written. A driver lost between ``drop`` and the end of ``add``
    leaves some of the later days out, and the same two calls mend that: whoever keeps such a
    folder notes first from which day on it is in doubt.
    """

    def __init__(self, spark: SparkSession, path: str, day: str):
        self.spark, self.path, self.day = spark, path, day

    def drop(self, since: date) -> None:
        """Deletes the days from ``since`` on."""
        fs, folder = _file(self.spark, self.path)
        first = f"{self.day}={since.isoformat()}"
        for found in fs.listStatus(folder) if fs.exists(folder) else ():
            name = found.getPath().getName()
            if name.startswith(f"{self.day}=") and name >= first:
                fs.delete(found.getPath(), True)

    def add(self, rows: DataFrame) -> None:
        """Adds rows, whose days must not be NULL: a large day by several tasks, a small one by one."""
        spread = rows.hint("rebalance", F.col(self.day))
        spread.write.mode("append").partitionBy(self.day).parquet(self.path)
        # The columns, for a reader who finds no row.
        write_note(self.spark, f"{self.path}/_columns", rows.schema.json())

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The days ``first`` to ``last``, or all."""
        columns = StructType.fromJson(json.loads(read_note(self.spark, f"{self.path}/_columns")))
        rows = self.spark.read.schema(columns).parquet(self.path)
        if first is not None:
            rows = rows.where(F.col(self.day) >= F.lit(first))
        if last is not None:
            rows = rows.where(F.col(self.day) <= F.lit(last))
        return rows.select(*columns.names)
