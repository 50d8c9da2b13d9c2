"""A sieve of ids: a bitmap of their hashes, of bounded size, that leaves most other rows out early.

Where a few documents of a table are wanted, joining by id shuffles the texts of all. A row whose id
hashes to no set bit cannot be wanted and need not take part. A bitmap has ``BITS_EACH`` bits an id
and never more than ``MOST`` (8 MB); beyond that it lets more rows through, which costs a shuffle and
changes no result. A null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_EACH, MOST = 16, 1 << 26
PAGE_BITS = 15  # of a bitmap that Spark's bitmap functions make


class Sieve:
    """The ids in a column of ``rows``, which are read twice."""

    def __init__(self, rows: DataFrame, column: str):
        wanted = BITS_EACH * rows.count()
        self.bits = min(MOST, 1 << max(PAGE_BITS, wanted.bit_length()))
        page, bit = self._place(F.col(column))
        pages = rows.groupBy(page.alias("__page")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
        # At most MOST bits, whatever the rows are.
        self.pages = rows.sparkSession.createDataFrame(pages.collect(), pages.schema)

    def _place(self, key: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(key.cast("long")), F.lit(self.bits))
        return F.shiftright(at, PAGE_BITS), at.bitwiseAND((1 << PAGE_BITS) - 1)

    def marked(self, rows: DataFrame, column: str, mark: str) -> DataFrame:
        """``rows`` with a boolean ``mark``, false where the id in ``column`` is not wanted."""
        page, bit = self._place(F.col(column))
        byte = F.substring("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
        found = F.coalesce(value.bitwiseAND(mask) != 0, F.lit(False))
        joined = rows.join(F.broadcast(self.pages), page == F.col("__page"), "left")
        return joined.withColumn(mark, found).drop("__page", "__bits")

    def kept(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose id may be wanted."""
        return self.marked(rows, column, "__maybe").where("__maybe").drop("__maybe")
