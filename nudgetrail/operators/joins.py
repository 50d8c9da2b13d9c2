"""Joins the study needs beyond a plain equi-join.

Only the list of hot keys is broadcast by hint, which ``HOT_KEYS`` bounds. Any other side Spark
broadcasts when its measured size allows it, and else shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """An equi-join in which NULL equals NULL; keeps the left side's key columns."""
    renamed = {name: f"__right_{name}" for name in on}
    condition = F.lit(True)
    for name, other in renamed.items():
        condition = condition & F.col(name).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())


def eav_lookup(context: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of an entity-attribute-value table that hold one key, value renamed.

    A message with several values for the key keeps one row per value.
    """
    return context.where(F.col("key") == key).select(
        "msg_id", "region", F.col("value_int").alias(name)
    )


def eav_flags(context: DataFrame, flags: Mapping[str, int]) -> DataFrame:
    """(msg_id, region, value, keys) of the rows that hold one of several keys, in one scan.

    ``flags`` gives a bit for each key; where one key has several, its rows carry them all.
    """
    keys = F.lit(0)
    for key, bit in flags.items():
        keys = keys.bitwiseOR(F.when(F.col("key") == key, bit).otherwise(0))
    return context.where(F.col("key").isin(*flags)).select(
        "msg_id", "region", F.col("value_int").alias("value"), keys.alias("keys")
    )


#: Rows of one key that a task may hold; a key with more is dealt to several tasks.
ROWS_A_TASK = 1 << 20
#: Keys that are dealt apart. A further key holds less than a thousandth of the rows.
HOT_KEYS = 1000


def hot_keys(rows: DataFrame, on: Sequence[str], rows_a_task: int) -> DataFrame:
    """The keys with more than ``rows_a_task`` rows, and ``__parts``, the tasks each is dealt to.

    Counts the key columns alone, combined before their shuffle. The result comes from the driver
    and has at most ``HOT_KEYS`` rows, the largest, so that it can always be broadcast.
    """
    n = F.count("*")
    counted = rows.groupBy(*on).agg(F.ceil(n / rows_a_task).cast("int").alias("__parts"))
    hottest = counted.where("__parts > 1").orderBy(F.desc("__parts")).limit(HOT_KEYS)
    return rows.sparkSession.createDataFrame(hottest.collect(), counted.schema)


def left_join_hot_right(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    repeats: bool = True,
    rows_a_task: int | None = None,
) -> DataFrame:
    """A left join whose right side may hold any share of its rows in one key.

    Spark splits a skewed left side of a left outer join, never the right one. Here the right rows
    of a hot key are dealt to parts by their content, and the left rows of hot keys, and of no
    others, are repeated once a part. A hot key has rows, by its count, so its left rows all match
    somewhere: a repeated left row that finds nothing in one part is dropped, and every other left
    row without a match stays. Nothing is written, and the left side is read once.

    ``repeats=False`` joins equal right rows once, combining them before any shuffle; only then is
    a key with very many equal rows spread as well. NULL keys match nothing, as in any join.
    """
    on = list(on)
    right = right.dropna(subset=on)
    hot = F.broadcast(hot_keys(right, on, rows_a_task or ROWS_A_TASK))
    if not repeats:
        right = right.distinct()
    rest = [c for c in right.columns if c not in on]
    part = F.pmod(F.xxhash64(*rest), "__parts") if rest else F.lit(0)
    dealt = (
        right.join(hot, on, "left")
        .withColumn("__part", F.coalesce(part, F.lit(0)).cast("int"))
        .withColumn("__matched", F.lit(True))
        .drop("__parts")
    )
    parts = F.coalesce("__parts", F.lit(1))
    repeated = left.join(hot, on, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return (
        repeated.join(dealt, [*on, "__part"], "left")
        .where(F.col("__matched") | F.col("__parts").isNull())
        .drop("__part", "__parts", "__matched")
    )


#: Days of the buckets of a level are this often those of the level below, as a power of two.
_STEP = 3


def _bucket(day: Column, bucket_days: int, level: str) -> Column:
    """The bucket a day is in on a level; buckets of all levels have numbers of their own."""
    width = F.expr(f"shiftleft(bigint({bucket_days}), {_STEP} * {level})")
    return (F.floor(F.unix_date(day) / width) + F.expr(f"{level} * {1 << 25}")).cast("int")


def bucketed_spans(spans: DataFrame, start: str, end: str, bucket_days: int) -> DataFrame:
    """Spans ``[start, end)`` once for each ``__bucket`` they touch, on the ``__level`` of their length.

    The buckets of a level are eight times as long as those below, and a span takes the lowest
    level on which it is no longer than eight buckets; so it touches nine at most, whatever its
    length. Empty spans, and those without a start or end, are left out.
    """
    last = F.date_sub(F.col(end), 1)
    days = F.datediff(F.col(end), F.col(start))
    fitting = F.log2(days / F.lit(bucket_days)) / _STEP
    level = F.greatest(F.lit(0), F.ceil(fitting - F.lit(1e-9)) - 1).cast("int")
    first = _bucket(F.col(start), bucket_days, "__level")
    buckets = F.sequence(first, _bucket(last, bucket_days, "__level"))
    return (
        spans.where(F.col(start) <= last)
        .withColumn("__level", level)
        .withColumn("__bucket", F.explode(buckets))
    )


def interval_join(
    facts: DataFrame,
    spans: DataFrame,
    on: Sequence[str],
    day: str,
    start: str,
    end: str,
    bucket_days: int = 7,
) -> DataFrame:
    """Inner join of facts with the spans ``[start, end)`` their day falls in.

    Spans are repeated for the at most nine time buckets of their own level, and facts once for
    each level that any span is on: once where no span is longer than eight buckets, and no
    more than three times for spans of up to 512. Joined on keys and bucket, a key with very many
    facts is spread over its buckets, and one with many spans only compares those near the fact's
    day. A fact lies in one bucket of a level and a span is on one level, so nothing is matched
    twice. ``spans`` are read twice, for the levels first. Empty spans, and those without a
    start or end, match nothing.
    """
    bucketed = bucketed_spans(spans, start, end, bucket_days)
    levels = bucketed.agg(F.collect_set("__level").alias("levels")).scalar()
    bucket = _bucket(F.col(day), bucket_days, "__level")
    facts = facts.withColumn("__level", F.explode(levels)).withColumn("__bucket", bucket)
    return (
        facts.drop("__level")
        .join(bucketed.drop("__level"), [*on, "__bucket"], "inner")
        .where((F.col(day) >= F.col(start)) & (F.col(day) < F.col(end)))
        .drop("__bucket")
    )


def provider_dims(site: DataFrame, acct: DataFrame, account: DataFrame) -> DataFrame:
    """Country and segments of each provider: site, then its account, all left joined."""
    return (
        site.select("provider", "region", "country")
        .join(acct.select("provider", "region", "account_id"), ["provider", "region"], "left")
        .join(account, "account_id", "left")
        .drop("account_id")
    )
