"""Which attributed changes lasted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.operators.cycles import ITEM_KEY
from nudgetrail.settings import StudyDates

AREA_KEY = [*ITEM_KEY, "area"]
STATE_KEY = [*AREA_KEY, "original_rating", "original_price"]


def first_change(flags: DataFrame) -> DataFrame:
    """First date and number of dates with an attributed change, per item, area and anchor state."""
    return (
        flags.where("attributed_change")
        .groupBy(*STATE_KEY)
        .agg(
            F.count_distinct("date").alias("change_days"),
            F.min("date").alias("first_change_date"),
        )
    )


def state_at_first_change(flags: DataFrame, first: DataFrame) -> DataFrame:
    """Price on the first change date and the rating that followed it, without repeats.

    Items with a NULL area match nothing, here and in ``merge_change``.
    """
    return (
        flags.join(
            first.select(*STATE_KEY, F.col("first_change_date").alias("date")),
            [*STATE_KEY, "date"],
            "inner",
        )
        .groupBy(
            *AREA_KEY,
            F.col("date").alias("first_change_date"),
            F.col("next_rating").alias("following_rating"),
            F.col("price").alias("price_at_first_change"),
        )
        .agg(F.count("*").alias("row_count"))
    )


def _following(at_change: DataFrame) -> DataFrame:
    """Ratings that followed each first change, without the prices they were seen at."""
    return at_change.select(*AREA_KEY, "first_change_date", "following_rating").distinct()


def merge_change(flags: DataFrame, first: DataFrame, at_change: DataFrame) -> DataFrame:
    """Every trajectory row of an item that changed, with its first-change facts.

    An item whose several anchor states changed has its rows once for each, and once for each
    rating that followed: no more times than it has cycles and labels. The prices at the change
    are summed up to their lowest, highest and number; a row for each of them would be quadratic
    on an item with many observations a day, and joining ``at_change`` gives just those rows. The
    two small sides are joined first, so the trajectory is shuffled once.
    """
    key = [*AREA_KEY, "first_change_date"]
    price = F.col("price_at_first_change")
    following = at_change.groupBy(*key, "following_rating").agg(
        F.min(price).alias("lowest_price_at_change"),
        F.max(price).alias("highest_price_at_change"),
        F.count(price).alias("prices_at_change"),
    )
    facts = first.select(*key).join(following, key, "left")
    return flags.join(facts.fillna(0, ["prices_at_change"]), AREA_KEY, "inner")


def persistence(flags: DataFrame, at_change: DataFrame, dates: StudyDates) -> DataFrame:
    """Days after the first change on which the rating that followed it was seen again.

    Equals counting the matching distinct dates over ``merge_change`` and keeping counts above 0,
    without building its rows: only matching ratings can count, so both sides are reduced to
    distinct days and ratings and joined on the rating as well.
    """
    before_end = F.col("first_change_date") < F.lit(dates.obs_end)
    changes = _following(at_change.where(before_end))
    days = flags.select(*AREA_KEY, "date", F.col("rating").alias("following_rating")).distinct()
    return (
        days.join(changes, [*AREA_KEY, "following_rating"], "inner")
        .where(F.col("date") > F.col("first_change_date"))
        .groupBy(*AREA_KEY, "first_change_date", "following_rating")
        .agg(F.count("*").alias("days_persisted"))
    )
